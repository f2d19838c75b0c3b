"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order byte context tree: for every context of 0 to
``ORDER`` bytes the counts of the bytes that followed it in the training text.
A byte's probability is that of the longest context known, or the escape
probability (method C: distinct followers / (count + distinct followers)) times
that of the next shorter context, down to a uniform byte.  Statistics are
frozen, so a byte's code length is a function of the last ORDER + 1 bytes only;
the lengths are tabulated for every byte sequence seen in training, for all
languages at once.  The predicted language has the least total code length
over the whole text; the score is its posterior probability under equal priors.

Training uses a bounded sample of the labelled rows: about ``FIT_ROWS`` per
language, chosen by hash (all rows of a language with fewer).  Code lengths are
integers (1/4096 bit), so sums do not depend on how rows are batched.

Defined results: null texts and texts without a letter are ``und`` with score
0, as is everything when no training row exists; ties go to the first language
by name; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.base import fresh, map_text, query, table
from vigil.llm.text import mix, slices

ORDER = 4
FIT_ROWS = 500          # expected training rows per language at most
UNIT = 4096             # code length units per bit
MIN_SCORE = 0.5         # the pipeline rejects documents below this posterior
MAX_FOREIGN = 0.5       # ... or with most characters of scripts that no training text has
_PAD = 0xFF             # precedes every text; no UTF-8 text has this byte


def _grams(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The last ORDER + 1 bytes up to every position, as an integer."""
    g = buf.astype(np.uint64)
    within = np.arange(len(buf)) - np.repeat(offs[:-1], np.diff(offs))
    for k in range(1, ORDER + 1):
        prev = np.full(len(buf), _PAD, np.uint64)
        prev[k:] = np.where(within[k:] >= k, buf[:-k], _PAD)
        g |= prev << np.uint64(8 * k)
    return g


class Lookup:
    """Hash table from 64-bit keys to their position."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        mask, left, at = (1 << self.bits) - 1, np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & mask

    def _home(self, keys):
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 if absent."""
        mask, out = (1 << self.bits) - 1, np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        left, at, ask = None, self._home(keys), keys
        while True:
            got = self.slot[at]
            known = self.keys[np.maximum(got, 0)] == ask
            hit = (got >= 0) & known
            if left is None:
                out[hit] = got[hit]
                left = np.flatnonzero((got >= 0) & ~known)
                at, ask = (at[left] + 1) & mask, ask[left]
            else:
                out[left[hit]] = got[hit]
                more = (got >= 0) & ~known
                left, at, ask = left[more], (at[more] + 1) & mask, ask[more]
            if not len(left):
                return out


class Model:
    """Code lengths of every known byte sequence under every language."""

    def __init__(self, langs: np.ndarray, grams: np.ndarray, counts: np.ndarray):
        self.langs = sorted(set(langs.tolist()))
        n = len(self.langs)
        which = np.searchsorted(np.array(self.langs, object), langs.astype(object)) if n else np.zeros(0, np.int64)
        below = None
        self.levels = []          # per order, from 0: lookup of sequences, their lengths, lookup of contexts, their escapes
        for k in range(ORDER + 1):
            cut = grams & np.uint64((1 << 8 * (k + 1)) - 1)
            keys, inv = np.unique(cut, return_inverse=True)
            c = np.zeros((len(keys), n))
            np.add.at(c, (inv, which), counts)
            ctx, up = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(ctx), n)), np.zeros((len(ctx), n))
            np.add.at(total, up, c)
            np.add.at(kinds, up, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                cost = -np.log2(c / (total + kinds)[up])
            if below is None:
                lower = np.full((len(keys), n), 8.0)
            else:
                lower = below[1][np.searchsorted(below[0], keys & np.uint64((1 << 8 * k) - 1))]
            cost = np.where(c > 0, cost, escape[up] + lower)
            below = keys, cost
            whole = lambda x: np.ascontiguousarray(np.rint(x * UNIT).astype(np.int32).T)
            self.levels.append((Lookup(keys), whole(cost), Lookup(ctx), whole(escape)))

    def lengths(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of every row under every language, in units."""
        out = np.zeros((len(self.langs), len(offs) - 1), np.int64)
        full = np.flatnonzero(np.diff(offs))
        if not len(full) or not self.langs:
            return out
        g = _grams(buf, offs)
        seqs, cost, _, _ = self.levels[ORDER]
        at = seqs.find(g)
        miss = np.flatnonzero(at < 0)
        missed = self._escaped(g[miss])
        for i in range(len(self.langs)):
            c = cost[i][at]
            c[miss] = missed[i]
            out[i][full] = np.add.reduceat(c, offs[:-1][full], dtype=np.int64)
        return out

    def foreign(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Share of every row's characters whose first byte no training text of any language has."""
        known = np.zeros(256, bool)
        known[self.levels[0][0].keys.astype(np.int64)] = True
        first = (buf & 0xC0) != 0x80                     # all bytes but the later ones of a character
        total, strange = np.zeros(len(buf) + 1, np.int64), np.zeros(len(buf) + 1, np.int64)
        np.cumsum(first, out=total[1:])
        np.cumsum(first & ~known[buf], out=strange[1:])
        return (strange[offs[1:]] - strange[offs[:-1]]) / np.maximum(total[offs[1:]] - total[offs[:-1]], 1)

    def _escaped(self, g: np.ndarray) -> np.ndarray:
        """Lengths of sequences that no language has at full order."""
        out = np.zeros((len(self.langs), len(g)), np.int32)
        left = np.arange(len(g))
        for k in range(ORDER, -1, -1):
            if k < ORDER:
                at = self.levels[k][0].find(g[left] & np.uint64((1 << 8 * (k + 1)) - 1))
                hit = at >= 0
                out[:, left[hit]] += self.levels[k][1][:, at[hit]]
                left = left[~hit]
            ctx = self.levels[k][2].find((g[left] & np.uint64((1 << 8 * (k + 1)) - 1)) >> np.uint64(8))
            known = ctx >= 0
            out[:, left[known]] += self.levels[k][3][:, ctx[known]]
        out[:, left] += 8 * UNIT
        return out


def held_out() -> F.Column:
    """Rows whose crc32(doc_id as text) leaves 1 when divided by 3 (a null doc_id counts as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Context statistics from about ``rows`` rows of every language of ``labelled`` (doc_id, text, lang)."""
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}      # one row per language
    scale = 1 << 30
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(scale, scale * rows // n))]) if counts else None
    grams = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for i, j, buf, offs in slices(batch):
                g = _grams(buf, offs)
                row = np.repeat(np.arange(j - i), np.diff(offs))
                for lang in set(langs[i:j]):
                    keys, n = np.unique(g[(langs[i:j] == lang)[row]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], schema=grams)
    if not counts:
        return Model(np.zeros(0, object), np.zeros(0, np.uint64), np.zeros(0))
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit("fit")), F.lit(scale))
    sample = labelled.filter(part < F.element_at(limit, F.col("lang")))
    t = (sample.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
         .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow())
    return Model(np.array(t.column("lang").to_pylist(), object), t.column("gram").to_numpy().astype(np.uint64), t.column("n").to_numpy())


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` plus lang_pred, score, bits_per_byte, foreign_share (fresh names) for every whole text of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)        # bounded by the training sample
    lettered, lang, score, bits, foreign = (fresh(n, docs.columns) for n in ("lettered", "lang_pred", "score", "bits_per_byte", "foreign_share"))

    def kernel(buf, offs):
        m = shared.value
        total, size = m.lengths(buf, offs), np.diff(offs)
        if not m.langs:
            return [pa.array(["und"] * len(size), pa.string()), *[np.zeros(len(size))] * 3]
        best = total.argmin(0)
        least = total[best, np.arange(len(size))]
        weight = np.exp2(-np.minimum((total - least) / UNIT, 1000.0)).sum(0)
        return [pa.array(m.langs, pa.string()).take(pa.array(best)), 1.0 / weight, least / UNIT / np.maximum(size, 1), m.foreign(buf, offs)]
    known = docs.withColumn(lettered, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    out = map_text(known, kernel, [(lang, "string"), (score, "double"), (bits, "double"), (foreign, "double")], [*keep, lettered])
    und = ~F.col(lettered) | (F.col(lang) == "und")
    return out.select(*keep, F.when(und, "und").otherwise(F.col(lang)).alias(lang),
                      F.when(und, 0.0).otherwise(F.col(score)).alias(score), bits, foreign)


@query("op1_ppm_language_id")
def ppm_language_id(spark, sf_dir):
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    out = identify(docs, model, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def keep_identified(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose language is recognised: not ``und``, posterior within its limit, script known to the model.

    Without any labelled row to learn from, all rows whose text has a letter stay.
    """
    model = fit(training.filter(~held_out()))
    if not model.langs:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    out = identify(docs, model, docs.columns)
    lang, score, foreign = (F.col(fresh(n, docs.columns)) for n in ("lang_pred", "score", "foreign_share"))
    return out.filter((lang != "und") & (score >= MIN_SCORE) & (foreign <= MAX_FOREIGN)).select(*docs.columns)
