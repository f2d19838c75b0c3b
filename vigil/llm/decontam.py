"""Benchmark decontamination with suffix arrays of the training text.

1. Every benchmark item's suffixes become rows: the hashes of the first
   ``window`` words, and of the first ``lead`` words, which name the shard.  An
   item shorter than the window is one suffix.
2. A bit filter of the leads (its size follows the benchmark up to
   ``MAX_FILTER_BITS``) goes to every task.  One pass over the training text
   picks the suffixes that may match and sends them to the shard of their lead;
   documents are dealt to ``spread`` shards a lead, so a passage in a third of
   all documents is no single task's.  Sorted, the shards are suffix arrays in
   shared storage.
3. Benchmark suffixes travel to the shards of their lead and are binary-searched
   there, batch by batch of the sorted array: a full window by its equal range, a
   shorter item by the range of its prefix.
4. Neighbouring hits on one diagonal (same item, same shift) are one longest
   verbatim match, with its place in document and item.

The work on the training text does not depend on the size of the benchmark, but
for the suffixes that pass the filter; no task receives the whole benchmark.
Texts move only in the last join, and there only if the table of matches is
above Spark's broadcast threshold.

Words are compared by 64-bit hashes of their bytes.  Defined results: null text
has no words; an item without words is ignored; a null item_id counts as an
empty one; an empty benchmark leaves all documents clean; rows repeating
doc_id and text are judged alike, other rows repeating a doc_id one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.base import drop_table, fresh, map_text, partitions, query, table, write_table
from vigil.llm.text import ALNUM, LOWER, run_hash, slices, span_hash, word_spans

WINDOW = 10
LEAD = 5                       # first words of a suffix that name its shard
FILTER_RATE = 128              # filter bits for each benchmark suffix: under 1 % of other suffixes pass
SPREAD = 8                     # shards of one lead; a document's suffixes go to one of them
MAX_FILTER_BITS = 1 << 28      # bound of what every task receives (32 MB); a fuller filter only lets more suffixes pass
_CHUNK = 1 << 15               # suffixes per Arrow batch


def _words(buf, offs):
    low = LOWER[buf]
    starts, ends, first = word_spans(low, offs, ALNUM)
    return span_hash(low, starts, ends), first


def _keys(h: np.ndarray, at: np.ndarray, length: np.ndarray, window: int) -> pa.Array:
    """The ``length`` words from ``at`` on as byte strings (zeros behind) whose order is the order of the suffixes."""
    step = np.arange(window)
    rows = np.where(step < length[:, None], h[np.minimum(at[:, None] + step, max(len(h) - 1, 0))], np.uint64(0)).astype(">u8")
    ends = np.arange(len(at) + 1, dtype=np.int32) * (8 * window)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def benchmark_suffixes(benchmark: DataFrame, window: int = WINDOW, lead: int = LEAD) -> DataFrame:
    """One row per window of an item: item (hash of id and text), item_id, item_word, n (words), lead_words, lead, key."""
    name = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    items = benchmark.select(F.xxhash64(name, "text").alias("item"), name.alias("item_id"), "text")

    def run(batches):
        for batch in batches:
            for i, _, buf, offs in slices(batch):
                h, first = _words(buf, offs)
                count = np.diff(first)
                n_win = np.where(count >= window, count - window + 1, (count > 0).astype(np.int64))
                row = np.repeat(np.arange(len(count)), n_win)
                offset = np.arange(n_win.sum()) - np.repeat(np.cumsum(n_win) - n_win, n_win)
                grams = {int(w): run_hash(h, int(w)) for w in np.unique(np.minimum(count, min(window, lead))) if w}
                for a in range(0, len(row), _CHUNK):
                    r, o = row[a:a + _CHUNK], offset[a:a + _CHUNK]
                    at, n = first[:-1][r] + o, np.minimum(count[r], window)
                    words = np.minimum(n, lead)
                    g = np.zeros(len(r), np.uint64)
                    for w, hashes in grams.items():
                        g[words == w] = hashes[at[words == w]]
                    take = pa.array(r + i)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("item").take(take), batch.column("item_id").take(take), pa.array(o), pa.array(n), pa.array(words),
                         _signed(g), _keys(h, at, n, window)], names=["item", "item_id", "item_word", "n", "lead_words", "lead", "key"])
    return items.mapInArrow(run, "item long, item_id string, item_word long, n long, lead_words long, lead long, key binary")


def lead_filter(suffixes: DataFrame, most_bits: int = MAX_FILTER_BITS) -> tuple[list[int], np.ndarray]:
    """(numbers of words the leads have, filter of the leads); the filter's words are combined in Spark, at most ``most_bits`` bits in all."""
    n, sizes = suffixes.agg(F.count(F.lit(1)), F.sort_array(F.collect_set("lead_words"))).first()
    words = max(1, min(most_bits, 1 << (FILTER_RATE * n + 1024).bit_length()) // 64)
    cells = (suffixes.select(F.shiftrightunsigned("lead", 6).bitwiseAND(F.lit(words - 1)).alias("cell"),
                             F.expr("shiftleft(1L, int(lead & 63))").alias("bit"))
             .groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow())
    bits = np.zeros(words, np.int64)
    bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return list(sizes), bits.view(np.uint64)


def _shard(lead: np.ndarray, n: int) -> np.ndarray:
    return (lead >> np.uint64(40)).astype(np.int64) % n


def training_arrays(keyed: DataFrame, sizes: list[int], bits: np.ndarray, window: int = WINDOW, spread: int = SPREAD) -> DataFrame:
    """Suffixes of ``keyed`` (k1, k2, text) whose lead passes the filter: shard, key, k1, k2, doc_word; sorted by (shard, key) in each file."""
    spark = keyed.sparkSession
    n = partitions(spark)
    shared = spark.sparkContext.broadcast(bits)                # MAX_FILTER_BITS at most

    def run(batches):
        known = shared.value
        mask = np.uint64(len(known) - 1)
        for batch in batches:
            for i, _, buf, offs in slices(batch):
                h, first = _words(buf, offs)
                count = np.diff(first)
                row = np.repeat(np.arange(len(count)), count)
                left = np.repeat(first[1:], count) - np.arange(len(h))          # words from here to the document's end
                for w in sizes:
                    g = run_hash(h, w)
                    may = (known[(g >> np.uint64(6)) & mask] >> (g & np.uint64(63))) & np.uint64(1)
                    found = np.flatnonzero((may > 0) & (left[:len(g)] >= w))
                    for a in range(0, len(found), _CHUNK):
                        at = found[a:a + _CHUNK]
                        take = pa.array(row[at] + i)
                        k2 = batch.column("k2").take(take)
                        shard = _shard(g[at], n) * spread + (k2.to_numpy().view(np.uint64) >> np.uint64(7)).astype(np.int64) % spread
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard), _keys(h, at, np.minimum(left[at], window), window), batch.column("k1").take(take), k2,
                             pa.array(at - first[row[at]])], names=["shard", "key", "k1", "k2", "doc_word"])
    out = keyed.mapInArrow(run, "shard long, key binary, k1 long, k2 long, doc_word long")
    return out.repartition(n, "shard").sortWithinPartitions("shard", "key")


class Probe:
    """Benchmark suffixes of one shard, to be searched in pieces of its sorted array."""

    def __init__(self, rows: pa.Table, window: int):
        keys, n = _fixed(rows["key"], window), rows["c"].to_numpy()
        order = np.lexsort((n, keys))
        keys, n, self.rows = keys[order], n[order], rows.take(pa.array(order))
        new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (n[1:] != n[:-1])])
        self.own = np.r_[new, len(keys)]                   # occurrences own[w]:own[w + 1] share suffix w
        keys, n = keys[new], n[new]
        self.full, self.short = np.flatnonzero(n == window), np.flatnonzero(n < window)
        self.low = keys
        high = np.frombuffer(keys[self.short].tobytes(), np.uint8).reshape(-1, 8 * window).copy()
        high[np.arange(8 * window) >= 8 * n[self.short][:, None]] = 255
        self.high = np.ascontiguousarray(high).view(f"S{8 * window}").ravel()

    def search(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``keys``, occurrence) of every hit."""
        full = self.low[self.full]
        a, b = np.searchsorted(full, keys[0], "left"), np.searchsorted(full, keys[-1], "right")
        lo = np.r_[np.searchsorted(keys, full[a:b], "left"), np.searchsorted(keys, self.low[self.short], "left")]
        hi = np.r_[np.searchsorted(keys, full[a:b], "right"), np.searchsorted(keys, self.high, "right")]
        suffix = np.r_[self.full[a:b], self.short]
        n = np.maximum(hi - lo, 0)
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        suffix = np.repeat(suffix, n)
        n = (self.own[1:] - self.own[:-1])[suffix]
        return np.repeat(at, n), np.repeat(self.own[suffix] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _fixed(column, window: int) -> np.ndarray:
    """A binary column of equally long keys as one numpy array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = 8 * window
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
    return np.ascontiguousarray(data[column.offset * width:(column.offset + len(column)) * width]).view(f"S{width}")


def search(arrays: DataFrame, suffixes: DataFrame, window: int = WINDOW, spread: int = SPREAD) -> DataFrame:
    """Hits: k1, k2, item, item_id, doc_word, item_word, n; every benchmark suffix against all shards of its lead."""
    n = partitions(arrays.sparkSession)
    shard = F.shiftrightunsigned("lead", 40) % n * spread
    probes = suffixes.select(F.explode(F.sequence(shard, shard + spread - 1)).alias("shard"), F.lit(0).alias("kind"), "key",
                             F.col("item").alias("a"), F.col("item_word").alias("b"), F.col("n").alias("c"), F.col("item_id").alias("name"))
    entries = arrays.select("shard", F.lit(1).alias("kind"), "key", F.col("k1").alias("a"), F.col("k2").alias("b"), F.col("doc_word").alias("c"),
                            F.lit(None).cast("string").alias("name"))

    def run(batches):
        shard, waiting, probe = None, [], None
        for batch in batches:
            at, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (kind[1:] != kind[:-1])])
            for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(at)]):
                piece = batch.slice(i, j - i)
                if at[i] != shard:
                    shard, waiting, probe = at[i], [], None
                if kind[i] == 0:
                    waiting.append(piece)
                    continue
                if waiting:
                    probe, waiting = Probe(pa.Table.from_batches(waiting), window), []
                if probe is None:                          # a shard reached by false positives only
                    continue
                row, occurrence = probe.search(_fixed(piece.column("key"), window))
                for x in range(0, len(row), _CHUNK):
                    here, there = piece.take(pa.array(row[x:x + _CHUNK])), probe.rows.take(pa.array(occurrence[x:x + _CHUNK])).combine_chunks()
                    other = {c: there[c].combine_chunks() for c in ("a", "name", "b", "c")}
                    yield pa.RecordBatch.from_arrays(
                        [here.column("a"), here.column("b"), other["a"], other["name"], here.column("c"), other["b"], other["c"]],
                        names=["k1", "k2", "item", "item_id", "doc_word", "item_word", "n"])
    return (probes.unionByName(entries).repartition(n, "shard").sortWithinPartitions("shard", "kind", "key")
            .mapInArrow(run, "k1 long, k2 long, item long, item_id string, doc_word long, item_word long, n long"))


def longest_matches(hits: DataFrame) -> DataFrame:
    """Hits chained along diagonals: k1, k2, item_id, doc_word, item_word, n_words of every longest verbatim match."""
    diagonal = ["k1", "k2", "item", "item_id", "shift"]
    run = F.col("doc_word") - F.row_number().over(Window.partitionBy(*diagonal).orderBy("doc_word"))
    return (hits.withColumn("shift", F.col("doc_word") - F.col("item_word")).distinct().withColumn("run", run)
            .groupBy(*diagonal, "run").agg(F.min("doc_word").alias("from"), F.min("item_word").alias("item_word"),
                                           (F.max(F.col("doc_word") + F.col("n")) - F.min("doc_word")).alias("n_words"))
            .select("k1", "k2", "item_id", F.col("from").alias("doc_word"), "item_word", "n_words"))


def contaminated(keyed: DataFrame, benchmark: DataFrame, window: int = WINDOW, lead: int = LEAD, spread: int = SPREAD,
                 most_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """Hit documents of ``keyed`` (k1, k2, text): k1, k2, n_hit, item_ids (sorted), matches; a written table."""
    suffixes = write_table(benchmark_suffixes(benchmark, window, lead), "benchmark-suffixes")
    arrays = write_table(training_arrays(keyed, *lead_filter(suffixes, most_bits), window, spread), "suffix-arrays")
    stop = F.col("doc_word") + F.col("n_words")
    before = F.max(stop).over(Window.partitionBy("k1", "k2").orderBy("doc_word", "n_words").rowsBetween(Window.unboundedPreceding, -1))
    match = F.struct("item_id", "doc_word", "item_word", "n_words")
    found = (longest_matches(search(arrays, suffixes, window, spread))
             .withColumn("gain", F.greatest(F.lit(0), stop - F.greatest("doc_word", F.coalesce(before, F.lit(0)))))
             .groupBy("k1", "k2").agg(F.sum("gain").alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("item_ids"),
                                      F.sort_array(F.collect_list(match)).alias("matches")))
    found = write_table(found, "decontam")
    drop_table(arrays)
    drop_table(suffixes)
    return found


def _key(docs: DataFrame) -> list[F.Column]:
    """Two hashes that name a row's text and doc_id (rows equal in both get equal results)."""
    return [F.xxhash64("text"), F.xxhash64("doc_id") if "doc_id" in docs.columns else F.xxhash64("text", F.lit(1))]


def _found(docs: DataFrame, benchmark: DataFrame, names: list[str], **how) -> DataFrame:
    a, b = _key(docs)
    return contaminated(docs.select(a.alias("k1"), b.alias("k2"), "text"), benchmark, **how).withColumnsRenamed(dict(zip(["k1", "k2"], names)))


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], **how) -> DataFrame:
    """Columns ``keep`` of ``docs`` plus n_words, n_hit, n_items, items_sha256, contaminated, matches (fresh names)."""
    n_words, n_hit, n_items, sha, bad, matches = (
        fresh(c, keep) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches"))
    k1, k2, a, b = (fresh(c, [*docs.columns, "text"]) for c in ("text_key", "id_key", "found_text_key", "found_id_key"))
    found = _found(docs, benchmark, [a, b], **how).select(
        a, b, F.col("n_hit").alias(n_hit), F.col("item_ids").alias(n_items), F.col("matches").alias(matches))
    first, second = _key(docs)
    counted = map_text(docs.withColumns({k1: first, k2: second}), lambda buf, offs: [np.diff(_words(buf, offs)[1])], [(n_words, "long")], [*keep, k1, k2])
    ids = F.coalesce(F.col(n_items), F.array().cast("array<string>"))
    return counted.join(found, (F.col(k1) == F.col(a)) & (F.col(k2) == F.col(b)), "left").select(
        *keep, n_words, F.coalesce(n_hit, F.lit(0)).alias(n_hit), F.size(ids).cast("long").alias(n_items),
        F.sha2(F.concat_ws(",", ids), 256).alias(sha), F.col(n_hit).isNotNull().alias(bad),
        F.coalesce(F.col(matches), F.array().cast("array<struct<item_id:string,doc_word:bigint,item_word:bigint,n_words:bigint>>")).alias(matches))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Rows of ``docs`` without any benchmark window, all columns unchanged."""
    a, b = (fresh(c, docs.columns) for c in ("found_text_key", "found_id_key"))
    found = _found(docs, benchmark, [a, b], **how).select(a, b)
    first, second = _key(docs)
    return docs.join(found, (first == F.col(a)) & (second == F.col(b)), "left_anti")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % (_UPPER, _LOWER)


@query("op5_benchmark_decontamination", f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def benchmark_decontamination(spark, sf_dir):
    """Words of every document inside verbatim benchmark windows of ten words."""
    out = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.drop("matches")
