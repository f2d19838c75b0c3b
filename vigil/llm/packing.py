"""Best-fit packing of tokenized documents into fixed-length sequences.

A document's ids (and an end id) are cut into pieces of ``capacity`` ids only
where they are longer.  Pieces above one third of the capacity are large: at
most two share a sequence, and a greedy matching (the largest with the largest
partner that still fits) gives as few sequences for them as possible.  Smaller
pieces then go, longest first, into the tightest gap that holds them, and into
new sequences when there is none.

Pieces of one length are interchangeable, so all of this is decided on the
histogram of lengths (at most ``capacity`` numbers, whatever the corpus holds)
by ``layout``: its steps place whole runs of equal pieces into runs of equal
gaps.  A piece knows its place among those of its length from its task's own
count plus the counts of the tasks before, and looks its run up.  Texts are not
exchanged; tokenizing happens where they lie, and rows of numbers move.

Bound of the layout: a run of gaps halves at least whenever it is filled, and is
split once per length at most, so there are O(capacity log capacity) steps.

Defined results: a null or blank text has the end id only; rows repeating a
doc_id, or without one, are documents of their own; other columns are ignored;
an empty table gives no rows.  Which of several equally long pieces gets which
gap depends on the order in which tasks read them.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.base import query, table, write_table
from vigil.llm.tokens import Words, shown, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
CAPACITY = 4096

# The tokenizer's splitting rule for the characters of _PLAIN (printable ASCII, tab, line ends,
# Latin-1 and Latin Extended-A letters whose lower case lies there too); white space only separates.
_PLAIN = re.compile("[^\\x20-\\x7e\\t\\n\\r¡-¬®-įı-ſ]")
_LETTER, _NUMBER = "a-zA-ZªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SPLIT = re.compile(_RULE.replace("\\p{L}", _LETTER).replace("\\p{N}", _NUMBER))


class Encoder:
    """Texts -> id arrays; chunks between white space are remembered where the tokenizer's rule allows it."""

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer
        self.tk = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tk.get_added_tokens_decoder().values()]
        self.end = np.array([end_id], "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        rules = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.split = steps == ["NFC", "Replace", "Lowercase"] and rules[0].get("pattern", {}).get("Regex") == _RULE
        self.model, self.words, self.chunks = self.tk.model, Words(self._word), Words(self._chunk)

    def _word(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(shown(word))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _SPLIT.findall(chunk)))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text and the end id."""
        if self.split and not _PLAIN.search(text) and not any(s in text for s in self.special):
            ids = np.frombuffer(b"".join(map(self.chunks.__getitem__, text.lower().split())), "<u4")
        else:
            ids = np.array(self.tk.encode(text, add_special_tokens=False).ids, "<u4")
        return np.concatenate([ids, self.end])


_encoders: dict = {}


def _encoder(path: str, end_id: int) -> Encoder:
    """One encoder per Python worker."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def cut(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, part, place (and ids).

    ``part`` numbers the task that cut the piece, ``place`` counts its earlier pieces of that length.
    """
    src = docs.select("doc_id", "text", F.spark_partition_id().alias("part"))
    kind = src.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place", *(["ids"] if with_ids else [])]

    def run(batches):
        enc = _encoder(path, end_id)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, piece, length, crc, place, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                a = enc.encode(text.as_py() or "")
                for k in range(0, len(a), capacity):
                    p = a[k:k + capacity]
                    row.append(i)
                    piece.append(k // capacity)
                    length.append(len(p))
                    crc.append(zlib.crc32(p))
                    place.append(seen[len(p)])
                    seen[len(p)] += 1
                    if with_ids:
                        ids.append(p.tobytes())
            at, piece = pa.array(row, pa.int64()), np.array(piece, np.int32)
            out = [batch.column("doc_id").take(at), piece, piece.astype(np.int64) * capacity, np.array(length, np.int64),
                   np.array(crc, np.int64), batch.column("part").take(at), np.array(place, np.int64), *([pa.array(ids, pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in out], names=names)
    return src.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, place long"
                          + (", ids binary" if with_ids else ""))


def layout(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces go: rows (length, first rank, first sequence, pieces per sequence, offset).

    The pieces of a length from the first rank on (up to the next row's) fill sequences one after the
    other, so many in each, from the offset on.
    """
    left, rank, rows, opened = dict(counts), dict.fromkeys(counts, 0), [], 0
    gaps: dict[int, list] = {}                     # gap -> runs (first sequence, number of sequences)
    order: list[int] = []                          # the gaps with runs, ascending

    def put(length, n, first, per, offset):
        rows.append((length, rank[length], first, per, offset))
        rank[length] += n
        left[length] -= n

    def leave(gap, first, n):
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    large = sorted(x for x, n in left.items() if 3 * x > capacity and n)
    for a in reversed(large):
        i = bisect_left(large, min(a, capacity - a) + 1) - 1
        while left[a]:
            while i >= 0 and left[large[i]] < (2 if large[i] == a else 1):
                i -= 1
            if i < 0:
                n, b = left[a], 0
            else:
                b = large[i]
                n = left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, opened, 1, 0)
            if b:
                put(b, n, opened, 1, a)
            leave(capacity - a - b, opened, n)
            opened += n
    for s in sorted((x for x, n in left.items() if 3 * x <= capacity and n), reverse=True):
        while left[s]:
            i = bisect_left(order, s)
            if i == len(order):                    # no gap holds it
                n = -(-left[s] // (capacity // s))
                leave(capacity, opened, n)
                opened += n
                continue
            gap = order[i]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[i]
            per = gap // s
            whole = min(n, left[s] // per)
            rest = left[s] - whole * per if whole < n else 0       # the last pieces of this length
            if whole:
                put(s, whole * per, first, per, capacity - gap)
                leave(gap - per * s, first, whole)
            if rest:
                put(s, rest, first + whole, per, capacity - gap)
                leave(gap - rest * s, first + whole, 1)
            leave(gap, first + whole + bool(rest), n - whole - bool(rest))
    return rows


def pack(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    pieces = write_table(cut(docs, path, end_id, capacity, with_ids), "packing-pieces")
    counts = write_table(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}      # capacity rows at most
    rows = sorted(layout(hist, capacity)) or [(0, 0, 0, 1, 0)]
    length, first_rank, first, per, offset = (np.array(c, np.int64) for c in zip(*rows))
    # as many numbers as the layout has steps
    shared = docs.sparkSession.sparkContext.broadcast((length * (1 << 44) + first_rank, first_rank, first, per, offset))
    # one row per task and length
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("place"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = ranked.select(*keep, "rank")
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}

    def place(batches):
        keys, first_rank, first, per, offset = shared.value
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, size * (1 << 44) + rank, "right") - 1
            k = rank - first_rank[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(first[at] + k // per[at]),
                                              pa.array(offset[at] + k % per[at] * size)], names=[*keep, "sequence_id", "offset"])
    return ranked.mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, doc_ids, ids) from ``pack(..., with_ids=True)``: what a trainer reads, one row per sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))        # capacity ids in all
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return rows.select("sequence_id", F.size("parts").alias("n_pieces"), F.col("parts")["doc_id"].alias("doc_ids"), joined.alias("ids"))


@query("op12_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of 4096 ids."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))
