"""SimHash near-duplicates with pigeonhole blocks.

A document's fingerprint has bit b set if over half of its word shingles' XXH64
values (seed 42) have it.  Two fingerprints within ``distance`` bits agree on
at least ``blocks - distance`` of ``blocks`` bit blocks, so every choice of that
many blocks is a join key and each close pair meets under one of them at
least; the Hamming distance is then verified.  More blocks make longer keys:
with 6 blocks and distance 3 there are 20 keys of 32 bits.

What is joined are distinct fingerprints (a group of exact copies is one row).
Rows meeting under one key are compared where they lie, in sorted order, and
only a spanning forest of their links goes on, never all pairs.  A key with
more than ``chunk`` fingerprints is dealt to pairs of chunks, so no task holds
more than two chunks of it, and every pair of its fingerprints still meets.

Defined results: null or blank text has the zero fingerprint and links like
any other; a text with fewer words than a shingle is one shingle; rows
repeating a doc_id are separate rows of one component; a null doc_id is never
the smallest unless its whole component has none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.base import fresh, map_text, partitions, query, table, write_table
from vigil.llm.components import components
from vigil.llm.text import LOWER, NOT_SPACE, join_words, word_spans

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCKS = 6
CHUNK = 2000
_SMALL = 32          # groups up to this size are compared lag by lag, larger ones by search
#: Byte value -> its eight bits, one per byte of a 64-bit integer (counts up to 255 add without carry).
_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
          .astype(np.uint64) << (8 * np.arange(8, dtype=np.uint64))).sum(1, dtype=np.uint64)


def shingle_spans(buf, offs, n):
    """Lower-cased words joined by one space, begin and stop of every n-word shingle there, and the number per row."""
    low = LOWER[buf]
    starts, ends, first = word_spans(low, offs, NOT_SPACE)
    words = np.diff(first)
    if not len(starts):
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64), words
    data, at = join_words(low, starts, ends)
    begin, stop = at[:-1], at[1:] - 1
    count = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(len(words)), count)
    head = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    tail = np.minimum(head + n, first[1:][row]) - 1
    return data, begin[head], stop[tail], count


def _shingles(buf, offs, n):
    """XXH64 of every word shingle and the number per row."""
    data, begin, stop, count = shingle_spans(buf, offs, n)
    xx = xxhash.xxh64_intdigest
    return np.fromiter((xx(data[a:b], SEED) for a, b in zip(begin.tolist(), stop.tolist())), np.uint64, len(begin)), count


def _fingerprint(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Majority bit per row of the 64-bit values ``h``."""
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    n = count[full]
    pieces = -(-n // 255)                                  # runs short enough for 8-bit counters
    start = np.cumsum(n) - n
    cut = np.repeat(start, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    rows = np.cumsum(pieces) - pieces
    bytes_ = h.view(np.uint8).reshape(-1, 8)
    for b in range(8):
        lanes = np.add.reduceat(_LANES[bytes_[:, b]], cut).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), rows, axis=0)
        bits = (2 * ones > n[:, None]).astype(np.uint64) << (np.uint64(8 * b) + np.arange(8, dtype=np.uint64))
        out[full] |= bits.sum(1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """``keep`` plus fp (64 bits as a signed long)."""
    return map_text(docs, lambda buf, offs: [_fingerprint(*_shingles(buf, offs, shingle)).view(np.int64)], [("fp", "long")], keep)


def _masks(blocks: int, distance: int) -> list[int]:
    """Bit masks of every choice of ``blocks - distance`` blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(part, blocks - distance)]


def _links(fp: np.ndarray, group: np.ndarray, distance: int) -> list[np.ndarray]:
    """Edges (two arrays) that connect, within each group of the sorted rows, all that is linked there."""
    u, v = [], []
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[begin, len(group)])
    wide = np.repeat(size > _SMALL, size)
    live = np.flatnonzero(~wide)
    d = 1
    while len(live := live[live + d < len(group)]) and len(live := live[group[live] == group[live + d]]):
        hit = live[np.bitwise_count(fp[live] ^ fp[live + d]) <= distance]
        u.append(fp[hit])
        v.append(fp[hit + d])
        d += 1
    for a, n in zip(begin[size > _SMALL].tolist(), size[size > _SMALL].tolist()):
        rest = fp[a:a + n]
        queue: list = []
        while len(rest):                                   # breadth-first; each fingerprint is reached once
            if not queue:
                queue, rest = [rest[0]], rest[1:]
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                new = rest[near]
                u.append(np.full(len(new), x))
                v.append(new)
                queue.extend(new)
                rest = rest[~near]
    return [np.concatenate(u) if u else fp[:0], np.concatenate(v) if v else fp[:0]]


def near_pairs(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) between distinct fingerprints: every linked pair is connected through them."""
    masks = _masks(blocks, distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)])).alias("b"))
    keyed = keyed.select("b.c", "b.k", "fp")
    hot = write_table(keyed.groupBy("c", "k").count().filter(F.col("count") > chunk), "simhash-hot")
    n = F.coalesce(F.ceil(F.col("count") / chunk), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    dealt = (keyed.join(hot, ["c", "k"], "left").withColumn("n", n).withColumn("mine", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
             .select("c", "k", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp"))
    dealt = dealt.repartition(partitions(fps.sparkSession), "c", "k", "i", "j").sortWithinPartitions("c", "k", "i", "j", "fp")

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            cols = [np.asarray(t.column(c)) for c in ("c", "k", "i", "j")]
            new = np.zeros(t.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            last = int(np.flatnonzero(new)[-1]) if new.any() else 0     # the last group may go on in the next batch
            fp = np.asarray(t.column("fp")).view(np.uint64)
            if last:
                e = _links(fp[:last], np.cumsum(new[:last]), distance)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in e], names=["u", "v"])
            held = t.slice(last).to_batches()[0] if t.num_rows else None
        if held is not None:
            fp = np.asarray(held.column("fp")).view(np.uint64)
            e = _links(fp, np.zeros(len(fp), np.int64), distance)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in e], names=["u", "v"])
    return dealt.mapInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, keep: list[str], id_col: str = "doc_id", shingle: int = SHINGLE, distance: int = DISTANCE,
                blocks: int = BLOCKS) -> DataFrame:
    """``keep`` plus fp, root (one fingerprint of the component) and component_id, the smallest ``id_col`` in it."""
    rows = write_table(fingerprints(docs, keep, shingle), "simhash-rows")
    nodes = write_table(rows.groupBy("fp").agg(F.min(id_col).alias("least_id")), "simhash-nodes")
    comp = components(near_pairs(nodes.select("fp"), distance, blocks))
    rooted = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select(*keep, "fp", "root", "component_id")


@query("op8_simhash_near_dedup")
def simhash_near_dedup(spark, sf_dir):
    """Fingerprint and component of every document."""
    out = near_groups(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component stays: the one with the smallest (doc_id, hash of its text)."""
    mark, kept_id, kept_mark = (fresh(n, docs.columns) for n in ("text_hash", "kept_id", "kept_mark"))
    marked = docs.withColumn(mark, F.xxhash64("text"))
    groups = near_groups(marked, ["doc_id", mark])
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", mark)).alias("best"))
    best = best.select(F.col("best.doc_id").alias(kept_id), F.col(f"best.{mark}").alias(kept_mark))
    here = F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(mark) == F.col(kept_mark))
    return marked.join(best, here, "left_semi").dropDuplicates(["doc_id", mark]).select(*docs.columns)
