"""Finding anchors (hashes of text pieces) that occur more than once, document by document.

Anchors travel in packed form: each Arrow batch sends one row per bucket with
its anchors' 32-bit residues grouped by document.  A bucket's rows meet in one
task, which sorts the residues and reports, to each document, those that occur
again.  Residue plus bucket is the anchor's identity; different anchors sharing
one are only reported needlessly, and callers verify what they get.

An anchor that repeats inside a batch is settled there (its occurrences are
reported at once) and sent on once, so an anchor found in a third of all
documents costs one entry per batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.base import ARROW_ROWS, partitions
from vigil.llm.text import slices

NO_ID = (1 << 63) - 1        # stands for a null doc_id: sorts behind all others


def keyed(docs: DataFrame) -> DataFrame:
    """(nid, tie, text): nid is doc_id with nulls last, tie tells apart texts under one doc_id.

    No column can be null, so both joins on (nid, tie) ask for the same exchange of texts and Spark makes it once.
    """
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("nid"), F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("tie"),
                       F.coalesce("text", F.lit("")).alias("text"))


def buckets(spark) -> int:
    return 2 * partitions(spark)


def identity(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket (upper half) and residue (lower half) of 64-bit hashes."""
    return ((h >> np.uint64(32)) % np.uint64(n) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary array whose i-th entry holds values[ends[i]:ends[i + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values.tobytes())])


def expand(ends: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Indices ends[i]:ends[i + 1] for every i of ``take``, one after the other."""
    n = ends[take + 1] - ends[take]
    return np.repeat(ends[take] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def rows_of(batch: pa.RecordBatch):
    return batch.column("nid").to_numpy(), batch.column("tie").to_numpy()


def batch_arrays(batch: pa.RecordBatch, kernel: Callable):
    """All slices of a batch: the kernel's arrays joined, its row numbers counted from the batch's start."""
    parts = []
    for i, _, buf, offs in slices(batch):
        h, row, *more = kernel(buf, offs)
        parts.append((h, row + i, *more))
    return [np.concatenate(x) for x in zip(*parts)] if parts else None


def sent_schema(*columns: str) -> str:
    return "part int, known boolean, nids array<long>, ties array<int>, counts binary" + "".join(f", {c} binary" for c in columns)


def pack(part, known, nid, tie, bucket, row, **columns) -> pa.RecordBatch:
    """One row per bucket, its entries' columns packed; entries must be sorted by (bucket, row)."""
    new_doc = np.r_[True, (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])]
    doc = np.flatnonzero(new_doc)
    doc_bucket = bucket[doc]
    first = np.flatnonzero(np.r_[True, doc_bucket[1:] != doc_bucket[:-1]])
    doc_ends = np.r_[first, len(doc)]
    entry_ends = np.r_[doc, len(row)][doc_ends]
    counts = np.diff(np.r_[doc, len(row)]).astype(np.uint32)
    lists = lambda x, t: pa.ListArray.from_arrays(pa.array(doc_ends, pa.int32()), pa.array(x, t))
    n = len(first)
    return pa.RecordBatch.from_arrays([
        pa.array(doc_bucket[first] if part is None else np.full(n, part), pa.int32()), pa.array([known] * n),
        lists(nid[row[doc]], pa.int64()), lists(tie[row[doc]], pa.int32()), binary(counts, doc_ends), *(binary(v, entry_ends) for v in columns.values())],
        names=["part", "known", "nids", "ties", "counts", *columns])


def unpack(batch: pa.RecordBatch, r: int, **kinds):
    """What ``pack`` put into one row: nid and tie per document, entries per document, and the packed columns."""
    return [batch.column("nids")[r].values.to_numpy(), batch.column("ties")[r].values.to_numpy(),
            np.frombuffer(batch.column("counts")[r].as_buffer(), np.uint32).astype(np.int64),
            *(np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in kinds.items())]


def repeated(docs: DataFrame, kernel: Callable) -> DataFrame:
    """Findings (see ``beside``): the identities of every document's anchors found more than once.

    ``kernel(bytes, offsets)`` gives the hash and row of every anchor of a slice.
    """
    n = buckets(docs.sparkSession)

    def send(batches):
        for batch in batches:
            got = batch_arrays(batch, kernel)
            if got is None or not len(got[0]):
                continue
            nid, tie = rows_of(batch)
            ident, row = identity(got[0], n), got[1]
            order = np.argsort(ident, kind="stable")
            ident, row = ident[order], row[order]
            head = np.r_[True, ident[1:] != ident[:-1]]
            at = np.flatnonzero(head)
            size = np.diff(np.r_[at, len(ident)])
            multi = np.repeat(size > 1, size)
            bucket = (ident >> np.uint64(32)).astype(np.int64)
            o = at[np.lexsort((row[at], bucket[at]))]
            yield pack(None, False, nid, tie, bucket[o], row[o], h=(ident[o] & np.uint64(0xFFFFFFFF)).astype(np.uint32), dup=multi[o].astype(np.uint8))
            if multi.any():
                o = np.flatnonzero(multi)
                o = o[np.argsort(row[o], kind="stable")]
                # no other batch is needed for these: they go anywhere, by document
                yield pack(int(nid[0] % n), True, nid, tie, np.zeros(len(o), np.int64), row[o], h=ident[o], dup=np.zeros(len(o), np.uint8))

    def meet(batches):
        seen, found = [], Findings()
        for batch in batches:
            for r in range(batch.num_rows):
                nids, ties, counts, *more = unpack(batch, r, **({"h": np.uint64} if batch.column("known")[r].as_py() else {"h": np.uint32, "dup": np.uint8}))
                if len(more) == 1:
                    found.add(np.repeat(nids, counts), np.repeat(ties, counts), more[0])
                else:
                    seen.append((nids, ties, counts, (np.uint64(batch.column("part")[r].as_py()) << np.uint64(32)) | more[0], more[1]))
        if seen:
            nids, ties, counts, ident, dup = (np.concatenate(x) for x in zip(*seen))
            del seen
            order = np.argsort(ident, kind="stable")
            same = ident[order][1:] == ident[order][:-1]
            twice = np.zeros(len(ident), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            twice &= dup == 0                          # repeats inside a batch were reported by that batch
            found.add(np.repeat(nids, counts)[twice], np.repeat(ties, counts)[twice], ident[twice])
        yield from found.rows(n)

    sent = docs.mapInArrow(send, sent_schema("h", "dup")).repartition(partitions(docs.sparkSession), "part")
    return sent.mapInArrow(meet, FOUND)


class Findings:
    """What one task found for documents, gathered to one row per destination."""

    def __init__(self):
        self.parts = []

    def add(self, nid, tie, values) -> None:
        if len(values):
            self.parts.append((np.asarray(nid), np.asarray(tie), np.asarray(values)))

    def rows(self, n: int):
        """One row per destination: its documents and their values, packed."""
        if self.parts:
            nid, tie, values = (np.concatenate(x) for x in zip(*self.parts))
            dest = destination_of(nid, tie, n)
            order = np.lexsort((tie, nid, dest))
            nid, tie, dest = nid[order], tie[order], dest[order]
            row = np.cumsum(np.r_[0, (nid[1:] != nid[:-1]) | (tie[1:] != tie[:-1])])
            heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            yield pack(None, True, nid[heads], tie[heads], dest, row, values=values[order])


def destination(n: int) -> F.Column:
    """Which of n groups a document's findings go to (copies of one text go to many)."""
    mixed = F.shiftright(F.pmod("nid", F.lit(1 << 31)) * F.lit(2654435761), 20)
    return F.pmod(mixed + F.col("tie"), F.lit(n)).cast("int")


def destination_of(nid: np.ndarray, tie: np.ndarray, n: int) -> np.ndarray:
    return (((nid % (1 << 31)) * 2654435761 >> 20) + tie) % n


def beside(docs: DataFrame, found: DataFrame, run: Callable, schema: str, kind) -> DataFrame:
    """``run`` over the documents of every destination with what was found for them.

    ``run(batch, values, own)`` gets a batch (nid, tie, text) and yields batches of ``schema``;
    values[own[i]:own[i + 1]] belong to row i.  A destination is a fixed share of all documents (there are
    twice as many as shuffle partitions), and its findings come in one row per sending task.
    """
    n = buckets(docs.sparkSession)
    left = docs.withColumn("part", destination(n))
    out_schema = None

    def group(texts: pa.Table, finds: pa.Table) -> pa.Table:
        parts = [unpack(b, r, values=kind) for b in finds.to_batches() for r in range(b.num_rows)]
        if parts:
            nid, tie, values = (np.concatenate(x) for x in zip(*((np.repeat(a, c), np.repeat(b, c), v) for a, b, c, v in parts)))
        else:
            nid, tie, values = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, kind)
        order = np.lexsort((tie, nid))
        nid, tie, values = nid[order], tie[order], values[order]
        head = np.flatnonzero(np.r_[True, (nid[1:] != nid[:-1]) | (tie[1:] != tie[:-1])]) if len(nid) else np.zeros(0, np.int64)
        place = {key: i for i, key in enumerate(zip(nid[head].tolist(), tie[head].tolist()))}
        ends = np.r_[head, len(nid)]
        out = []
        for batch in texts.to_batches(ARROW_ROWS):
            at = np.array([place.get(key, -1) for key in zip(*(x.tolist() for x in rows_of(batch)))], np.int64)
            have = np.flatnonzero(at >= 0)
            size = np.zeros(len(at), np.int64)
            size[have] = np.diff(ends)[at[have]]
            out += run(batch, values[expand(ends, at[have])], np.r_[0, np.cumsum(size)])
        return pa.Table.from_batches(out, schema=out_schema)
    out_schema = arrow_schema(schema)
    return left.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(group, schema)


def arrow_schema(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
             "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


FOUND = sent_schema("values")
