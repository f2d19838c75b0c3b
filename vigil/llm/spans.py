"""Substring dedup with difference-cover anchors.

A word is removed if it lies in a window of ``WINDOW`` words whose sequence
also starts in a document with a smaller doc_id.  To find such windows without
exchanging all of them, runs of ``ANCHOR`` words are hashed only where the
word's number modulo ``PERIOD`` is in a difference cover of the period.  Two
equal windows, wherever they start, have a shift below the period that puts
both on cover positions, so they share an anchor at the same place inside;
hence a window without a repeated anchor is unique.  Around repeated anchors
the match is extended: every window that holds one is compared by an 80-bit
hash of its words (plus its bucket) with all others.

Steps: anchors that occur again (``anchors.repeated``) go back to their
documents; candidate windows are packed per batch and bucket and meet once;
removed starts go back to their documents.  No pairs are built: a window is
compared with the smallest doc_id that has it.  Equal windows of one batch are
settled there and only those of the smallest doc_id travel, so a passage found
in a third of all documents is one entry per batch.

Defined results: null text has no words; texts under ``WINDOW`` words lose
none; rows repeating a doc_id are separate texts and never remove each other's
words; a null doc_id counts as larger than all others; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import anchors as A
from vigil.llm.base import partitions, query, table
from vigil.llm.text import NOT_SPACE, count_by_row, join_words, mix, run_hash, slices, span_hash, word_spans

WINDOW = 13
ANCHOR = 7
PERIOD = 7
COVER = (0, 1, 3)            # differences 0 to 6 modulo 7 all occur between two of these
assert ANCHOR + PERIOD - 1 <= WINDOW and {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
_ON_COVER = np.isin(np.arange(PERIOD), COVER)


def _anchors(buf, offs):
    """Word spans and hashes, and hash, row and word of every anchor."""
    starts, ends, first = word_spans(buf, offs, NOT_SPACE)
    h = span_hash(buf, starts, ends)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    runs = run_hash(h, ANCHOR)
    n = np.arange(len(runs))
    r = row[:len(runs)]
    at = np.flatnonzero(_ON_COVER[(n - first[r]) % PERIOD] & (n + ANCHOR <= first[r + 1]) & (first[r + 1] - first[r] >= WINDOW))
    return (starts, ends, first, h, row), (runs[at], row[at], at)


def _windows(buf, offs, idents, own, n_buckets):
    """High and low hash, row and word number of every window around a reported anchor.

    ``idents[own[i]:own[i + 1]]`` are the identities reported for row i.
    """
    (starts, ends, first, h, row), (run, arow, at) = _anchors(buf, offs)
    tag = lambda i, r: mix(i ^ (r.astype(np.uint64) << np.uint64(40)))
    told = np.repeat(np.arange(len(own) - 1), np.diff(own))
    at = at[np.isin(tag(A.identity(run, n_buckets), arow), tag(idents, told))]
    r = row[at]
    lo, hi = np.maximum(at - PERIOD + 1, first[r]), np.minimum(at, first[r + 1] - WINDOW)
    step = np.zeros(len(h) + 1, np.int32)
    np.add.at(step, lo, 1)
    np.add.at(step, hi + 1, -1)
    at = np.flatnonzero(np.cumsum(step[:-1]))
    if not len(at):
        none = np.zeros(0, np.uint64)
        return none, np.zeros(0, np.int64), none, none
    second = span_hash(buf, starts, ends, 1)
    return run_hash(h, WINDOW)[at], row[at], run_hash(second, WINDOW)[at] & np.uint64(0xFFFF), (at - first[row[at]]).astype(np.uint64)


def _first_ids(hi, lo, nid):
    """For windows given by hash: order by hash and, in that order, the smallest nid having each."""
    order = np.lexsort((lo, hi))
    a, b = hi[order], lo[order]
    begin = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    least = np.minimum.reduceat(nid[order], begin)
    return order, np.repeat(least, np.diff(np.r_[begin, len(order)]))


def removed_starts(docs: DataFrame) -> DataFrame:
    """Findings: the word numbers at which removed windows of ``docs`` (nid, tie, text) start."""
    n = A.buckets(docs.sparkSession)

    def kernel(buf, offs):
        run, row, _ = _anchors(buf, offs)[1]
        return run, row

    def send(batch, idents, own):
        nid, tie = A.rows_of(batch)
        parts = []
        for i, j, buf, offs in slices(batch):
            a, r, b, p = _windows(buf, offs, idents[own[i]:own[j]], own[i:j + 1] - own[i], n)
            parts.append((a, r + i, b, p))
        hi, row, lo, pos = (np.concatenate(x) for x in zip(*parts))
        if not len(hi):
            return
        order, least = _first_ids(hi, lo, nid[row])
        later = order[nid[row[order]] > least]
        if len(later):                                     # an earlier document of this batch has the window
            later = later[np.lexsort((pos[later], row[later]))]
            yield A.pack(int(nid[0] % n), True, nid, tie, np.zeros(len(later), np.int64), row[later],
                         **_places(pos[later]), hi=np.zeros(len(later), "u1"), lo=np.zeros(len(later), "u1"))
        here = order[nid[row[order]] == least]
        bucket = ((hi >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
        here = here[np.lexsort((pos[here], row[here], bucket[here]))]
        yield A.pack(None, False, nid, tie, bucket[here], row[here], **_places(pos[here]), hi=hi[here], lo=lo[here].astype(np.uint16))

    def meet(batches):
        seen, found = [], A.Findings()
        for batch in batches:
            for r in range(batch.num_rows):
                known = batch.column("known")[r].as_py()
                kinds = {"near": np.uint16, "far": np.uint16} | ({} if known else {"hi": np.uint64, "lo": np.uint16})
                nids, ties, counts, near, far, *more = A.unpack(batch, r, **kinds)
                entries = (np.repeat(nids, counts), np.repeat(ties, counts), near + (far.astype(np.uint32) << 16))
                if known:
                    found.add(*entries)
                else:
                    seen.append((*entries, *more))
        if seen:
            nid, tie, start, hi, lo = (np.concatenate(x) for x in zip(*seen))
            del seen
            order, least = _first_ids(hi, lo, nid)
            late = order[nid[order] > least]
            found.add(nid[late], tie[late], start[late])
        yield from found.rows(n)

    found = A.repeated(docs, kernel)
    sent = A.beside(docs, found, send, A.sent_schema("near", "far", "hi", "lo"), np.uint64)
    return sent.repartition(partitions(docs.sparkSession), "part").mapInArrow(meet, A.FOUND)


def _places(pos: np.ndarray) -> dict:
    """Word numbers as two 16-bit columns (the upper one is almost always 0 and costs nothing)."""
    return {"near": (pos & np.uint64(0xFFFF)).astype(np.uint16), "far": (pos >> np.uint64(16)).astype(np.uint16)}


def remove_shared_windows(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 (and the kept words, joined by blanks)."""
    keyed = A.keyed(docs)
    schema = "nid long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batch, all_starts, own):
        for i, j, buf, offs in slices(batch):
            starts, ends, first = word_spans(buf, offs, NOT_SPACE)
            at = all_starts[own[i]:own[j]].astype(np.int64) + np.repeat(first[:-1], np.diff(own[i:j + 1]))
            step = np.zeros(len(starts) + 1, np.int32)
            np.add.at(step, at, 1)
            np.add.at(step, at + WINDOW, -1)
            keep = np.cumsum(step[:-1]) == 0
            left = count_by_row(keep, first)
            data, pos = join_words(buf, starts[keep], ends[keep])
            edge = pos[np.r_[0, np.cumsum(left)]]
            texts = [data[a:max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            cols = [batch.column("nid").slice(i, j - i), pa.array(np.diff(first)), pa.array(np.diff(first) - left),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array([t.decode() for t in texts], pa.string())] if with_text else []), names=names)
    out = A.beside(keyed, removed_starts(keyed), run, schema, np.uint32)
    return out.select(F.when(F.col("nid") != A.NO_ID, F.col("nid")).alias("doc_id"), *names[1:])


@query("op10_cover_anchor_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT win, min(doc_id) AS first_id FROM x GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM x JOIN f USING (win) WHERE doc_id > first_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""")
def cover_anchor_dedup(spark, sf_dir):
    """Words of every document outside windows that an earlier document has."""
    return remove_shared_windows(table(spark, sf_dir, "documents"))
