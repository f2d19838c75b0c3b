"""Removal of repeated byte strings with a column-wise built suffix order.

A byte goes if a string of ``LENGTH`` bytes covering it also starts earlier (in
a smaller doc_id, or earlier in the same document).

1. Every window of LENGTH bytes is named by its minimizer (``minimizers``); the
   runs of windows sharing one, *pieces*, are short strings, and equal windows
   lie in pieces of the same minimizer.  Minimizers that occur once anywhere
   (``anchors.repeated``) hold no repeats, and their pieces go no further.
2. The other pieces are packed per batch and bucket and meet by minimizer.
   Equal pieces are one string with its first place; all later ones are
   repeats altogether.
3. The distinct pieces of a minimizer are split by a longer common part (the
   minimizer and ``REACH`` bytes on its left or right, one of which every
   window has), and of the parts that several strings share, the collection's
   Burrows-Wheeler order is built column by column (``bwt``).  Neighbours in
   that order with a common prefix of LENGTH bytes are equal windows; all but
   the first place are repeats.
4. Repeated runs go back to their documents.

The collection is external in Spark's sense: pieces lie in shuffle files, each
task reads its buckets in order and sorts collections of ``COLLECTION`` bytes.

Defined results: null text is empty; rows repeating both doc_id and text are
judged alike (neither is earlier); a null doc_id comes last; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import anchors as A
from vigil.llm.base import partitions, query, table
from vigil.llm.bwt import equal_prefix, sorted_suffixes
from vigil.llm.minimizers import pieces
from vigil.llm.text import count_by_row, mix, slices

LENGTH = 100
GRAM = 32                    # bytes of a minimizer
REACH = (LENGTH - GRAM) // 2
COLLECTION = 256 << 10       # bytes of strings sorted at a time
_RUN = np.dtype([("start", "<u4"), ("n", "<u4")])


def _chosen(buf, offs, idents, own, n_buckets):
    """Identity, row, start, windows and minimizer offset of every piece with a reported minimizer."""
    h, row, start, n, off = pieces(buf, offs, LENGTH, GRAM)
    ident = A.identity(h, n_buckets)
    tag = lambda i, r: mix(i ^ (r.astype(np.uint64) << np.uint64(40)))
    told = np.repeat(np.arange(len(own) - 1), np.diff(own))
    at = np.flatnonzero(np.isin(tag(ident, row), tag(idents, told)))
    return ident[at], row[at], start[at], n[at], off[at]


def _runs(start, n) -> np.ndarray:
    """Runs of n windows from start on."""
    out = np.empty(len(start), _RUN)
    out["start"], out["n"] = start, n
    return out


def _firsts(group: np.ndarray, nid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (group, nid, start); in that order, whether a row is at its group's first place and where groups begin."""
    order = np.lexsort((start, nid, group))
    g, a, b = group[order], nid[order], start[order]
    begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    size = np.diff(np.r_[begin, len(g)])
    lead = np.repeat(begin, size)
    return order, (a == a[lead]) & (b == b[lead]), begin


def _repeats_inside(strings: list[bytes], nid, tie, start) -> tuple:
    """Windows of distinct strings that start earlier in another one: (nid, tie, start) with runs of them."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    who, at = sorted_suffixes(data, ends, LENGTH)
    same = equal_prefix(data, ends[who] + at, LENGTH)
    group = np.cumsum(np.r_[0, ~same])
    order, first, _ = _firsts(group, nid[who], start[who] + at)
    late = order[~first]
    late = late[np.lexsort((at[late], who[late]))]
    w, s = who[late], at[late]
    begin = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (s[1:] != s[:-1] + 1)]) if len(w) else w
    return w[begin], s[begin], np.diff(np.r_[begin, len(w)])


def _split(strings, off, n):
    """Parts of pieces whose windows hold the bytes left (or right) of the minimizer: (piece, from, to window, common part)."""
    for i, (s, o, k) in enumerate(zip(strings, off, n)):
        if o >= REACH:
            yield i, 0, min(k - 1, o - REACH), b"l" + s[o - REACH:o + GRAM]
        if k > o - REACH + 1:
            a = max(0, o - REACH + 1)
            yield i, a, k - 1, b"r" + s[o:o + GRAM + LENGTH - GRAM - REACH]


def _meet_pieces(nid, tie, start, n, off, ident, body, found: A.Findings) -> None:
    """All entries of one task: reports the repeated runs among them."""
    ids: dict = {}
    content = np.fromiter((ids.setdefault((i, b), len(ids)) for i, b in zip(ident.tolist(), body)), np.int64, len(body))
    order, first, begin = _firsts(content, nid, start)
    late = order[~first]
    found.add(nid[late], tie[late], _runs(start[late], n[late]))
    lead = order[begin]                                 # one entry per distinct piece, at its first place
    # every entry at a first place (several only if rows repeat a doc_id) shares the fate of its windows
    stay = order[first]
    owner = content[stay]
    entries = np.argsort(owner, kind="stable")
    stay, owner_ends = stay[entries], np.searchsorted(owner[entries], np.arange(len(lead) + 1))
    del ids
    o = ident[lead]
    by = np.argsort(o, kind="stable")
    alone = np.r_[True, o[by][1:] != o[by][:-1]] & np.r_[o[by][1:] != o[by][:-1], True]
    several = by[~alone]
    if not len(several):
        return
    # split by longer common parts; equal parts are one string again
    part_ids: dict = {}
    group, piece, low, high = [], [], [], []
    for i, a, b, key in _split([body[x] for x in lead[several]], off[lead[several]].tolist(), n[lead[several]].tolist()):
        group.append(part_ids.setdefault(key, len(part_ids)))
        piece.append(several[i])
        low.append(a)
        high.append(b)
    del part_ids
    group, piece, low, high = (np.array(x, np.int64) for x in (group, piece, low, high))
    texts = [body[x][a:b + LENGTH] for x, a, b in zip(lead[piece].tolist(), low.tolist(), high.tolist())]
    ids = {}
    same = np.fromiter((ids.setdefault(t, len(ids)) for t in texts), np.int64, len(texts))
    p_nid, p_start = nid[lead[piece]], start[lead[piece]] + low

    def report(part, first_window, count):
        take = piece[part]
        at = A.expand(owner_ends, take)
        reps = np.diff(owner_ends)[take]
        e = stay[at]
        found.add(nid[e], tie[e], _runs(start[e] + np.repeat(low[part] + first_window, reps), np.repeat(count, reps)))
    order, first, begin = _firsts(same, p_nid, p_start)
    late = order[~first]
    report(late, np.zeros(len(late), np.int64), high[late] - low[late] + 1)
    # of a part found at one place by several pieces (rows repeating a doc_id) all entries follow the lead
    kin = np.repeat(order[begin], np.diff(np.r_[begin, len(order)]))
    twins = np.flatnonzero(first & (order != kin))
    lead_part = order[begin]
    lead_part = lead_part[np.argsort(group[lead_part], kind="stable")]
    g = group[lead_part]
    many = ~(np.r_[True, g[1:] != g[:-1]] & np.r_[g[1:] != g[:-1], True])
    lead_part = lead_part[many]
    follow: dict = {}
    for t in twins.tolist():
        follow.setdefault(int(kin[t]), []).append(int(order[t]))
    size = high[lead_part] - low[lead_part] + LENGTH
    edge = np.flatnonzero(np.r_[True, group[lead_part][1:] != group[lead_part][:-1]]) if len(lead_part) else np.zeros(0, np.int64)
    total = np.cumsum(size)
    a = 0
    while a < len(lead_part):                           # collections of whole groups, about COLLECTION bytes each
        limit = (total[a - 1] if a else 0) + COLLECTION
        later = edge[edge > a]
        fits = later[total[later - 1] <= limit]
        b = int(fits[-1]) if len(fits) else int(later[0]) if len(later) else len(lead_part)
        if total[-1] <= limit:
            b = len(lead_part)
        part = lead_part[a:b]
        w, s, count = _repeats_inside([texts[x] for x in part.tolist()], p_nid[part], None, p_start[part])
        report(part[w], s, count)
        for x, y, z in zip(part[w].tolist(), s.tolist(), count.tolist()) if follow else ():
            for twin in follow.get(x, ()):
                report(np.array([twin]), np.array([y]), np.array([z]))
        a = b


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Findings: runs of windows of ``docs`` (nid, tie, text) that start earlier elsewhere."""
    n_buckets = A.buckets(docs.sparkSession)

    def kernel(buf, offs):
        return pieces(buf, offs, LENGTH, GRAM)[:2]

    def send(batch, idents, own):
        pack = zstandard.ZstdCompressor(level=1)
        nid, tie = A.rows_of(batch)
        parts, body = [], []
        for i, j, buf, offs in slices(batch):
            ident, row, start, n, off = _chosen(buf, offs, idents[own[i]:own[j]], own[i:j + 1] - own[i], n_buckets)
            a = offs[:-1][row] + start
            raw = buf.tobytes()
            body += [raw[x:y] for x, y in zip(a.tolist(), (a + n + LENGTH - 1).tolist())]
            parts.append((ident, row + i, start, n, off))
        ident, row, start, n, off = (np.concatenate(x) for x in zip(*parts))
        if not len(ident):
            return
        # equal pieces of this batch: only those at the first place travel
        ids: dict = {}
        content = np.fromiter((ids.setdefault(b, len(ids)) for b in body), np.int64, len(body))
        order, first, _ = _firsts(content, nid[row], start)
        late = order[~first]
        if len(late):
            late = late[np.argsort(row[late], kind="stable")]
            yield A.pack(int(nid[0] % n_buckets), True, nid, tie, np.zeros(len(late), np.int64), row[late],
                         start=start[late].astype(np.uint32), n=n[late].astype(np.uint32),
                         **{c: np.zeros(len(late), "u1") for c in ("off", "ident", "body")})
        here = order[first]
        bucket = (ident >> np.uint64(32)).astype(np.int64)
        here = here[np.lexsort((start[here], row[here], bucket[here]))]
        edge = np.flatnonzero(np.r_[True, bucket[here][1:] != bucket[here][:-1]])
        sent = A.pack(None, False, nid, tie, bucket[here], row[here], start=start[here].astype(np.uint32), n=n[here].astype(np.uint32),
                      off=off[here].astype(np.uint8), ident=(ident[here] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        bodies = [pack.compress(b"".join(body[k] for k in here[x:y].tolist())) for x, y in zip(edge, np.r_[edge[1:], len(here)])]
        yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(bodies, pa.binary())], names=[*sent.schema.names, "body"])

    def meet(batches):
        unpack = zstandard.ZstdDecompressor()
        seen, body, found = [], [], A.Findings()
        for batch in batches:
            for r in range(batch.num_rows):
                known = batch.column("known")[r].as_py()
                kinds = {"start": np.uint32, "n": np.uint32} | ({} if known else {"off": np.uint8, "ident": np.uint32})
                nids, ties, counts, start, n, *more = A.unpack(batch, r, **kinds)
                nid, tie = np.repeat(nids, counts), np.repeat(ties, counts)
                if known:
                    found.add(nid, tie, _runs(start, n))
                    continue
                ident = (np.uint64(batch.column("part")[r].as_py()) << np.uint64(32)) | more[1]
                seen.append((nid, tie, start.astype(np.int64), n.astype(np.int64), more[0].astype(np.int64), ident))
                raw = unpack.decompress(batch.column("body")[r].as_py())
                ends = np.r_[0, np.cumsum(n.astype(np.int64) + LENGTH - 1)].tolist()
                body += [raw[a:b] for a, b in zip(ends, ends[1:])]
        if seen:
            columns = [np.concatenate(x) for x in zip(*seen)]
            del seen
            _meet_pieces(*columns, body, found)
        yield from found.rows(n_buckets)

    found = A.repeated(docs, kernel)
    sent = A.beside(docs, found, send, A.sent_schema("start", "n", "off", "ident", "body"), np.uint64)
    return sent.repartition(partitions(docs.sparkSession), "part").mapInArrow(meet, A.FOUND)


def remove_repeated_bytes(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes)."""
    keyed = A.keyed(docs)
    schema = "nid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batch, runs, own):
        for i, j, buf, offs in slices(batch):
            mine = runs[own[i]:own[j]]
            at = mine["start"].astype(np.int64) + np.repeat(offs[:-1], np.diff(own[i:j + 1]))
            step = np.zeros(len(buf) + 1, np.int32)
            np.add.at(step, at, 1)
            np.add.at(step, at + mine["n"] + LENGTH - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            inner = offs[(offs > 0) & (offs < len(buf))]
            head[inner] = gone[inner]
            removed = count_by_row(gone, offs)
            kept = buf[~gone].tobytes()
            ends = np.r_[0, np.cumsum(np.diff(offs) - removed)].tolist()
            texts = [kept[a:b] for a, b in zip(ends, ends[1:])]
            cols = [batch.column("nid").slice(i, j - i), pa.array(np.diff(offs)), pa.array(removed), pa.array(count_by_row(head, offs)),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(texts, pa.binary())] if with_bytes else []), names=names)
    out = A.beside(keyed, repeated_runs(keyed), run, schema, _RUN)
    return out.select(F.when(F.col("nid") != A.NO_ID, F.col("nid")).alias("doc_id"), *names[1:])


@query("op2_suffix_dedup")
def suffix_dedup(spark, sf_dir):
    """Bytes of every document outside strings of 100 bytes that start earlier."""
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))
