"""Nearest-neighbour scores, LoOP and kNN classification.

* 1-D (F2): sort by value; the k nearest other rows are an interval around
  the row.  Rows are positioned by a range sort; inside (series, block) with a
  k-row halo the interval is found by bisection and sums over it (LoOP) come
  from prefix sums: O(n log k), every task bounded by block and halo.
* multi-d (F1): exact distances inside Voronoi cells (``operators.pivots``).
  Cells are dealt to hashed blocks; each (query block, reference block) pair
  is one bounded group in a cogrouped Arrow function that keeps only the k
  best per query row.  No pair is ever materialised as a row.
* Edges (rid, nid, d, rank) feed LoOP (F4) and the classifier (F19).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vigil.functions.columns import erf
from vigil.operators import manhattan
from vigil.operators.positions import DEFAULT_BLOCK_ROWS, row_index, with_halo
from vigil.session import attach_scalars, materialize

#: Rows per block of vectors: two blocks and their distances fit a task comfortably.
DEFAULT_VECTOR_BLOCK = 4096

# ---------------------------------------------------------------- 1-D (F2)


def knn_1d_candidates(df: DataFrame, keys: list[str], value: str, rid: str, k: int,
                      block: int = DEFAULT_BLOCK_ROWS, carry: tuple = ()) -> DataFrame:
    """Per row: sorted array of the k nearest others as struct(d, dp, np, nid).

    One sliding frame of +-k rows (in value order) gives the candidates;
    ties in distance are broken by position gap ``dp`` then position ``np``,
    which keeps the chosen set inside +-k positions.
    """
    keys = list(keys)
    base = df.select(*keys, rid, value, *carry).filter(F.col(value).isNotNull())
    pos = row_index(base, keys, [value, rid], "__vp")
    h = with_halo(pos, "__vp", block, k, k)
    w = Window.partitionBy(*keys, "_blk").orderBy("__vp").rowsBetween(-k, k)
    h = h.withColumn("__win", F.collect_list(F.struct(F.col("__vp").alias("p"), F.col(rid).alias("i"),
                                                      F.col(value).alias("v"))).over(w)).filter(F.col("_home"))
    me_p, me_v = F.col("__vp"), F.col(value)
    others = F.filter("__win", lambda x: x["p"] != me_p)
    cand = F.transform(others, lambda x: F.struct(F.abs(x["v"] - me_v).alias("d"),
                                                  F.abs(x["p"] - me_p).alias("dp"),
                                                  x["p"].alias("np"), x["i"].alias("nid")))
    out = h.withColumn("nbrs", F.slice(F.array_sort(cand), 1, k))
    return out.select(*keys, rid, value, *carry, F.col("__vp").alias("value_pos"), "nbrs")


def knn_score_1d(df: DataFrame, keys: list[str], value: str, rid: str, k: int,
                 block: int = DEFAULT_BLOCK_ROWS, out: str = "score", carry: tuple = ()) -> DataFrame:
    """distance to the k-th nearest other row.

    Every row stays: the score is null if the series is too short or the row has no value (such rows
    are nobody's neighbours).  ``carry`` names extra columns (e.g. the label) passed through unchanged.
    """
    c = intervals_1d(df, keys, value, rid, k, block, carry)
    kth = F.when(F.col("k") >= k, F.col("kth"))
    return c.select(*keys, rid, *carry, kth.alias(out)).unionByName(_valueless(df, [*keys, rid, *carry], value, out))


def nearest_intervals(v: np.ndarray, begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Start of each row's neighbour interval: rows start .. start + k are itself and its k nearest.

    ``v`` is sorted within groups; ``begin``/``end`` are the group's limits of each row.  Ties in distance go to the
    smaller gap in position, then to the smaller position.  All rows are searched together by bisection.
    """
    at = np.arange(len(v))
    lo, hi = np.maximum(begin, at - k), np.minimum(at, end - 1 - k)
    while True:
        mid = (lo + hi) // 2
        right = np.minimum(mid + k + 1, len(v) - 1)
        dl, dr = v - v[mid], v[right] - v
        move = (lo < hi) & ((dr < dl) | ((dr == dl) & (right - at < at - mid)))     # the row behind the interval is nearer
        if not (lo < hi).any():
            return lo
        hi = np.where((lo < hi) & ~move, mid, hi)
        lo = np.where(move, mid + 1, lo)


class _Chunks:
    """Rows of every group cut into chunks as long as an interval, ``size`` rows.

    An interval is then one chunk, or the end of one and the beginning of the next, so its sum is a running sum
    from a chunk's end plus one from a chunk's beginning: nothing is subtracted, no digits are lost.
    """

    def __init__(self, begin: np.ndarray, end: np.ndarray, size: np.ndarray):
        at = np.arange(len(begin))
        self.head = at - (at - begin) % size                      # first and last row of each row's chunk
        self.tail = np.minimum(self.head + size, end) - 1
        chunk = np.cumsum(at == self.head) - 1
        self.shape = (int(chunk[-1]) + 1 if len(at) else 0, int(size.max()) if len(at) else 1)
        self.place = chunk * self.shape[1] + (at - self.head)

    def running(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        """Sums from the chunk's first row to each row (``back``: from each row to the chunk's last)."""
        flat = np.zeros(self.shape[0] * self.shape[1], x.dtype)
        flat[self.place] = x
        flat = flat.reshape(self.shape)
        flat = np.cumsum(flat[:, ::-1], axis=1)[:, ::-1] if back else np.cumsum(flat, axis=1)
        return flat.ravel()[self.place]


def interval_stats(v, begin, end, k, extent: float | None = None):
    """k-th neighbour distance of sorted rows; with ``extent`` also pdist and the neighbours' mean pdist (LoOP)."""
    lo = nearest_intervals(v, begin, end, k)
    hi = lo + k
    kth = np.maximum(v - v[lo], v[hi] - v)
    if extent is None:
        return kth, None, None
    chunks = _Chunks(begin, end, k + 1)
    two = chunks.head[hi] > lo                                     # the interval begins in the chunk before
    total = np.zeros(len(v))
    # squares around a value of the interval itself: the last of its first part, the first of its second
    for back, where, ref, rows in ((True, lo, v[chunks.tail], chunks.tail[lo] - lo + 1), (False, hi, v[chunks.head], hi - chunks.head[hi] + 1)):
        y = v - ref
        shift = ref[where] - v
        part = chunks.running(y * y, back)[where] + 2 * shift * chunks.running(y, back)[where] + rows * shift * shift
        total += np.where(two, part, 0.0) if back else part
    kk = np.maximum(k, 1)
    pdist = extent * np.sqrt(np.maximum(total, 0.0) / kk)
    wide = pdist.astype(np.longdouble)                             # a row far away is much larger than its neighbours' sum
    around = np.where(two, chunks.running(wide, True)[lo], 0) + chunks.running(wide)[hi]
    return kth, pdist, ((around - wide) / kk).astype(float)


def intervals_1d(df: DataFrame, keys: list[str], value: str, rid: str, k: int, block: int = DEFAULT_BLOCK_ROWS,
                 carry: tuple = (), extent: float | None = None) -> DataFrame:
    """Rows with a value, with k (their neighbours: fewer in a short series), kth, pdist and ev.

    In value order the k nearest rows of a row are an interval around it: its start is found by bisection, sums over
    it come from prefix sums.  Memory per row does not depend on k; a task holds a block and a halo of k rows (2k for
    LoOP, whose neighbours' own intervals are needed too).
    """
    keys = list(keys)
    base = df.select(*keys, rid, F.col(value).cast("double").alias("__v"), *carry).filter(F.col("__v").isNotNull())
    pos = row_index(base, keys, ["__v", rid], "__vp")
    n = (pos.groupBy(*keys) if keys else pos).agg(F.count(F.lit(1)).alias("__n"))
    pos = attach_scalars(pos, n, keys)
    reach = (2 if extent is not None else 1) * (k + 1)
    h = with_halo(pos, "__vp", block, reach, reach).withColumn("k", F.least(F.lit(int(k)).cast("long"), F.col("__n") - 1)).drop("__n")
    h = h.repartition(*keys, "_blk").sortWithinPartitions(*keys, "_blk", "__vp")
    kept = [*keys, rid, *carry]
    kinds = {f.name: f.dataType.simpleString() for f in h.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", k long, kth double, pdist double, ev double"

    def run(batches):
        held: list = []

        def scored(pdf):
            v, kk = pdf["__v"].to_numpy(dtype=float), pdf["k"].to_numpy()
            begin_of = np.flatnonzero(changes(pdf))
            size = np.diff(np.r_[begin_of, len(pdf)])
            begin, end = np.repeat(begin_of, size), np.repeat(begin_of + size, size)
            kk = np.minimum(kk, end - begin - 1)                   # only halo rows can lack neighbours here
            kth, pdist, ev = interval_stats(v, begin, end, kk, extent)
            out = pdf[kept].assign(k=pdf["k"], kth=kth, pdist=pdist, ev=ev)
            return out[pdf["_home"].to_numpy(dtype=bool)]

        def changes(pdf):
            new = np.zeros(len(pdf), bool)
            new[:1] = True
            for c in [*keys, "_blk"]:
                x = pdf[c]
                same = (x.eq(x.shift())) | (x.isna() & x.shift().isna())
                new |= ~same.to_numpy(dtype=bool)
            new[:1] = True
            return new
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) < 200_000:
                continue
            pdf = pd.concat(held, ignore_index=True)
            last = int(np.flatnonzero(changes(pdf))[-1])           # the last group may go on
            if last:
                yield scored(pdf.iloc[:last].reset_index(drop=True))
            held = [pdf.iloc[last:]]
        if held and sum(map(len, held)):
            yield scored(pd.concat(held, ignore_index=True))
    return h.mapInPandas(run, schema)


def _valueless(df: DataFrame, cols: list[str], value: str, out: str) -> DataFrame:
    """Rows without a value, with a null score."""
    return df.filter(F.col(value).isNull()).select(*cols, F.lit(None).cast("double").alias(out))


def edges_1d(df, keys, value, rid, k, block=DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Neighbour edges (keys, rid, nid, d, rank) for 1-D data."""
    c = knn_1d_candidates(df, keys, value, rid, k, block)
    e = c.select(*keys, rid, F.posexplode("nbrs").alias("rank", "n"))
    return e.select(*keys, rid, F.col("n.nid").alias("nid"), F.col("n.d").alias("d"),
                    (F.col("rank") + 1).alias("rank"))


# ---------------------------------------------------------- multi-d (F1)


#: Queries and references whose distances are held at once.
_QUERY_CHUNK, _REF_CHUNK = 128, 2048


def _vectors(t: pa.Table, name: str = "vec") -> np.ndarray:
    """A list column as a matrix, without one object per row."""
    v = t.column(name).combine_chunks()
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)


def _flat(c) -> pa.Array:
    """A column as one array."""
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) and c.num_chunks else pa.array([], c.type) if isinstance(c, pa.ChunkedArray) else c


def _exact_pairs(q: np.ndarray, r: np.ndarray, p: float) -> np.ndarray:
    """Minkowski distances of the rows of q and r in pairs."""
    diff = q - r
    if p == 2:
        return np.sqrt(np.einsum("ij,ij->i", diff, diff))
    diff = np.abs(diff)
    return diff.sum(axis=1) if p == 1 else (diff ** p).sum(axis=1) ** (1.0 / p)


def _few_copies(r: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """Rows of r, in order of ``place``, without all but the first ``most`` of equal rows (the others are nobody's choice)."""
    bits = np.ascontiguousarray(r + 0.0).view(np.uint64)
    factors = np.random.default_rng(7).integers(0, 1 << 63, r.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = bits ^ (bits >> np.uint64(29))
    h = (mixed * factors).sum(axis=1, dtype=np.uint64)
    order = np.lexsort((place, h))
    new = np.r_[True, (h[order[1:]] != h[order[:-1]]) | (r[order[1:]] != r[order[:-1]]).any(axis=1)]
    start = np.flatnonzero(new)
    nth = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
    kept = order[nth < most]
    return kept[np.argsort(place[kept], kind="stable")]


def _rank(i: np.ndarray) -> np.ndarray:
    """Place of each row among those of the same i (sorted)."""
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
    return np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))


def best_pairs(q: np.ndarray, r: np.ndarray, qid: np.ndarray, rid: np.ndarray, k: int, p: float = 2.0, exclude_self: bool = True,
               far: bool = False, bound: np.ndarray | None = None):
    """(qi, ri, d): the k nearest rows of r to every row of q, ties to the smaller id (``far``: farthest, greater id; p = 2).

    ``bound`` gives distances beyond which (``far``: below which) a query needs nothing.  Distances of a chunk of
    queries and a chunk of references are held at once, never more.  They are estimated first (p = 2: one matrix product;
    p = 1: small integers for many rows (``operators.manhattan``), else single precision); pairs that may be among the k best within the estimate's error are measured exactly,
    so results do not depend on it.
    """
    both = pd.factorize(rid, sort=True)[0]
    place = -both if far else both
    need = k + int(exclude_self)
    kept = _few_copies(r, place, need)
    r, rid, place = r[kept], rid[kept], place[kept]
    if p == 1 and not far:
        bounds = None if bound is None else (np.where(np.isnan(bound), np.inf, bound) * (1 + 1e-9), np.full(len(r), np.inf))
        met = manhattan.nearest(q, r, qid, rid, np.arange(len(q)), place, k, exclude_self, False, bounds)
        if met is not None:
            return met[0][0], kept[met[0][1]], met[0][2]
    dim, sign = r.shape[1], -1.0 if far else 1.0
    if p == 2:
        qsq, rsq = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", r, r)
        left = np.concatenate([-2.0 * sign * q, np.full((len(q), 1), sign)], axis=1)
        right = np.ascontiguousarray(np.concatenate([r, rsq[:, None]], axis=1).T)
        offset = sign * qsq                                            # estimate + offset = signed squared distance
        error = lambda rows, cut: 1e-9 * np.abs(cut + offset[rows]) + 1e-12 * (qsq[rows] + rsq.max())
        target = lambda rows, d: sign * d * d - offset[rows]
        kind, q_chunk = np.float64, _QUERY_CHUNK
    else:
        single = p == 1 and max(np.abs(q).max(initial=0), np.abs(r).max(initial=0)) < 1e30
        kind, q_chunk = (np.float32 if single else np.float64), 64
        left, right = q.astype(kind), np.ascontiguousarray(r.T.astype(kind))
        norm = np.abs(q).sum(axis=1) + np.abs(r).sum(axis=1).max(initial=0)
        error = lambda rows, cut: np.finfo(kind).eps * (dim + 8) * p * (np.abs(cut) + (norm[rows] if p == 1 else 0.0))
        target = lambda rows, d: d if p == 1 else d ** p
        spare = np.empty((q_chunk, min(_REF_CHUNK, len(r))), kind)
    space = np.empty((q_chunk, min(_REF_CHUNK, len(r))), kind)

    def estimate(s, e, t, u):
        out = space[:e - s, :u - t] if u - t == space.shape[1] else np.empty((e - s, u - t), kind)
        if p == 2:
            return np.matmul(left[s:e], right[:, t:u], out=out)
        out[:] = 0
        part = spare[:e - s, :u - t]
        for c in range(dim):
            np.subtract(left[s:e, c, None], right[c, None, t:u], out=part)
            np.abs(part, out=part)
            if p != 1:
                np.power(part, p, out=part)
            out += part
        return out
    res = []
    for s in range(0, len(q), q_chunk):
        e = min(len(q), s + q_chunk)
        rows = np.arange(s, e)
        limit = np.full(e - s, np.inf)
        if bound is not None:
            cut = target(rows, bound[s:e])
            limit = np.where(np.isnan(cut) | np.isinf(bound[s:e]), np.inf, cut + error(rows, cut))
        i, j, a = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        chunk, due = 0, 1
        for t in range(0, len(r), _REF_CHUNK):
            u = min(len(r), t + _REF_CHUNK)
            est = estimate(s, e, t, u)
            if t == 0 and u > need and np.isinf(limit).any():
                cut = np.partition(est, need - 1, axis=1)[:, need - 1].astype(float)
                limit = np.minimum(limit, cut + error(rows, cut))
            found = np.flatnonzero(est <= limit[:, None].astype(kind) if kind is np.float64 else est <= np.nextafter(limit.astype(kind), np.float32(np.inf))[:, None])
            fi, fj = np.divmod(found, u - t)
            i, j, a = np.r_[i, fi], np.r_[j, fj + t], np.r_[a, est[fi, fj].astype(float)]
            chunk += 1
            if chunk == due or len(i) > 64 * need * q_chunk:           # what is farther than the k-th so far goes
                due = 2 * chunk
                order = np.lexsort((a, i))
                i, j, a = i[order], j[order], a[order]
                kth = np.flatnonzero(_rank(i) == need - 1)
                limit[i[kth]] = np.minimum(limit[i[kth]], a[kth] + error(rows[i[kth]], a[kth]))
                near = a <= limit[i]
                i, j, a = i[near], j[near], a[near]
        near = a <= limit[i]
        if exclude_self:
            near &= qid[s + i] != rid[j]
        i, j = i[near], j[near]
        d = _exact_pairs(q[s + i], r[j], p)
        if bound is not None:                                          # the bound itself may be rounded
            b = bound[s + i]
            ok = np.isnan(b) | ((d >= b - 1e-9 * (np.abs(b) + 1.0)) if far else (d <= b + 1e-9 * (np.abs(b) + 1.0)))
            i, j, d = i[ok], j[ok], d[ok]
        order = np.lexsort((place[j], sign * d, i))
        i, j, d = i[order], j[order], d[order]
        top = _rank(i) < k
        res.append((s + i[top], kept[j[top]], d[top]))
    return [np.concatenate(c) for c in zip(*res)]


def block_edges(queries: DataFrame, refs: DataFrame, keys: list[str], k: int, p: float = 2.0,
                block_rows: int = DEFAULT_VECTOR_BLOCK, exclude_self: bool = True, farthest: bool = False,
                partitions: int | None = None, ended=None, sized: bool = False) -> DataFrame:
    """(keys, rid, nid, d): at least the k nearest (or farthest) references of every query row (rid, vec) of the same keys.

    Per key, queries and references are dealt to hashed blocks of about ``block_rows`` rows each; every
    (query block, reference block) pair is one bounded group that returns at most k candidates per query row.  A column
    ``__bound`` of the queries is a distance beyond which (below which) a query needs nothing.
    ``partitions`` fixes the number of tasks: few large groups, whose work is not in their bytes.
    ``ended(key values, vectors, k-th distances)`` asks for one row per query and group instead: (keys, rid, vec, near, done), near a sorted
    array of struct(d, nid); done where the group holds all references of its key and ``ended`` agrees.
    ``sized`` writes the table of blocks first: its size is known, so that the rows move once.
    """
    keys = list(keys)
    names = [f.name for f in queries.schema.fields if f.name in keys]
    kinds = [queries.schema[c] for c in names]
    bounded = "__bound" in queries.columns
    # fresh aliases: queries and refs are often the same DataFrame (a self-join)
    q = queries.select(*[F.col(c).alias(c) for c in [*keys, "rid", "vec"] + ["__bound"] * bounded])
    r = refs.select(*[F.col(c).alias(c) for c in keys], F.col("rid").alias("rid"), F.col("vec").alias("vec"))

    def blocks(df, name):
        n = (df.groupBy(*keys) if keys else df).agg(F.count(F.lit(1)).alias("__n"))
        return n.select(*keys, F.greatest(F.lit(1), F.ceil(F.col("__n") / F.lit(float(block_rows)))).cast("int").alias(name))
    nq, nr = blocks(q, "__nqb"), blocks(r, "__nrb")
    nb = nq.join(nr, keys) if keys else nq.withColumn("__nrb", nr.select("__nrb").scalar())   # keys without references drop out
    nb = materialize(nb, "knn-blocks") if sized else nb
    q, r = attach_scalars(q, nb, keys), attach_scalars(r, nb, keys)
    blk = lambda n: F.pmod(F.xxhash64(F.col("rid"), F.lit(11)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    qx = q.withColumn("__qb", blk("__nqb")).withColumn("__rb", every("__nrb")).drop("__nqb", "__nrb")
    if ended:
        qx = q.withColumn("__qb", blk("__nqb")).withColumn("__rb", every("__nrb")).withColumn("__whole", F.col("__nrb") == 1).drop("__nqb", "__nrb")
    rx = r.withColumn("__rb", blk("__nrb")).withColumn("__qb", every("__nqb")).drop("__nqb", "__nrb")
    out_schema = T.StructType(kinds + [T.StructField("rid", queries.schema["rid"].dataType),
                                       T.StructField("nid", refs.schema["rid"].dataType), T.StructField("d", T.DoubleType())])
    if ended:
        near = T.ArrayType(T.StructType([T.StructField("d", T.DoubleType()), T.StructField("nid", refs.schema["rid"].dataType)]))
        out_schema = T.StructType(kinds + [T.StructField("rid", queries.schema["rid"].dataType), T.StructField("vec", T.ArrayType(T.DoubleType())),
                                           T.StructField("near", near), T.StructField("done", T.BooleanType())])
    grp = keys + ["__qb", "__rb"]
    if partitions:
        qx, rx = qx.repartition(partitions, *grp), rx.repartition(partitions, *grp)
    arrow = to_arrow_schema(out_schema)

    def best(qt: pa.Table, rt: pa.Table) -> pa.Table:
        if not qt.num_rows or not rt.num_rows:
            return arrow.empty_table()
        qid, rid = qt.column("rid").to_numpy(), rt.column("rid").to_numpy()
        bound = qt.column("__bound").to_numpy().astype(float) if bounded else None
        x = _vectors(qt)
        i, j, d = best_pairs(x, _vectors(rt), qid, rid, k, float(p), exclude_self and not farthest, farthest, bound)
        if ended:
            ends = np.r_[0, np.cumsum(np.bincount(i, minlength=len(x)))]
            full = np.diff(ends) >= k
            kth = np.full(len(x), np.inf)
            kth[full] = d[ends[1:][full] - 1]
            done = ended([qt.column(c)[0].as_py() for c in keys], x, kth) & qt.column("__whole")[0].as_py()
            pairs = pa.StructArray.from_arrays([pa.array(d), _flat(rt.column("rid").take(j))], names=["d", "nid"])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs)
            out = [*[pa.repeat(qt.column(c)[0], len(x)) for c in names], qt.column("rid"), qt.column("vec"), lists, pa.array(done)]
            return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(out, arrow)], schema=arrow)
        cols = [pa.repeat(qt.column(c)[0], len(i)) for c in names]
        out = [*cols, qt.column("rid").take(i), rt.column("rid").take(j), pa.array(d)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(out, arrow)], schema=arrow)
    return qx.groupBy(*grp).cogroup(rx.groupBy(*grp)).applyInArrow(best, out_schema)


def both_pairs(x: np.ndarray, y: np.ndarray, xid: np.ndarray, yid: np.ndarray, k: int, exclude_self: bool, bounds: tuple):
    """[(x row, y row, d), (y row, x row, d)]: ``best_pairs`` of two blocks both ways for p = 1, every pair met once."""
    ids = pd.factorize(np.concatenate([xid, yid]), sort=True)[0]
    xplace, yplace, need = ids[:len(x)], ids[len(x):], k + int(exclude_self)
    if len(_few_copies(x, xplace, need)) == len(x) and len(_few_copies(y, yplace, need)) == len(y):
        met = manhattan.nearest(x, y, xid, yid, xplace, yplace, k, exclude_self, True, bounds)
        if met is not None:
            return met
    return [best_pairs(x, y, xid, yid, k, 1.0, exclude_self, bound=bounds[0]), best_pairs(y, x, yid, xid, k, 1.0, exclude_self, bound=bounds[1])]


def block_edges_once(rows: DataFrame, keys: list[str], k: int, block_rows: int, exclude_self: bool, partitions: int) -> DataFrame:
    """``block_edges`` of ``rows`` (rid, vec, __bound) with themselves for p = 1: two blocks meet in one group, which serves the rows of both."""
    keys = list(keys)
    n = (rows.groupBy(*keys) if keys else rows).agg(F.count(F.lit(1)).alias("__n"))
    nb = n.select(*keys, F.greatest(F.lit(1), F.ceil(F.col("__n") / F.lit(float(block_rows)))).cast("int").alias("__nb"))

    def side():
        """Rows with their block; fresh aliases, as both sides are the same rows."""
        out = attach_scalars(rows.select(*[F.col(c).alias(c) for c in [*keys, "rid", "vec", "__bound"]]), nb, keys)
        return out.withColumn("__b", F.pmod(F.xxhash64(F.col("rid"), F.lit(11)), F.col("__nb")).cast("int"))
    names = [f.name for f in rows.schema.fields if f.name in keys]
    out_schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("rid", rows.schema["rid"].dataType),
                               T.StructField("nid", rows.schema["rid"].dataType), T.StructField("d", T.DoubleType())])
    arrow, grp = to_arrow_schema(out_schema), [*keys, "__qb", "__rb"]
    qx = side().withColumn("__qb", F.col("__b")).withColumn("__rb", F.explode(F.sequence(F.col("__b"), F.col("__nb") - 1)))
    rx = side().filter(F.col("__b") > 0).withColumn("__rb", F.col("__b")).withColumn("__qb", F.explode(F.sequence(F.lit(0), F.col("__b") - 1)))
    qx, rx = [t.select(*grp, "rid", "vec", "__bound").repartition(partitions, *grp) for t in (qx, rx)]

    def best(qt: pa.Table, rt: pa.Table) -> pa.Table:
        if not qt.num_rows or not rt.num_rows and qt.column("__qb")[0] != qt.column("__rb")[0]:
            return arrow.empty_table()
        numbers = lambda t: (_vectors(t), t.column("rid").to_numpy(), t.column("__bound").to_numpy().astype(float))
        x, qid, qb = numbers(qt)
        if rt.num_rows:
            y, rid, rb = numbers(rt)
            met = [(qt, rt), (rt, qt)], both_pairs(x, y, qid, rid, k, exclude_self, (qb, rb))
        else:                                                          # a block with itself
            met = [(qt, qt)], [best_pairs(x, x, qid, qid, k, 1.0, exclude_self, bound=qb)]
        parts = []
        for (a, b), (i, j, d) in zip(*met):
            out = [*[pa.repeat(qt.column(c)[0], len(i)) for c in names], a.column("rid").take(i), b.column("rid").take(j), pa.array(d)]
            parts.append(pa.Table.from_arrays([c.cast(f.type) for c, f in zip(out, arrow)], schema=arrow))
        return pa.concat_tables(parts)
    return qx.groupBy(*grp).cogroup(rx.groupBy(*grp)).applyInArrow(best, out_schema)


def knn_edges(queries: DataFrame, refs: DataFrame, keys: list[str], rid: str, vec: str, k: int,
              p: float = 2.0, block_rows: int = DEFAULT_VECTOR_BLOCK, exclude_self: bool = True, written: bool = False) -> DataFrame:
    """Exact k nearest references of every query row: (keys, rid, nid, d, rank), ties by neighbour id.

    ``written``: the references are a written table, which may be read more than once as it is.

    A series of at most ``block_rows`` references is one cell.  A longer one is cut into the Voronoi cells of
    about sqrt(n) / 2 of its rows (``operators.pivots``), or in few dimensions into boxes (``operators.boxes``): a query first meets
    its own cell, which bounds its k-th distance, then only cells that can hold something nearer.
    """
    from vigil.operators import pivots
    keys = list(keys)
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x))           # rows with missing numbers have no neighbours
    named = lambda df: df.select(*keys, F.col(rid).alias("rid"), F.col(vec).alias("vec")).filter(whole)
    near = _nearest_lists(queries, refs, keys, rid, vec, k, p, block_rows, exclude_self, written)
    if near is not None:
        ranked = near.select(*keys, "rid", F.posexplode("near").alias("rank", "n")).select(
            *keys, "rid", F.col("n.nid").alias("nid"), F.col("n.d").alias("d"), (F.col("rank") + 1).alias("rank"))
        return ranked.withColumnRenamed("rid", rid) if rid != "rid" else ranked
    cand = pivots.candidates(named(queries), None if queries is refs else named(refs), keys, k, float(p), block_rows, exclude_self)
    w = Window.partitionBy(*keys, "rid").orderBy("d", "nid")
    ranked = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.withColumnRenamed("rid", rid) if rid != "rid" else ranked


def _nearest_lists(queries, refs, keys, rid, vec, k, p, block_rows, exclude_self, written=False) -> DataFrame | None:
    """(keys, rid, near) by boxes, if vectors have few dimensions and a series is longer than a block; else None."""
    from vigil.operators import boxes
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x))
    named = lambda df: df.select(*keys, F.col(rid).alias("rid"), F.col(vec).cast("array<double>").alias("vec")).filter(whole)
    given = named(refs)
    first = given.select(F.size("vec").alias("n")).head()
    if first is None or not 0 < first["n"] <= boxes.MAX_DIM:
        return None
    given = given if written else materialize(given, "knn-named")       # read for the sizes, the sample and the cells
    chosen = boxes.choose(given, keys, block_rows)
    if not chosen:
        return None
    same = queries is refs
    return boxes.nearest(given if same else named(queries), None if same else given, keys, k, float(p), block_rows, exclude_self, chosen)


def kth_distance(edges: DataFrame, keys: list[str], rid: str, k: int, out: str = "score") -> DataFrame:
    """F1 method='largest': distance to the k-th neighbour."""
    return edges.filter(F.col("rank") == k).select(*keys, rid, F.col("d").alias(out))


def knn_score(df: DataFrame, keys: list[str], rid: str, vec: str, k: int, p: float = 2.0,
              block_rows: int = DEFAULT_VECTOR_BLOCK, out: str = "score") -> DataFrame:
    """exact k-th neighbour distance for vector rows (self excluded).

    Rows with fewer than k other rows in their series are kept with a null score.
    """
    near = _nearest_lists(df, df, list(keys), rid, vec, k, p, block_rows, True)
    if near is not None:                                                # the k-th of each list, no edge is written out
        kth = near.select(*keys, F.col("rid").alias(rid), F.try_element_at("near", F.lit(k))["d"].alias(out))
        whole = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
        return kth.unionByName(df.filter(~whole).select(*keys, rid, F.lit(None).cast("double").alias(out)))
    e = knn_edges(df, df, keys, rid, vec, k, p, block_rows)
    rows = df.select(*[F.col(c).alias(c) for c in keys], F.col(rid).alias(rid))
    return rows.join(kth_distance(e, keys, rid, k, out), list(keys) + [rid], "left")


# ------------------------------------------------------------------- F4


def loop_from_edges(edges: DataFrame, keys: list[str], rid: str = "rid", extent: int = 3,
                    out: str = "score") -> DataFrame:
    """Local Outlier Probability (Kriegel et al., 2009) from neighbour edges.

    pdist = extent * sqrt(mean d^2 over the k neighbours);
    plof  = pdist / mean(pdist of the neighbours) - 1 (a zero mean counts as 1e-8);
    nplof = extent * sqrt(mean plof^2) over the series;
    LoOP  = max(0, erf(plof / (nplof * sqrt 2))), 0 when nplof = 0.
    The edge table feeds two branches, so it is written once first.
    """
    keys = list(keys)
    lists = edges.groupBy(*keys, rid).agg(F.collect_list(F.struct(F.col("d").alias("d"),
                                                                  F.col("nid").alias("nid"))).alias("nbrs"))
    return loop_from_lists(lists, keys, rid, extent, out)


def loop_from_lists(lists: DataFrame, keys: list[str], rid: str = "rid", extent: int = 3,
                    out: str = "score") -> DataFrame:
    """LoOP from per-row neighbour arrays ``nbrs`` (struct d, nid), k per row."""
    keys = list(keys)
    pd_ = materialize(lists.select(*keys, rid, "nbrs", _pdist(extent).alias("pdist")), "loop-pdist")
    nb = pd_.select(*keys, rid, F.explode(F.col("nbrs")["nid"]).alias("nid"))
    nb = nb.join(pd_.select(*keys, F.col(rid).alias("nid"), F.col("pdist").alias("__npd")), keys + ["nid"])
    ev = nb.groupBy(*keys, rid).agg(F.avg("__npd").alias("__ev"))
    pl = pd_.select(*keys, rid, "pdist").join(ev, keys + [rid], "left")   # no neighbours: kept, score null
    return _loop_scores(pl, keys, rid, extent, out)


def _pdist(extent) -> F.Column:
    """extent * root mean square distance of the neighbours ``nbrs``."""
    msq = F.try_divide(F.aggregate("nbrs", F.lit(0.0), lambda a, x: a + x["d"] * x["d"]), F.size("nbrs"))
    return F.lit(float(extent)) * F.sqrt(msq)


def _loop_scores(pl: DataFrame, keys: list[str], rid: str, extent, out: str) -> DataFrame:
    """LoOP from each row's pdist and the mean ``__ev`` of its neighbours' pdist."""
    ext = F.lit(float(extent))
    denom = F.when(F.col("__ev") == 0, F.lit(1e-8)).otherwise(F.col("__ev"))
    pl = pl.withColumn("plof", F.col("pdist") / denom - F.lit(1.0))
    g = pl.groupBy(*keys) if keys else pl
    npl = g.agg((ext * F.sqrt(F.avg(F.col("plof") * F.col("plof")))).alias("nplof"))
    pl = attach_scalars(pl, npl, keys)
    val = (F.when(F.col("plof").isNull(), F.lit(None).cast("double"))
            .when(F.col("nplof") > 0,
                  F.greatest(F.lit(0.0), erf(F.col("plof") / (F.col("nplof") * F.lit(math.sqrt(2.0))))))
            .otherwise(F.lit(0.0)))
    return pl.select(*keys, rid, val.alias(out))


def loop_1d(df, keys, value, rid, k=20, extent=3, block=DEFAULT_BLOCK_ROWS, out="score"):
    """F4 on one column: neighbours are intervals in value order (``intervals_1d``); no edge table, no join, any k."""
    keys = list(keys)
    ev = intervals_1d(df, keys, value, rid, k, block, extent=float(extent))
    none = F.lit(None).cast("double")
    ev = ev.select(*keys, rid, F.when(F.col("k") > 0, F.col("pdist")).otherwise(none).alias("pdist"),
                   F.when(F.col("k") > 0, F.col("ev")).otherwise(none).alias("__ev"))
    ev = materialize(ev, "loop-pdist")                              # feeds the series' nplof and the scores
    return _loop_scores(ev, keys, rid, extent, out).unionByName(_valueless(df, [*keys, rid], value, out))


def loop_vec_far(df, keys, rid, vec, drop: int, extent=3, block_rows=DEFAULT_VECTOR_BLOCK, out="score"):
    """F4 with k = n - ``drop`` neighbours: all rows of the series but the ``drop`` - 1 farthest ones.

    Sums over all rows come from the series' moments (count, sum and sum of squares of the vectors), so only the few
    farthest rows of every row are searched (``pivots.farthest``) and subtracted.
    """
    from vigil.operators import pivots
    keys = list(keys)
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x))
    rows = df.filter(whole).select(*keys, F.col(rid).alias("rid"), F.col(vec).alias("vec"))
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    mean = (rows.groupBy(*keys) if keys else rows).agg(
        F.count(F.lit(1)).alias("__n"), F.array(*[F.avg(F.element_at("vec", i + 1)) for i in range(width)]).alias("__mean"))
    # squares around the mean: no digits are lost to a far origin
    centred = attach_scalars(rows, mean, keys).withColumn("vec", F.zip_with("vec", "__mean", lambda x, m: x - m)).drop("__mean")
    sq = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    centred = materialize(centred.withColumn("__sq", sq), "loop-centred")
    spread = (centred.groupBy(*keys) if keys else centred).agg(F.sum("__sq").alias("__all"))
    far = materialize(pivots.farthest(centred.select(*keys, "rid", "vec"), keys, drop - 1, block_rows), "loop-far")
    gone = far.groupBy(*keys, "rid").agg(F.sum(F.col("d") * F.col("d")).alias("__gone"))
    near = attach_scalars(centred.select(*keys, "rid", "__n", "__sq"), spread, keys)
    near = near.join(_renamed(gone, keys), _same(keys), "left").drop(*[f"g_{c}" for c in [*keys, "rid"]])
    k = F.col("__n") - F.lit(drop)
    total = F.col("__n") * F.col("__sq") + F.col("__all") - F.coalesce("__gone", F.lit(0.0))
    near = near.select(*keys, "rid", "__n", (F.lit(float(extent)) * F.sqrt(F.greatest(total, F.lit(0.0)) / F.when(k > 0, k))).alias("pdist"))
    near = materialize(near, "loop-pdist")
    every = (near.groupBy(*keys) if keys else near).agg(F.sum("pdist").alias("__pd_all"))
    other = near.select(*[F.col(c).alias(f"n_{c}") for c in keys], F.col("rid").alias("n_rid"), F.col("pdist").alias("__n_pd"))
    on = F.col("nid") == F.col("n_rid")
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"n_{c}"))
    lost = far.join(other, on).groupBy(*keys, "rid").agg(F.sum("__n_pd").alias("__gone"))
    ev = attach_scalars(near, every, keys).join(_renamed(lost, keys), _same(keys), "left").drop(*[f"g_{c}" for c in [*keys, "rid"]])
    mean_pd = (F.col("__pd_all") - F.col("pdist") - F.coalesce("__gone", F.lit(0.0))) / F.when(k > 0, k)
    ev = materialize(ev.select(*keys, F.col("rid").alias(rid), "pdist", mean_pd.alias("__ev")), "loop-ev")
    scored = _loop_scores(ev, keys, rid, extent, out)
    return scored.unionByName(df.filter(~F.coalesce(whole, F.lit(False))).select(*keys, rid, F.lit(None).cast("double").alias(out)))


def _renamed(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.withColumnsRenamed({c: f"g_{c}" for c in [*keys, "rid"]})


def _same(keys: list[str]) -> F.Column:
    out = F.col("rid") == F.col("g_rid")
    for c in keys:
        out = out & F.col(c).eqNullSafe(F.col(f"g_{c}"))
    return out


def loop_vec(df, keys, rid, vec, k=20, extent=3, block_rows=DEFAULT_VECTOR_BLOCK, out="score"):
    return loop_from_edges(knn_edges(df, df, keys, rid, vec, k, 2.0, block_rows), keys, rid, extent, out)


# ------------------------------------------------------------------ F19


def knn_classify(train: DataFrame, test: DataFrame, keys: list[str], rid: str, vec: str, label: str,
                 k: int, p: float = 2.0, block_rows: int = DEFAULT_VECTOR_BLOCK, out: str = "pred") -> DataFrame:
    """majority label of the k nearest training rows (ties -> smallest label)."""
    keys = list(keys)
    e = knn_edges(test, train, keys, rid, vec, k, p, block_rows, exclude_self=False)
    lab = train.select(*keys, F.col(rid).alias("nid"), F.col(label).alias("__lab"))
    votes = e.join(lab, keys + ["nid"]).groupBy(*keys, rid, "__lab").agg(F.count(F.lit(1)).alias("__c"))
    best = votes.groupBy(*keys, rid).agg(F.max_by("__lab", F.struct(F.col("__c"), -F.col("__lab"))).alias(out))
    return best
