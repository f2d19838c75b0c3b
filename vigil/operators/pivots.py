"""Exact nearest neighbours without all pairs: Voronoi cells and triangle-inequality bounds.

1. About sqrt(n) / 2 references of every long series, drawn by hash, are its pivots.  Each row goes
   to the cell of its nearest pivot.  Per cell the number of references and their least and
   greatest distance to the pivot are kept (one row per pivot).
2. Every query meets the references of its own cell.  Its k-th distance there, or what the cell
   statistics promise (enough references lie within |q p| + greatest distance), bounds its true
   k-th distance.
3. It then visits only cells that can hold something within the bound: a cell is left out if
   |q p| - greatest, least - |q p| or (p = 2) its distance to the bisecting plane is beyond it.

Work grows like n * sqrt(n) * (cells visited) instead of n^2.  The bounds are metric, so results
are exact for any p >= 1; in many dimensions without structure most cells stay within the bound.
A drawn sample of queries shows that, and then all blocks of rows meet (``direct``): n^2 distances (half of them for
p = 1 among one set of rows, ``direct_once``), but no query travels once per cell.  Pivots travel to the tasks: their number is limited to ``MAX_VALUES``
numbers altogether (fewer pivots make larger cells, never other results).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.columns import hash_unit
from vigil.session import attach_scalars, materialize

#: Numbers (pivots x dimensions) that are sent to every executor at most: 64 MB.
MAX_VALUES = 8_000_000
_STEP = 2_000_000            # distances held at once
_SLACK = 1e-9


def distances(x: np.ndarray, y: np.ndarray, p: float) -> np.ndarray:
    """All Minkowski distances between the rows of x and y (a few million at most)."""
    if p == 2:
        sq = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None, :] - 2.0 * (x @ y.T)
        return np.sqrt(np.maximum(sq, 0.0))
    out, step = np.zeros((len(x), len(y))), max(1, 32_768 // max(len(y), 1))
    for s in range(0, len(x), step):                                   # a piece that stays in the cache
        for c in range(x.shape[1]):
            d = np.abs(x[s:s + step, c, None] - y[None, :, c])
            out[s:s + step] += d if p == 1 else d ** p
    return out if p == 1 else out ** (1.0 / p)


def choose(refs: DataFrame, keys: list[str], block_rows: int) -> dict:
    """{key values: pivots as a matrix} of every series with more than ``block_rows`` references."""
    sizes = (refs.groupBy(*keys) if keys else refs).agg(F.count(F.lit(1)).alias("__n"), F.max(F.size("vec")).alias("__dim"))
    long = sizes.filter(F.col("__n") > block_rows)
    total = long.agg(F.sum(F.sqrt("__n") * F.col("__dim"))).first()[0]
    if not total:
        return {}
    # expected number of pivots: sqrt(n) / 2, less where all of them would be too many
    share = F.lit(min(0.5, MAX_VALUES / total)) / F.sqrt("__n")
    rated = attach_scalars(refs, long.select(*keys, share.alias("__share")), keys) if keys else \
        refs.withColumn("__share", long.select(share.alias("__share")).scalar())
    drawn = rated.filter(hash_unit("pivot", F.concat_ws("|", *[F.col(c).cast("string") for c in [*keys, "rid"]])) < F.col("__share"))
    out: dict = {}
    for r in drawn.select(*keys, "vec").distinct().collect():            # MAX_VALUES numbers expected at most
        out.setdefault(tuple(r[c] for c in keys), []).append(r["vec"])
    return {key: np.array(sorted(v), dtype=float) for key, v in out.items()}


def _series(pdf: pd.DataFrame, keys: list[str]):
    """(key values, row places) of a batch."""
    if not keys:
        return [((), np.arange(len(pdf)))]
    return [(key if isinstance(key, tuple) else (key,), at) for key, at in pdf.groupby(keys, sort=False, dropna=False).indices.items()]


def _key(key: tuple) -> tuple:
    return tuple(None if x is None or x != x else x.item() if hasattr(x, "item") else x for x in key)


def assign(rows: DataFrame, keys: list[str], pivots, p: float) -> DataFrame:
    """``rows`` (keys, rid, vec) plus cell and the distance to its pivot (cell 0 where a series has no pivots)."""
    def run(batches):
        for pdf in batches:
            cell, dist = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            for key, at in _series(pdf, keys):
                y = pivots.value.get(_key(key))
                if y is None:
                    continue
                x = np.stack(pdf["vec"].iloc[at].to_numpy()).astype(float)
                step = max(1, _STEP // len(y))
                for s in range(0, len(x), step):
                    d = distances(x[s:s + step], y, p)
                    c = d.argmin(axis=1)
                    cell[at[s:s + step]], dist[at[s:s + step]] = c, d[np.arange(len(c)), c]
            yield pdf.assign(cell=cell, dist=dist)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{kinds}, cell int, dist double")


def _reachable(x: np.ndarray, own: np.ndarray, bound: np.ndarray, y: np.ndarray, stats: dict, need: int, p: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, cell) pairs: the cells each query must visit besides its own."""
    d = distances(x, y, p)
    far, near, count = stats["far"], stats["near"], stats["count"]
    limit = bound.copy()
    open_ = np.flatnonzero(~np.isfinite(bound))
    if len(open_) and count.sum() >= need:
        # enough references lie within the need-th of these distances
        reach = np.where(count[None, :] > 0, d[open_] + far[None, :], np.inf)
        order = np.argsort(reach, axis=1)
        enough = (np.cumsum(count[order], axis=1) >= need).argmax(axis=1)
        limit[open_] = np.take_along_axis(reach, order, axis=1)[np.arange(len(open_)), enough]
    limit = limit + _SLACK * (limit + d.max(axis=1) + 1.0)
    visit = (d - far[None, :] <= limit[:, None]) & (near[None, :] - d <= limit[:, None]) & (count[None, :] > 0)
    visit[np.arange(len(x)), own] = False
    i, j = np.nonzero(visit)
    if p == 2:                                                     # the plane halfway between the pivots
        gap = y[own[i]] - y[j]
        apart = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        mine = d[np.arange(len(x)), own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d[i, j] ** 2 - mine[i] ** 2) / (2.0 * apart)
        keep = (apart == 0) | (plane <= limit[i])
        i, j = i[keep], j[keep]
    return i, j


#: Rows farthest from the mean whose distances give every row a first bound of its farthest ones.
HUBS = 2048


def _far_direct(rows: DataFrame, keys: list[str], m: int, block_rows: int) -> DataFrame:
    """Candidates of the m farthest rows by all blocks; the m-th greatest distance to the rows farthest from the mean bounds them."""
    from vigil.operators.neighbors import block_edges
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    stats = (rows.groupBy(*keys) if keys else rows).agg(F.count(F.lit(1)).alias("__n"), F.array(*[F.avg(F.element_at("vec", i + 1)) for i in range(width)]).alias("__mean"))
    stats = materialize(stats, "far-means")
    longest = stats.agg(F.max("__n")).first()[0] or 1
    out = attach_scalars(rows, stats, keys).withColumn("__out", F.aggregate(F.zip_with("vec", "__mean", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda t, x: t + x))
    out = materialize(out.select(*keys, "rid", "vec", "__out"), "far-from-mean")
    share = max(0.0, 1.0 - max(HUBS, 4 * m) / longest)
    level = (out.groupBy(*keys) if keys else out).agg(F.percentile_approx("__out", share, 10_000).alias("__level"))
    hubs = materialize(attach_scalars(out, level, keys).filter(F.col("__out") >= F.col("__level")).select(*keys, "rid", "vec"), "far-hubs")
    first = block_edges(rows, hubs, keys, m, 2.0, max(block_rows, HUBS), farthest=True)
    first = first.groupBy(*keys, "rid").agg(F.sort_array(F.collect_list("d"), asc=False).alias("__d"))
    first = first.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("rid").alias("__rid"), F.try_element_at("__d", F.lit(m)).alias("__bound"))
    here = F.col("rid").eqNullSafe(F.col("__rid"))
    for c in keys:
        here = here & F.col(c).eqNullSafe(F.col(f"__{c}"))
    bounded = materialize(rows.join(first, here, "left").select(*keys, "rid", "vec", "__bound"), "far-bounded")
    return direct(bounded, rows, keys, m, 2.0, block_rows, False, farthest=True)


def farthest(rows: DataFrame, keys: list[str], m: int, block_rows: int) -> DataFrame:
    """(keys, rid, nid, d): the m farthest rows of every row (rid, vec), Euclidean, ties to the greater id.

    The same cells, bounds turned round: m rows lie at least |q p| - greatest away, and a cell is visited only if
    |q p| + greatest reaches that far.  If that leaves more than ``DIRECT_SHARE`` of the rows, all blocks meet.
    """
    from pyspark.sql import Window

    from vigil.operators.neighbors import block_edges
    spark, keys = rows.sparkSession, list(keys)
    if m <= 0:
        return rows.select(*keys, "rid", F.col("rid").alias("nid"), F.lit(0.0).alias("d")).limit(0)
    chosen = choose(rows, keys, block_rows)
    if chosen:
        pivots = spark.sparkContext.broadcast(chosen)
        r = materialize(assign(rows, keys, pivots, 2.0), "far-rows")
        stats = spark.sparkContext.broadcast(_cell_stats(r, keys, chosen))

        def reached(pdf):
            """(rows, their series, row places, cells) of a batch, some rows at a time; no cells: a short series is one."""
            for key, at in _series(pdf, keys):
                part = pdf.iloc[at]
                y = pivots.value.get(_key(key))
                if y is None:
                    yield part, key, None, None
                    continue
                x, s = np.stack(part["vec"].to_numpy()).astype(float), stats.value[_key(key)]
                step = max(1, _STEP // len(y))
                for b in range(0, len(x), step):
                    d = distances(x[b:b + step], y, 2.0)
                    low = np.where(s["count"][None, :] > 0, d - s["far"][None, :], -np.inf)
                    order = np.argsort(-low, axis=1)
                    enough = np.cumsum(s["count"][order], axis=1) >= m
                    at_m = np.where(enough.any(axis=1), enough.argmax(axis=1), len(y) - 1)
                    promised = np.take_along_axis(low, order, axis=1)[np.arange(len(d)), at_m]
                    slack = _SLACK * (np.abs(promised) + d.max(axis=1) + 1.0)
                    reach = (d + s["far"][None, :] >= (promised - slack)[:, None]) & (s["count"][None, :] > 0)
                    i, j = np.nonzero(reach)
                    yield part, key, b + i, j

        def visits(batches):
            for pdf in batches:
                for part, _, i, j in reached(pdf):
                    if i is None:
                        yield part
                    else:
                        yield from _in_slices(part, i, j)

        def shares(batches):
            for pdf in batches:
                met = all_ = 0.0
                for part, key, i, j in reached(pdf):
                    if i is not None:
                        met += float(stats.value[_key(key)]["count"][j].sum())
                for key, at in _series(pdf, keys):
                    if _key(key) in stats.value:
                        all_ += float(stats.value[_key(key)]["count"].sum()) * len(at)
                yield pd.DataFrame({"met": [met], "all_": [all_]})
        src = r.drop("dist")
        probe = src.filter(hash_unit("probe", F.concat_ws("|", *[F.col(c).cast("string") for c in [*keys, "rid"]])) < F.lit(min(1.0, PROBES / max(r.count(), 1))))
        share = probe.mapInPandas(shares, "met double, all_ double").agg(F.sum("met") / F.sum("all_")).first()[0]
        if (share or 0.0) > DIRECT_SHARE:
            cand = _far_direct(rows, keys, m, block_rows)
        else:
            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
            guests = materialize(src.mapInPandas(visits, kinds), "far-visits")
            cand = block_edges(guests, r, [*keys, "cell"], m, 2.0, block_rows, farthest=True).drop("cell")
    else:
        cand = block_edges(rows, rows, keys, m, 2.0, block_rows, farthest=True)
    w = Window.partitionBy(*keys, "rid").orderBy(F.col("d").desc(), F.col("nid").desc())
    return cand.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= m).drop("__rank")


def _cell_stats(r: DataFrame, keys: list[str], chosen: dict) -> dict:
    """Per series with pivots: rows, least and greatest distance of every cell (one row per pivot is read)."""
    cells: dict = {}
    for row in r.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("near"), F.max("dist").alias("far")).collect():
        key = tuple(row[c] for c in keys)
        if key in chosen:
            n = len(chosen[key])
            s = cells.setdefault(key, {"count": np.zeros(n, np.int64), "near": np.zeros(n), "far": np.zeros(n)})
            s["count"][row["cell"]], s["near"][row["cell"]], s["far"][row["cell"]] = row["n"], row["near"], row["far"]
    return cells


#: Share of the references that a query may have to visit; above it all blocks meet all blocks.
DIRECT_SHARE = 0.2
#: Queries that are drawn to measure that share.
PROBES = 1000
#: Numbers of a block when all blocks meet (32 MB), and groups that the pairs of blocks make at least if rows suffice.
BLOCK_VALUES, GROUPS = 4_000_000, 64


def direct(queries: DataFrame, refs: DataFrame, keys: list[str], k: int, p: float, block_rows: int, exclude_self: bool,
           farthest: bool = False) -> DataFrame:
    """All blocks of queries meet all blocks of references: work n^2, each task bounded by two blocks.

    Blocks are as large as leaves ``GROUPS`` groups, so that rows travel few times.
    """
    from vigil.operators.neighbors import block_edges
    count = lambda df, name: (df.groupBy(*keys) if keys else df).agg(F.count(F.lit(1)).alias(name))
    nq, nr = count(queries, "__nq"), count(refs, "__nr")
    both = nq.join(nr, keys) if keys else nq.withColumn("__nr", nr.select("__nr").scalar())
    both = materialize(both, "knn-sizes")
    pairs = both.agg(F.sum(F.col("__nq").cast("double") * F.col("__nr"))).first()[0] or 0.0
    width = refs.agg(F.max(F.size("vec"))).first()[0] or 1
    rows = int(max(block_rows, min((pairs / GROUPS) ** 0.5, BLOCK_VALUES / width)))
    groups = both.agg(F.sum(F.ceil(F.col("__nq") / F.lit(float(rows))) * F.ceil(F.col("__nr") / F.lit(float(rows))))).first()[0]
    return block_edges(queries, refs, keys, k, p, rows, exclude_self, farthest, partitions=max(1, min(int(groups or 1), 20_000)))


#: Blocks that a long series is dealt to when its rows meet themselves, in blocks of at most so many rows and in larger ones.
FEW_BLOCKS, FULL_ROWS, MANY_BLOCKS = 11, 16_384, 16


def direct_once(rows: DataFrame, keys: list[str], k: int, block_rows: int, exclude_self: bool) -> DataFrame:
    """``direct`` of rows with themselves for p = 1: a distance serves both of its rows, so half the pairs of blocks meet.

    The k-th distance of every row among a drawn sample (about ``sqrt(90 k n)`` rows) bounds it in every block.
    """
    from vigil.operators.neighbors import best_pairs, block_edges_once
    spark = rows.sparkSession
    sizes = materialize((rows.groupBy(*keys) if keys else rows).agg(F.count(F.lit(1)).alias("__n"), F.max(F.size("vec")).alias("__dim")), "knn-sizes")
    longest, width = sizes.agg(F.max("__n"), F.max("__dim")).first()
    long = sizes.filter(F.col("__n") > block_rows)
    drawn = F.sqrt(F.col("__n") * F.lit(90.0 * k))
    total = long.agg(F.sum(drawn * F.col("__dim"))).first()[0] or 1.0
    share = F.least(F.lit(1.0), drawn * F.lit(min(1.0, MAX_VALUES / total)) / F.col("__n"))
    rated = attach_scalars(rows, long.select(*keys, share.alias("__share")), keys) if keys else rows.withColumn("__share", long.select(share.alias("__share")).scalar())
    sample: dict = {}
    named = F.concat_ws("|", *[F.col(c).cast("string") for c in [*keys, "rid"]])
    for r in rated.filter(hash_unit("bound", named) < F.col("__share")).select(*keys, "rid", "vec").collect():   # MAX_VALUES numbers expected at most
        sample.setdefault(tuple(r[c] for c in keys), []).append((r["rid"], r["vec"]))
    sample = spark.sparkContext.broadcast({key: (np.array([i for i, _ in v]), np.array([x for _, x in v], dtype=float)) for key, v in sample.items()})

    def bounds(batches):
        for pdf in batches:
            bound = np.full(len(pdf), np.inf)
            for key, at in _series(pdf, keys):
                ids, y = sample.value.get(_key(key), (None, None))
                if ids is None or not len(at):
                    continue
                part = pdf.iloc[at]
                i, _, d = best_pairs(np.stack(part["vec"].to_numpy()).astype(float), y, part["rid"].to_numpy(), ids, k, 1.0, exclude_self)
                full = np.flatnonzero(np.bincount(i, minlength=len(at)) == k)
                bound[at[full]] = d[np.cumsum(np.bincount(i, minlength=len(at)))[full] - 1]
            yield pdf.assign(__bound=bound)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    bounded = materialize(rows.repartition(4 * spark.sparkContext.defaultParallelism).mapInPandas(bounds, f"{kinds}, __bound double"), "knn-bounded")
    size = max(-(-longest // MANY_BLOCKS), min(-(-longest // FEW_BLOCKS), FULL_ROWS))
    size = int(max(block_rows, min(size, BLOCK_VALUES / width)))
    blocks = F.ceil(F.col("__n") / F.lit(float(size)))
    groups = sizes.agg(F.sum(blocks * (blocks + 1) / 2)).first()[0] or 1
    # few large groups: more tasks than groups, so that few tasks get two by their hash
    return block_edges_once(bounded, keys, k, size, exclude_self, partitions=max(1, min(3 * int(groups), 20_000)))


def _in_slices(part: pd.DataFrame, i: np.ndarray, j: np.ndarray):
    """Row i of ``part`` as a guest of cell j, a bounded number of rows at a time."""
    step = max(1, _STEP // 8 // len(part["vec"].iloc[0]))
    for s in range(0, len(i), step):
        yield part.iloc[i[s:s + step]].assign(cell=j[s:s + step].astype(np.int32))


def candidates(queries: DataFrame, refs: DataFrame | None, keys: list[str], k: int, p: float, block_rows: int,
               exclude_self: bool) -> DataFrame:
    """(keys, rid, nid, d): the k nearest references of every query row (rid, vec), and some that are farther.

    ``refs`` None: the queries are the references.  A few queries are searched first: if they must visit more than
    ``DIRECT_SHARE`` of the references, cells save nothing and all blocks meet (``direct``).
    """
    from vigil.operators.neighbors import block_edges
    spark, keys = queries.sparkSession, list(keys)
    given = queries if refs is None else refs
    chosen = choose(given, keys, block_rows)
    if not chosen:
        return block_edges(queries, given, keys, k, p, block_rows, exclude_self)
    pivots = spark.sparkContext.broadcast(chosen)
    # p = 1: many operations a row, whatever the files' splits
    r = materialize(assign(given.repartition(4 * spark.sparkContext.defaultParallelism) if p == 1 else given, keys, pivots, p), "knn-refs")
    by_cell = [*keys, "cell"]
    stats = spark.sparkContext.broadcast(_cell_stats(r, keys, chosen))
    need = k + int(exclude_self)

    def within_own(q):
        """Edges inside the queries' own cells, and the queries with the k-th distance there."""
        own = materialize(block_edges(q, r, by_cell, k, p, block_rows, exclude_self), "knn-own-cell")
        kth = own.groupBy(*by_cell, "rid").agg(F.sort_array(F.collect_list("d")).alias("__d"))    # k per reference block of the cell
        kth = kth.select(*[F.col(c).alias(f"__{c}") for c in by_cell], F.col("rid").alias("__rid"), F.try_element_at("__d", F.lit(k)).alias("__bound"))
        here = F.col("rid").eqNullSafe(F.col("__rid"))
        for c in by_cell:
            here = here & F.col(c).eqNullSafe(F.col(f"__{c}"))
        return own, q.join(kth, here, "left").select(*by_cell, "rid", "vec", "__bound")

    def reached(pdf):
        """(rows, their series, query places, cells) of a batch, some queries at a time."""
        for key, at in _series(pdf, keys):
            y = pivots.value.get(_key(key))
            if y is None:
                continue
            part = pdf.iloc[at]
            x = np.stack(part["vec"].to_numpy()).astype(float)
            cell, bound = part["cell"].to_numpy(), part["__bound"].to_numpy(dtype=float)
            bound = np.where(np.isnan(bound), np.inf, bound)
            step = max(1, _STEP // len(y))
            for s in range(0, len(x), step):
                i, j = _reachable(x[s:s + step], cell[s:s + step], bound[s:s + step], y, stats.value[_key(key)], need, p)
                yield part, key, s + i, j

    def visits(batches):
        for pdf in batches:
            for part, _, i, j in reached(pdf):
                yield from _in_slices(part, i, j)

    def shares(batches):
        for pdf in batches:
            met = sum(float(stats.value[_key(key)]["count"][j].sum()) for _, key, _, j in reached(pdf))
            all_ = sum(float(stats.value[_key(key)]["count"].sum()) * len(at) for key, at in _series(pdf, keys) if _key(key) in stats.value)
            yield pd.DataFrame({"met": [met], "all_": [all_]})
    rate = PROBES / max(queries.count(), 1)
    probe = queries.filter(hash_unit("probe", F.concat_ws("|", *[F.col(c).cast("string") for c in [*keys, "rid"]])) < F.lit(min(1.0, rate)))
    probe = materialize(assign(probe, keys, pivots, p), "knn-probes")
    share = within_own(probe)[1].mapInPandas(shares, "met double, all_ double").agg(F.sum("met") / F.sum("all_")).first()[0]
    if (share or 0.0) > DIRECT_SHARE:
        if refs is None and p == 1:
            return direct_once(queries, keys, k, block_rows, exclude_self)
        return direct(queries, given, keys, k, p, block_rows, exclude_self)
    q = r if refs is None else materialize(assign(queries, keys, pivots, p), "knn-queries")
    own, bounded = within_own(q)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bounded.schema.fields)
    guests = materialize(bounded.mapInPandas(visits, kinds), "knn-visits")
    other = block_edges(guests, r, by_cell, k, p, block_rows, exclude_self)
    return own.unionByName(other).drop("cell")
