"""Approximate nearest neighbours: random-projection hashing with multi-probe.

``tables`` hash tables cut space by ``hashes`` random directions each; a row's key in a table is
the slab it lies in along every direction.  A query looks into its own bucket and into those one
slab up or down along one direction (2 * hashes more), so few tables are needed.  Slabs are made
as wide as leaves about ``per_bucket`` rows in a bucket if rows were spread evenly, whatever n is.

Rows travel by cell: ``SPAN`` slabs along every direction of a table, so most probes of a query end in one cell.
References of a task that share a cell travel as one row (up to ``TASK_VALUES`` numbers of a task are sorted by cell together, so that
rows stay long when there are many cells), their vectors compressed dimension by dimension.  Tables are searched one after the other:
what a table shuffles is gone before the next.  A cell is one Arrow group, or dealt to (query block, reference block) groups if it is long: a bucket holding a third of
all rows is many groups.  Inside, a query meets its own bucket first; a bucket beyond a border that is farther than the
k-th neighbour so far holds nothing nearer and is passed over.  A query leaves a group as one list of neighbours.
Only recall is approximate: every distance returned is exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vigil.operators.neighbors import DEFAULT_VECTOR_BLOCK, _flat, _rank, _vectors, best_pairs
from vigil.session import attach_scalars, materialize

#: Slabs of a cell along a direction (a power of two), and numbers of a block of rows.
_BITS = 2
SPAN = 1 << _BITS
BLOCK_VALUES = 400_000
#: References that travel as one row at most, and numbers of a task's references that are sorted by cell together.
PACK, TASK_VALUES = 2048, 4_000_000
#: Queries of a group that are searched at once.
_CHUNK = 8192


@dataclass(frozen=True)
class Tables:
    """Directions [table][hash][dimension], shifts [table][hash] in slabs, and the width of a slab."""
    directions: tuple
    shifts: tuple
    width: float


def directions(dim: int, tables: int, hashes: int, seed: int = 42) -> tuple[tuple, tuple]:
    """Unit directions and shifts, rounded so that any engine can be given the same numbers."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(tables, hashes, dim))
    a /= np.linalg.norm(a, axis=2, keepdims=True)
    b = rng.uniform(size=(tables, hashes))
    return tuple(tuple(tuple(float(x) for x in h) for h in t) for t in np.round(a, 9)), tuple(tuple(float(x) for x in t) for t in np.round(b, 9))


def _project(vec: str, a) -> F.Column:
    return reduce(lambda x, y: x + y, [F.element_at(vec, i + 1) * F.lit(c) for i, c in enumerate(a)])


def fit(refs: DataFrame, vec: str, dim: int, tables: int = 4, hashes: int = 3, per_bucket: float = 400.0, seed: int = 42) -> Tables:
    """Hash tables for ``refs``: directions by seed, slab width from the spread of the projections (one aggregation)."""
    a, b = directions(dim, tables, hashes, seed)
    spread = reduce(lambda x, y: x + y, [F.stddev_pop(_project(vec, h)) for t in a for h in t]) / (tables * hashes)
    row = refs.agg(spread.alias("spread"), F.count(F.lit(1)).alias("n")).first()
    # 4 standard deviations hold most rows: (4 spread / width) ** hashes buckets of per_bucket rows
    width = 4.0 * (row["spread"] or 0.0) * (per_bucket / max(row["n"], per_bucket)) ** (1.0 / hashes)
    return Tables(a, b, round(width, 6) or 1.0)


def _slabs(x: np.ndarray, t: Tables, table: int) -> np.ndarray:
    """Slab of every row along every direction of a table; sums in the order of the dimensions, as any engine takes them."""
    out = np.empty((len(x), len(t.shifts[table])), np.int64)
    for j, (a, b) in enumerate(zip(t.directions[table], t.shifts[table])):
        along = reduce(lambda u, v: u + v, [x[:, c] * w for c, w in enumerate(a)])
        out[:, j] = np.clip(np.floor(along / t.width + b), -2.0 ** 62, 2.0 ** 62)
    return out


def _cells(slab: np.ndarray, probes: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the cell of every row's own bucket, and with ``probes`` the others that hold one of its probes."""
    cell, place = slab >> _BITS, slab & (SPAN - 1)
    rows, cells = [np.arange(len(slab))], [cell]
    for j in range(slab.shape[1] * probes):                              # a probe leaves the cell from its first or last slab only
        for edge, step in ((0, -1), (SPAN - 1, 1)):
            i = np.flatnonzero(place[:, j] == edge)
            moved = cell[i]
            moved[:, j] += step
            rows.append(i)
            cells.append(moved)
    return np.concatenate(rows), np.concatenate(cells)


def _keys(t: Tables) -> list[str]:
    return ["table", *[f"cell{j}" for j in range(len(t.shifts[0]))]]


def _gathered(batches, dim: int):
    """Arrow batches put together up to ``TASK_VALUES`` numbers."""
    held: list = []
    for batch in batches:
        if held and (sum(b.num_rows for b in held) + batch.num_rows) * dim > TASK_VALUES:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _placed(batches, t: Tables, probes: bool, only: int | None = None):
    """(rows, their vectors, table, slabs, cells) of the batches for every table (or one); rows with missing numbers are left out."""
    for rows_ in (pa.Table.from_batches([b]) for b in batches) if probes else _gathered(batches, len(t.directions[0][0])):
        if not rows_.num_rows:
            continue
        x = _vectors(rows_)
        whole = ~np.isnan(x).any(axis=1)
        rows_, x = (rows_, x) if whole.all() else (rows_.filter(pa.array(whole)), x[whole])
        for i in (range(len(t.shifts)) if only is None else [only]) if len(x) else []:
            slab = _slabs(x, t, i)
            rows, cells = _cells(slab, probes)
            yield rows_.take(pa.array(rows)) if probes else rows_, x, i, slab[rows], cells


def bucketed(rows: DataFrame, t: Tables, probes: bool = False, only: int | None = None) -> DataFrame:
    """``rows`` (rid, vec) by table (or for ``only`` one) and cell0, cell1, ...: rows of one task and cell travel together, ``PACK`` at
    most, as the array rid and ``vecs``, their vectors (``_packed``).

    ``probes``: every row alone, with vec, once per cell that holds its own bucket or one of its probes, with its slabs.
    """
    keys, h, rid = _keys(t), len(t.shifts[0]), rows.schema["rid"].dataType
    places = [T.StructField("table", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in keys[1:]]]
    schema = T.StructType([T.StructField("rid", rid), T.StructField("vec", T.ArrayType(T.DoubleType())), *places, T.StructField("slab", T.ArrayType(T.LongType()))]
                          if probes else [T.StructField("rid", T.ArrayType(rid)), T.StructField("vecs", T.BinaryType()), *places])
    arrow = to_arrow_schema(schema)
    lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)

    def run(batches):
        for some, x, table, slab, cells in _placed(batches, t, probes, only):
            n = len(slab)
            if probes:
                cols, tail = [_flat(some.column("rid")), _flat(some.column("vec"))], [lists(np.arange(n + 1) * h, pa.array(slab.ravel()))]
                slices = [slice(0, n)]
            else:
                order = np.lexsort(cells.T)
                cells = cells[order]
                new = np.r_[True, (cells[1:] != cells[:-1]).any(axis=1)]
                place = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
                start = np.flatnonzero(place % PACK == 0)
                ends, cells, x = np.r_[start, n], cells[start], x[order]
                vecs = pa.array([_packed(x[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary())
                cols, tail = [lists(ends, _flat(some.column("rid")).take(pa.array(order))), vecs], []
                slices = [slice(a, a + 1000) for a in range(0, len(start), 1000)]
            cols = [*cols, pa.array(np.full(len(cells), table, np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in cells.T], *tail]
            out = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)
            for a in slices:
                yield out.slice(a.start, a.stop - a.start)
    return rows.filter(F.col("vec").isNotNull()).mapInArrow(run, schema)


def _packed(x: np.ndarray) -> bytes:
    """Vectors as one compressed string, dimension by dimension."""
    return pa.compress(np.ascontiguousarray(x.T), codec="zstd", asbytes=True)


def _unpacked(vecs, sizes: np.ndarray, dim: int) -> np.ndarray:
    """The vectors of ``_packed`` strings of so many rows each."""
    parts = [np.frombuffer(pa.decompress(v.as_buffer(), 8 * int(n) * dim, codec="zstd"), float).reshape(dim, -1).T for v, n in zip(vecs, sizes)]
    return np.concatenate(parts)


def _sub(slab: np.ndarray) -> np.ndarray:
    """Place of a bucket in its cell as one number."""
    return ((slab & (SPAN - 1)) << (_BITS * np.arange(slab.shape[1]))).sum(axis=1)


def _cell_blocks(rows: DataFrame, t: Tables, probes: bool, block_rows: int, name: str) -> DataFrame:
    """(table, cell0, ..., ``name``): blocks of every cell that ``bucketed`` rows go to; a batch is counted where it lies."""
    keys = _keys(t)
    schema = T.StructType([T.StructField("table", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in [*keys[1:], "n"]]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for _, _, table, _, cells in _placed(batches, t, probes):
            c = pa.table({k: np.ascontiguousarray(v) for k, v in zip(keys[1:], cells.T)}).group_by(keys[1:], use_threads=False).aggregate([([], "count_all")])
            cols = [pa.array(np.full(len(c), table, np.int32)), *[_flat(c.column(k)) for k in [*keys[1:], "count_all"]]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)
    counts = rows.filter(F.col("vec").isNotNull()).mapInArrow(run, schema).groupBy(*keys)
    return counts.agg(F.ceil(F.sum("n") / F.lit(float(block_rows))).cast("int").alias(name))


def _cell_lists(queries: DataFrame, refs: DataFrame, k: int, t: Tables, exclude_self: bool, block_rows: int) -> DataFrame:
    """(rid, near): per query and table the nearest references of its probes, a sorted array of struct(d, nid)."""
    # written first: the size of the table of cells is known, the rows themselves move once
    blocks = materialize(_cell_blocks(queries, t, True, block_rows, "__nqb").join(_cell_blocks(refs, t, False, block_rows, "__nrb"), _keys(t)), "lsh-cells")
    best = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near")
    found = [_table_lists(queries, refs, blocks.filter(F.col("table") == i), k, t, i, exclude_self).groupBy("rid").agg(best) for i in range(len(t.shifts))]
    return reduce(DataFrame.unionByName, [materialize(f, "lsh-lists") for f in found])


def _table_lists(queries: DataFrame, refs: DataFrame, blocks: DataFrame, k: int, t: Tables, only: int, exclude_self: bool) -> DataFrame:
    """(rid, near): per query and group of one table the nearest references of its probes."""
    keys = _keys(t)
    queries, refs = bucketed(queries, t, True, only), bucketed(refs, t, False, only)
    blk = lambda n: F.pmod(F.xxhash64(F.col("rid"), F.lit(11)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    qx = attach_scalars(queries, blocks, keys).withColumn("__qb", blk("__nqb")).withColumn("__rb", every("__nrb")).drop("__nqb", "__nrb")
    rx = attach_scalars(refs, blocks, keys).withColumn("__rb", blk("__nrb")).withColumn("__qb", every("__nqb")).drop("__nqb", "__nrb")
    near = T.ArrayType(T.StructType([T.StructField("d", T.DoubleType()), T.StructField("nid", refs.schema["rid"].dataType.elementType)]))
    out_schema = T.StructType([T.StructField("rid", queries.schema["rid"].dataType), T.StructField("near", near)])
    arrow, h = to_arrow_schema(out_schema), len(t.shifts[0])

    def meet(qt: pa.Table, rt: pa.Table) -> pa.Table:
        if not qt.num_rows or not rt.num_rows:
            return arrow.empty_table()
        x, packs = _vectors(qt), _flat(rt.column("rid"))
        rids, table, *cell = packs.flatten(), *[rt.column(c)[0].as_py() for c in keys]
        y = _unpacked(_flat(rt.column("vecs")), np.diff(packs.offsets.to_numpy()), x.shape[1])
        qid, rid, sub = qt.column("rid").to_numpy(), rids.to_numpy(zero_copy_only=False), _sub(_slabs(y, t, table))
        place = pd.factorize(rid, sort=True)[0]
        slab = _flat(qt.column("slab")).flatten().to_numpy(zero_copy_only=False).reshape(-1, h)
        order = np.argsort(sub, kind="stable")
        found, first = np.unique(sub[order], return_index=True)
        members = dict(zip(found.tolist(), np.split(order, first[1:])))
        a, shift = np.array(t.directions[table]), np.array(t.shifts[table])
        # how far a row beyond the lower and the upper border of the own slab is at least, by direction
        low = (x @ a.T / t.width + shift - slab)
        slack = 1e-9 * (np.abs(slab) + 1.0)
        reach = t.width / np.linalg.norm(a, axis=1)
        borders = {-1: (low - slack) * reach, 1: (1.0 - low - slack) * reach}

        def visit(at, target, bound):
            """(query, reference, distance) of the nearest in the bucket that each query of ``at`` aims at."""
            aim = _sub(target)
            by = np.argsort(aim, kind="stable")
            aims, start = np.unique(aim[by], return_index=True)
            res = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for bucket, rows in zip(aims.tolist(), np.split(by, start[1:])):
                m = members.get(bucket)
                if m is not None:
                    i, j, d = best_pairs(x[at[rows]], y[m], qid[at[rows]], rid[m], k, 2.0, exclude_self, bound=None if bound is None else bound[rows])
                    res.append((at[rows[i]], m[j], d))
            return [np.concatenate(c) for c in zip(*res)]
        sizes, pairs = [], []
        for s in range(0, len(x), _CHUNK):
            at = np.arange(s, min(len(x), s + _CHUNK))
            mine = at[((slab[at] >> _BITS) == cell).all(axis=1)]
            i, j, d = visit(mine, slab[mine], None)
            kth = np.full(len(x), np.inf)
            full = _rank(i) == k - 1                                  # a bucket's lists are sorted by query and distance
            kth[i[full]] = d[full]
            ats, targets = [], []
            for c in range(h):
                for step, border in borders.items():
                    target = slab[at].copy()
                    target[:, c] += step
                    go = ((target >> _BITS) == cell).all(axis=1) & ~(border[at, c] > kth[at] * (1 + 1e-9))
                    ats.append(at[go])
                    targets.append(target[go])
            ats = np.concatenate(ats)
            more = visit(ats, np.concatenate(targets), kth[ats])
            i, j = np.r_[i, more[0]], np.r_[j, more[1]]
            d = np.sqrt(sum((x[i, c] - y[j, c]) ** 2 for c in range(x.shape[1])))    # the same number in whatever table a pair meets
            ranked = np.lexsort((place[j], d, i))
            ranked = ranked[_rank(i[ranked]) < k]
            sizes.append(np.bincount(i[ranked] - s, minlength=len(at)))
            pairs.append((j[ranked], d[ranked]))
        j, d = [np.concatenate(c) for c in zip(*pairs)]
        ends = np.r_[0, np.cumsum(np.concatenate(sizes))]
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(d), rids.take(pa.array(j))], names=["d", "nid"]))
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip([qt.column("rid"), lists], arrow)], schema=arrow)
    grp = [*keys, "__qb", "__rb"]
    return qx.groupBy(*grp).cogroup(rx.groupBy(*grp)).applyInArrow(meet, out_schema)


def knn_lsh(queries: DataFrame, refs: DataFrame, rid: str, vec: str, k: int, t: Tables, exclude_self: bool = True,
            block_rows: int = DEFAULT_VECTOR_BLOCK) -> DataFrame:
    """(rid, nid, d, rank): the k nearest references among a query's candidates, ties by id.

    A query with fewer than k candidates gets fewer rows.  A group holds ``block_rows`` references and queries, or up to
    ``BLOCK_VALUES`` numbers of each if that is more.
    """
    named = lambda df: df.select(F.col(rid).alias("rid"), F.col(vec).cast("array<double>").alias("vec"))
    lists = _cell_lists(named(queries), named(refs), k, t, exclude_self, max(block_rows, BLOCK_VALUES // len(t.directions[0][0])))
    # a neighbour is met once a table at most: the first k * tables hold k different ones if there are so many
    first = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k * len(t.shifts))
    best = lists.groupBy("rid").agg(F.slice(F.array_distinct(first), 1, k).alias("near"))
    ranked = best.select("rid", F.posexplode("near").alias("rank", "n")).select(
        "rid", F.col("n.nid").alias("nid"), F.col("n.d").alias("d"), (F.col("rank") + 1).alias("rank"))
    return ranked.withColumnRenamed("rid", rid) if rid != "rid" else ranked


def recall(found: DataFrame, exact: DataFrame, rid: str) -> DataFrame:
    """(queries, neighbours, found, recall): how many of the exact neighbours (rid, nid) were found."""
    hit = exact.select(rid, "nid").join(found.select(rid, "nid", F.lit(1).alias("hit")), [rid, "nid"], "left")
    return hit.agg(F.count_distinct(rid).alias("queries"), F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found")).select(
        "*", (F.col("found") / F.col("neighbours")).alias("recall"))
