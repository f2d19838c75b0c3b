"""Exact nearest neighbours in few dimensions: cells of a k-d tree and the boxes around their rows.

1. A drawn sample of the references of every long series (about ``PER_CELL`` rows a cell, ``MAX_VALUES`` numbers at most) is
   split at medians; its tree sends every row to a cell of about a quarter of ``block_rows`` rows in log n steps.
2. Every query meets its own cell.  If its k-th distance there ends inside the cell's region, it is done and never moves again.
3. The others descend the tree into the boxes (least and greatest values of each cell's references) within their k-th distance,
   visit those cells, and their lists are merged.

A query travels as one list of neighbours, not as one row per neighbour.  Work grows like n log n plus the visits; a cell above
its block (equal rows cannot be split) is dealt to blocks.  In many dimensions every box is near: ``pivots`` serves those.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.columns import hash_unit
from vigil.operators import pivots as PV
from vigil.session import attach_scalars, materialize

#: Dimensions up to which cells are boxes.
MAX_DIM = 6
#: Sampled rows of a cell, and numbers of a sample at most.
PER_CELL, MAX_VALUES = 8, 2_000_000


class Tree:
    """Flat k-d tree: inner nodes have an axis and a level, leaves (axis -1) a cell with its region."""

    def __init__(self, sample: np.ndarray):
        axis, level, left, right, cell, low, high = [], [], [], [], [], [], []
        dim = sample.shape[1]
        stack = [(np.arange(len(sample)), np.full(dim, -np.inf), np.full(dim, np.inf), -1, 0)]
        while stack:
            rows, lo, hi, parent, side = stack.pop()
            me = len(axis)
            if parent >= 0:
                (right if side else left)[parent] = me
            x = sample[rows]
            spread = x.max(axis=0) - x.min(axis=0)
            a = int(spread.argmax())
            t = np.nan
            if len(rows) > PER_CELL and spread[a] > 0:
                v = np.sort(x[:, a])
                steps = np.flatnonzero(v[1:] > v[:-1])
                s = steps[np.abs(steps + 1 - len(v) / 2).argmin()]
                t = v[s] + (v[s + 1] - v[s]) / 2                       # between two values: rows do not lie on the border
                t = v[s + 1] if not v[s] < t <= v[s + 1] else t
            split = np.isfinite(t)
            axis.append(a if split else -1)
            level.append(t if split else 0.0)
            left.append(me)
            right.append(me)
            cell.append(-1 if split else len(low))
            if not split:
                low.append(lo)
                high.append(hi)
                continue
            below = x[:, a] < t
            upper, lower = hi.copy(), lo.copy()
            upper[a], lower[a] = t, t
            stack.append((rows[~below], lower, hi, me, 1))
            stack.append((rows[below], lo, upper, me, 0))
        self.axis, self.level, self.cell = np.array(axis, np.int32), np.array(level), np.array(cell, np.int32)
        self.child = np.array([left, right], np.int32).T.copy()
        self.low, self.high = np.array(low), np.array(high)               # regions of the cells

    def cells(self, x: np.ndarray) -> np.ndarray:
        node, at = np.zeros(len(x), np.int32), np.arange(len(x))
        while True:
            a = self.axis[node]
            below = np.where(a < 0, node, self.child[node, (x[at, np.maximum(a, 0)] >= self.level[node]).astype(int)])
            if (below == node).all():
                return self.cell[node]
            node = below

    def boxed(self, count, low, high):
        """The tree with the boxes around the rows of every node (count, least and greatest values per cell)."""
        n = len(self.axis)
        self.count, dim = count, low.shape[1]
        self.lo, self.hi = np.full((n, dim), np.inf), np.full((n, dim), -np.inf)
        leaf = self.axis < 0
        self.lo[leaf], self.hi[leaf] = low[self.cell[leaf]], high[self.cell[leaf]]
        for i in range(n - 1, -1, -1):                                    # children have larger numbers
            if not leaf[i]:
                self.lo[i], self.hi[i] = self.lo[self.child[i]].min(axis=0), self.hi[self.child[i]].max(axis=0)
        return self

    def inside(self, x: np.ndarray, cell: int, reach: np.ndarray) -> np.ndarray:
        """Which rows of a cell reach no border of its region (true for any p: a border is one coordinate away)."""
        gap = np.minimum(x - self.low[cell], self.high[cell] - x).min(axis=1)
        return gap > _wider(reach, x)

    def reached(self, x: np.ndarray, own: np.ndarray, bound: np.ndarray, need: int, p: float):
        """(query, cell) pairs: the other cells with a box within each query's bound."""
        open_ = np.flatnonzero(~np.isfinite(bound))
        bound = bound.copy()
        if len(open_) and self.count.sum() >= need:                       # enough references lie within the need-th of the greatest distances
            leaf = np.flatnonzero(self.axis < 0)
            leaf = leaf[self.count[self.cell[leaf]] > 0]
            step = max(1, 2_000_000 // (len(leaf) * x.shape[1]))
            for s in range(0, len(open_), step):
                y = x[open_[s:s + step], None, :]
                far = _norm(np.maximum(np.abs(y - self.lo[leaf]), np.abs(self.hi[leaf] - y)), p)
                order = np.argsort(far, axis=1)
                enough = (np.cumsum(self.count[self.cell[leaf]][order], axis=1) >= need).argmax(axis=1)
                bound[open_[s:s + step]] = np.take_along_axis(far, order, axis=1)[np.arange(len(far)), enough]
        limit = _wider(bound, x)
        q, node = np.arange(len(x)), np.zeros(len(x), np.int32)
        found = []
        while len(q):
            near = _norm(np.maximum(np.maximum(self.lo[node] - x[q], x[q] - self.hi[node]), 0.0), p) <= limit[q]
            q, node = q[near], node[near]
            leaf = self.axis[node] < 0
            c = self.cell[node[leaf]]
            other = c != own[q[leaf]]
            found.append((q[leaf][other], c[other]))
            q, node = np.repeat(q[~leaf], 2), self.child[node[~leaf]].ravel()
        return [np.concatenate(f) for f in zip(*found)]


def _norm(gap: np.ndarray, p: float) -> np.ndarray:
    return np.sqrt((gap * gap).sum(axis=-1)) if p == 2 else gap.sum(axis=-1) if p == 1 else (gap ** p).sum(axis=-1) ** (1.0 / p)


def _wider(bound: np.ndarray, x: np.ndarray) -> np.ndarray:
    return bound + 1e-9 * (bound + np.abs(x).max(axis=1) * 1e-3 + 1e-300)


def choose(refs: DataFrame, keys: list[str], block_rows: int) -> dict:
    """{key values: tree} of every series with more than ``block_rows`` references."""
    sizes = (refs.groupBy(*keys) if keys else refs).agg(F.count(F.lit(1)).alias("__n"), F.max(F.size("vec")).alias("__dim"))
    long = sizes.filter(F.col("__n") > block_rows)
    total = long.agg(F.sum(F.col("__n") * F.col("__dim"))).first()[0]
    if not total:
        return {}
    share = min(1.0, PER_CELL / max(1, block_rows // 4), MAX_VALUES / total)
    rated = attach_scalars(refs, long.select(*keys, F.col("__n")), keys) if keys else refs
    drawn = rated.filter(hash_unit("box", F.concat_ws("|", *[F.col(c).cast("string") for c in [*keys, "rid"]])) < F.lit(share))
    out: dict = {}
    for r in drawn.select(*keys, "vec").collect():                        # MAX_VALUES numbers expected at most
        out.setdefault(tuple(r[c] for c in keys), []).append(r["vec"])
    return {key: Tree(np.array(sorted(v), dtype=float)) for key, v in out.items()}


def assign(rows: DataFrame, keys: list[str], trees) -> DataFrame:
    """``rows`` (keys, rid, vec) plus cell (0 where a series has no tree)."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cell int"

    def run(batches):
        for pdf in batches:
            cell = np.zeros(len(pdf), np.int32)
            for key, at in PV._series(pdf, keys):
                tree = trees.value.get(PV._key(key))
                if tree is not None:
                    cell[at] = tree.cells(np.stack(pdf["vec"].iloc[at].to_numpy()).astype(float))
            yield pdf.assign(cell=cell)

    def run_one(batches):
        """One series: no object per row."""
        from vigil.operators.neighbors import _vectors
        for batch in batches:
            if batch.num_rows:
                cell = trees.value[()].cells(_vectors(pa.Table.from_batches([batch])))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])
    return rows.mapInPandas(run, kinds) if keys else rows.mapInArrow(run_one, kinds)


def nearest(queries: DataFrame, refs: DataFrame | None, keys: list[str], k: int, p: float, block_rows: int, exclude_self: bool,
            chosen: dict) -> DataFrame:
    """(keys, rid, near): every query's k nearest references as a sorted array of struct(d, nid); ``refs`` None: the queries."""
    from vigil.operators.neighbors import block_edges
    spark, keys = queries.sparkSession, list(keys)
    given, by_cell, need = queries if refs is None else refs, [*keys, "cell"], k + int(exclude_self)
    trees = spark.sparkContext.broadcast(chosen)
    r = materialize(assign(given, keys, trees), "knn-refs")
    q = r if refs is None else materialize(assign(queries, keys, trees), "knn-queries")
    dim = len(next(iter(chosen.values())).low[0])
    ends = [f(F.element_at("vec", i + 1)).alias(f"{n}{i}") for i in range(dim) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    cells: dict = {}
    for row in r.groupBy(*by_cell).agg(F.count(F.lit(1)).alias("n"), *ends).collect():                # one row per cell
        cells.setdefault(tuple(row[c] for c in keys), []).append(row)
    for key, tree in chosen.items():
        n = len(tree.low)
        count, low, high = np.zeros(n, np.int64), np.full((n, dim), np.inf), np.full((n, dim), -np.inf)
        for row in cells.get(key, []):
            c = row["cell"]
            count[c], low[c], high[c] = row["n"], [row[f"lo{i}"] for i in range(dim)], [row[f"hi{i}"] for i in range(dim)]
        tree.boxed(count, low, high)
    boxes = spark.sparkContext.broadcast(chosen)

    def ended(key, x, kth):
        """Which queries of one cell need no other cell."""
        tree = boxes.value.get(_plain(key[:-1]))
        return np.ones(len(x), bool) if tree is None else tree.inside(x, int(key[-1]), kth)
    # a cell is one block unless it is far larger than planned
    met = lambda g, e: block_edges(g, r, by_cell, k, p, 4 * block_rows, exclude_self, ended=e, sized=True)
    own = materialize(met(q, ended), "knn-own-cell")
    best = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near")
    left = own.filter(~F.col("done")).groupBy(*by_cell, "rid").agg(F.first("vec").alias("vec"), best)
    left = materialize(left.withColumn("__bound", F.try_element_at("near", F.lit(k))["d"]), "knn-pending")

    def visits(batches):
        for pdf in batches:
            for key, at in PV._series(pdf, keys):
                tree = boxes.value.get(PV._key(key))
                if tree is None:
                    continue
                for s in range(0, len(at), 4096):
                    part = pdf.iloc[at[s:s + 4096]]
                    bound = part["__bound"].to_numpy(dtype=float)
                    i, j = tree.reached(np.stack(part["vec"].to_numpy()).astype(float), part["cell"].to_numpy(),
                                        np.where(np.isnan(bound), np.inf, bound), need, p)
                    yield from PV._in_slices(part, i, j)
    src = left.select(*by_cell, "rid", "vec", "__bound")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    guests = materialize(src.mapInPandas(visits, kinds), "knn-visits")
    more = met(guests, lambda key, x, kth: np.zeros(len(x), bool))
    merged = left.select(*keys, "rid", "near").unionByName(more.select(*keys, "rid", "near")).groupBy(*keys, "rid").agg(best)
    return own.filter("done").select(*keys, "rid", "near").unionByName(merged)


def _plain(key) -> tuple:
    return tuple(None if x is None or x != x else x for x in key)
