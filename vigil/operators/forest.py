"""Isolation forests (Liu, Ting & Zhou, 2008) on Spark.

Every random choice is a hash (``functions.columns.hash_unit``: leading hex digits of an MD5) of
seed, tree, node or row key, so a forest is a pure function of its input and
can be computed by any engine, under any partitioning.

Fit
  1. One hash per row keeps a pool of about twice the rows all trees need.
  2. Tree t's sample is exactly the psi rows of the pool with the smallest
     hash of (seed, t, key).  Candidates are first filtered by a rate at which a tree
     gets at least psi of them but for odds below 1e-14 (the rate is lifted to 1 if one
     still has too few); the psi-th smallest hash is found by counting candidates per
     slice of the hash range, twice, and only the last slice is ranked.
  3. Nodes of more than ``SUBTREE_ROWS`` rows split level by level: per (tree, node) the least
     and greatest value of every feature (one aggregation with map-side combine), a hash picks a
     non-constant feature and a threshold between them, and rows move down by a join.  The
     subtree below a smaller node is grown at once, many of them together in one task, by the
     same hashes.  No task holds more than a bounded number of rows, so psi may be any
     number or fraction of the rows.

Several forests (folds, shares of features, sample sizes) grow together: ``grow`` takes rows of
many forests, and a smaller forest is the first trees of a larger one.

Score
  A forest of at most ``CHUNK_NODES`` nodes is sent to the tasks.  A larger one never is: rows and
  trees meet in (row block x tree block) groups, each adds up its path lengths, and one
  shuffle sums them per row.  Score = 2^(-E[h(x)]/c(psi)).
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.columns import hash_below, hash_hex, hash_unit, hex_unit
from vigil.session import materialize, shuffle_partitions, spread

#: Nodes that are sent to the executors at most (about 100 MB), and of one block of trees beyond (at least one tree).
CHUNK_NODES = 500_000
#: Rows of a block when rows and trees meet in groups.
ROW_BLOCK = 200_000
#: A node of at most so many rows is grown to its leaves in one task.
SUBTREE_ROWS = 20_000
#: Rows grown together in one step of a task.
BATCH_ROWS = 200_000
#: Candidates of one tree that a task holds at most when trees are grown and asked in one place (``fold_paths``).
TREE_ROWS = 500_000
#: Levels after which the moved rows are written; in between they are derived from the written node tables.
ROWS_EVERY = 3
#: Slices of the hash range in each of the two counting passes of the selection.
SLICES = 512
EULER_GAMMA = 0.5772156649015329
NODE_COLUMNS = ("tree", "node", "feature", "threshold", "left", "right", "size", "depth")


def _feature_subset(n_features: int, max_features: float) -> int:
    return max(1, int(round(max_features * n_features))) if max_features <= 1 else min(n_features, int(max_features))


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def sample_rows(df: DataFrame, rid, features: list[str], n_trees: int, psi: int, n: int, seed: int) -> DataFrame:
    """(tree, __h, __key, x): exactly psi rows per tree, those with the smallest hashes."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ([rid] if isinstance(rid, str) else rid)])
    base = df.select(key.alias("__key"), *[F.col(c).cast("double").alias(c) for c in features])
    rate = min(1.0, (2.0 * psi * n_trees + 1000.0) / max(n, 1))
    pool = base if rate >= 1.0 else base.filter(hash_below(hash_hex(seed, "pool", F.col("__key")), rate))
    pool = materialize(pool.repartition("__key"), "forest-pool")       # every pool row is hashed once per tree
    n_pool = pool.count()
    if n_pool < psi:
        pool, n_pool = base, n
    need = min(1.0, (psi + 8.0 * math.sqrt(psi) + 32.0) / max(n_pool, 1))
    for limit in dict.fromkeys((need, 1.0)):
        drawn = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
        drawn = drawn.withColumn("__hex", hash_hex(seed, F.col("tree"), F.col("__key"))).filter(hash_below(F.col("__hex"), limit))
        drawn = drawn.select("tree", hex_unit(F.col("__hex")).alias("__h"), "__key", F.array(*features).alias("x"))
        drawn = materialize(drawn, "forest-drawn")
        sample = smallest(drawn, ["tree"], psi, limit)
        short = drawn.groupBy("tree").count().agg(F.min("count"), F.count(F.lit(1))).first()
        if short[0] is not None and short[0] >= psi and short[1] == n_trees:
            break
    return sample


def smallest(drawn: DataFrame, keys: list[str], psi: int | str, limit: float = 1.0) -> DataFrame:
    """The psi rows of every group with the smallest (__h, __key, x), __h in [0, limit).

    ``psi`` is a number, or the name of a column that holds each group's number.

    The slice that holds the psi-th hash is found by counting, then a slice of that slice; rows below it are
    in, and only the rows of the last slice are ranked.  A group's rows are never sorted together.
    """
    first = F.least(F.floor(F.col("__h") / F.lit(limit) * SLICES), F.lit(SLICES - 1)).cast("int")
    inner = F.least(F.floor((F.col("__h") / F.lit(limit) * SLICES - F.col("__s1")) * SLICES), F.lit(SLICES - 1)).cast("int")
    d = drawn.withColumn("__s1", first).withColumn("__s2", inner)
    wanted, own = (F.col(psi), [psi]) if isinstance(psi, str) else (F.lit(psi), [])

    def cut(counted, by, slot, wanted):
        """Per group, the slot in which the count reaches ``wanted``, and the rows before it."""
        w = Window.partitionBy(*by).orderBy(slot)                 # SLICES rows at most
        c = counted.withColumn("__before", F.sum("n").over(w) - F.col("n"))
        return c.filter((F.col("__before") < wanted) & (F.col("__before") + F.col("n") >= wanted))
    one = cut(d.groupBy(*keys, *own, "__s1").agg(F.count(F.lit(1)).alias("n")), keys, "__s1", wanted)
    one = one.select(*keys, F.col("__s1").alias("__b1"), (wanted - F.col("__before")).alias("__rest"))
    in_one = d.join(one, keys).filter("__s1 = __b1")
    two = cut(in_one.groupBy(*keys, "__b1", "__rest", "__s2").agg(F.count(F.lit(1)).alias("n")), keys, "__s2", F.col("__rest"))
    two = materialize(two.select(*keys, "__b1", F.col("__s2").alias("__b2"), (F.col("__rest") - F.col("__before")).alias("__rest")), "forest-cuts")
    near = d.join(two, keys)
    below = near.filter("__s1 < __b1 OR (__s1 = __b1 AND __s2 < __b2)")
    ranked = near.filter("__s1 = __b1 AND __s2 = __b2").withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy("__h", "__key", "x")))
    return below.unionByName(ranked.filter("__rn <= __rest").drop("__rn")).select(*keys, "__h", "__key", "x")


@lru_cache(maxsize=1 << 16)
def _unit(text: str) -> float:
    """``hash_unit`` of the joined parts."""
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / (1 << 52)


@lru_cache(maxsize=1 << 14)
def _own_features(seed: int, tree: int, n_features: int, subset: int) -> np.ndarray:
    """Which features a tree may split (those with the smallest hashes)."""
    mine = np.zeros(n_features, bool)
    mine[[f for _, f in sorted((_unit(f"{seed}:features:{tree}:{f}"), f) for f in range(n_features))[:subset]]] = True
    return mine


def _decide(stats: DataFrame, n_features: int, seed: int) -> DataFrame:
    """Feature and threshold of every node of one level (feature -1: a leaf); ``limit`` and ``subset`` are its forest's."""
    idx = F.sequence(F.lit(0), F.lit(n_features - 1))
    ordered = F.array_sort(F.transform(idx, lambda f: F.struct(hash_unit(seed, "features", F.col("tree"), f).alias("h"), f.alias("f"))))
    own = F.when(F.col("subset") >= n_features, idx).otherwise(F.transform(F.slice(ordered, 1, F.col("subset")), lambda s: s["f"]))
    split = F.array_sort(F.filter(own, lambda f: F.element_at("hi", f + 1) > F.element_at("lo", f + 1)))
    out = stats.withColumn("__split", split)
    n = F.size("__split")
    pick = F.floor(hash_unit(seed, "feature", F.col("tree"), F.col("node")) * n).cast("int")
    inner = (F.col("size") > 1) & (n > 0) & (F.col("depth") < F.col("limit"))
    out = out.withColumn("feature", F.when(inner, F.element_at("__split", pick + 1)).otherwise(F.lit(-1)))
    lo, hi = (F.element_at(c, F.col("feature") + 1) for c in ("lo", "hi"))
    thr = F.when(inner, lo + hash_unit(seed, "threshold", F.col("tree"), F.col("node")) * (hi - lo)).otherwise(F.lit(0.0))
    none = F.lit(-1).cast("long")
    return out.select("forest", *NODE_COLUMNS[:2], "feature", thr.alias("threshold"), F.when(inner, 2 * F.col("node")).otherwise(none).alias("left"),
                      F.when(inner, 2 * F.col("node") + 1).otherwise(none).alias("right"), "size", "depth")


def grow_subtrees(forest, tree, node, depth, limit, subset, x, starts, seed: int) -> list[np.ndarray]:
    """All nodes below the given roots (one per start; their rows lie together in ``x``), one level of all per step.

    Returns the columns forest and ``NODE_COLUMNS``.
    """
    out = []
    while len(starts):
        size = np.diff(np.r_[starts, len(x)])
        lo, hi = np.minimum.reduceat(x, starts, axis=0), np.maximum.reduceat(x, starts, axis=0)
        open_ = hi > lo
        for i in np.flatnonzero(subset < x.shape[1]):
            open_[i] &= _own_features(seed, int(tree[i]), x.shape[1], int(subset[i]))
        inner = (size > 1) & open_.any(axis=1) & (depth < limit)
        feature, threshold = np.full(len(starts), -1), np.zeros(len(starts))
        for i in np.flatnonzero(inner):
            able = np.flatnonzero(open_[i])
            f = able[int(_unit(f"{seed}:feature:{tree[i]}:{node[i]}") * len(able))]
            feature[i] = f
            threshold[i] = lo[i, f] + _unit(f"{seed}:threshold:{tree[i]}:{node[i]}") * (hi[i, f] - lo[i, f])
        out.append((forest, tree, node, feature, threshold, np.where(inner, 2 * node, -1), np.where(inner, 2 * node + 1, -1), size, depth))
        at = np.repeat(np.arange(len(starts)), size)
        stay = inner[at]
        x, at = x[stay], at[stay]
        right = x[np.arange(len(x)), feature[at]] >= threshold[at]
        child = 2 * at + right
        order = np.argsort(child, kind="stable")
        x, child = x[order], child[order]
        starts = np.flatnonzero(np.r_[True, child[1:] != child[:-1]]) if len(child) else child[:0]
        mine, side = child[starts] // 2, child[starts] % 2
        forest, tree, depth, limit, subset, node = forest[mine], tree[mine], depth[mine] + 1, limit[mine], subset[mine], 2 * node[mine] + side
    return [np.concatenate(c) for c in zip(*out)] if out else []


_NODE_TYPES = "forest int, tree int, node long, feature int, threshold double, left long, right long, size long, depth int"
_NODE_ARROW = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())


def _finish(rows: DataFrame, seed: int) -> DataFrame:
    """Nodes of all subtrees below the nodes that ``rows`` (forest, tree, node, depth, limit, subset, x) lie in."""
    src = rows.select("forest", "tree", "node", "depth", "limit", "subset", "x")
    src = src.repartition("forest", "tree", "node").sortWithinPartitions("forest", "tree", "node")
    names = ["forest", *NODE_COLUMNS]

    def run(batches):
        held = None

        def grown(t):
            cols = [t.column(i).to_numpy() for i in range(6)]
            x = t.column("x").combine_chunks()
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            new = np.r_[True, np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)]
            starts = np.flatnonzero(new)
            forest, tree, node, depth, limit, subset = (c[starts].astype(np.int64) for c in cols)
            got = grow_subtrees(forest, tree, node, depth, limit, subset, x, starts, seed)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(got, _NODE_ARROW)], names=names)
        for batch in batches:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if held.num_rows < BATCH_ROWS:
                continue
            cols = [held.column(i).to_numpy() for i in range(3)]
            last = int(np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0))[-1]) + 1     # the last node may go on
            yield grown(held.slice(0, last))
            held = held.slice(last)
        if held is not None and held.num_rows:
            yield grown(held)
    return src.mapInArrow(run, _NODE_TYPES)


def grow(rows: DataFrame, n_features: int, largest: int, seed: int, subtree_rows: int | None = None) -> DataFrame:
    """Nodes (forest, tree, node, ...) of all trees of ``rows`` (forest, tree, limit, subset, x).

    ``limit`` is a forest's greatest depth, ``subset`` its features per tree; ``largest`` bounds the rows of a tree.
    """
    small = subtree_rows or SUBTREE_ROWS
    rows = rows.select("forest", "tree", F.lit(1).cast("long").alias("node"), F.lit(0).alias("depth"), "limit", "subset", "x")
    done, ready, level = [], [], 0
    while largest > small:
        extremes = [F.array(*[f(F.element_at("x", i + 1)) for i in range(n_features)]).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))]
        stats = rows.groupBy("forest", "tree", "node", "depth", "limit", "subset").agg(F.count(F.lit(1)).alias("size"), *extremes)
        nodes = materialize(_decide(stats, n_features, seed), "forest-level")
        most = nodes.agg(F.max("size")).first()[0]
        if most is None or most <= small:
            break
        named = nodes.select(F.col("forest").alias("f_"), F.col("tree").alias("t_"), F.col("node").alias("n_"), "feature", "threshold", "size")
        here = (F.col("forest") == F.col("f_")) & (F.col("tree") == F.col("t_")) & (F.col("node") == F.col("n_"))
        moved = rows.join(named, here).drop("f_", "t_", "n_")
        ready.append(moved.filter(F.col("size") <= small).select(*rows.columns))
        done.append(nodes.filter(F.col("size") > small))
        child = 2 * F.col("node") + (F.element_at("x", F.col("feature") + 1) >= F.col("threshold")).cast("long")
        rows = (moved.filter((F.col("size") > small) & (F.col("feature") >= 0))
                .select("forest", "tree", child.alias("node"), (F.col("depth") + 1).alias("depth"), "limit", "subset", "x"))
        if level % ROWS_EVERY == ROWS_EVERY - 1:      # lineage: at most so many joins with written node tables
            rows = materialize(rows, "forest-rows")
        level += 1
    for more in ready:
        rows = rows.unionByName(more)
    out = _finish(rows, seed)
    for nodes in done:
        out = out.unionByName(nodes.select(*[F.col(f.name).cast(f.dataType) for f in out.schema.fields]))
    return out


def iforest_fit(df: DataFrame, rid, features: list[str], n_trees: int = 100, max_samples: float = 256,
                seed: int = 42, max_features: float = 1.0, bootstrap: bool = False,
                n_rows: int | None = None, subtree_rows: int | None = None) -> tuple[DataFrame, int]:
    """returns (node table, psi).  ``max_samples`` <= 1 is a fraction of the rows; never cut.

    ``rid`` names the row key: one column, or the columns that together identify a row.  Nodes are
    numbered like a heap: the root is 1, node i's children are 2i and 2i + 1.  Rows with a missing
    feature are left out.
    """
    df = df.na.drop(subset=list(features))
    n = n_rows if n_rows is not None else df.count()
    psi = sample_size(max_samples, n)
    rows = sample_rows(df, rid, features, n_trees, psi, n, seed)
    if bootstrap:
        rows = with_replacement(rows, ["tree"], psi, seed)
    rows = rows.select(F.lit(0).alias("forest"), "tree", F.lit(depth_limit(psi)).alias("limit"),
                       F.lit(_feature_subset(len(features), max_features)).alias("subset"), "x")
    nodes = materialize(grow(rows, len(features), psi, seed, subtree_rows), "forest-nodes")
    return nodes.select(*NODE_COLUMNS), psi


def sample_size(max_samples: float, n: int) -> int:
    """Rows of a tree's sample among n rows."""
    psi = int(max_samples * n) if max_samples <= 1 else int(max_samples)
    return max(2, min(psi, n))


def depth_limit(psi: int) -> int:
    return max(1, int(math.ceil(math.log2(psi))))


def with_replacement(rows: DataFrame, keys: list[str], psi: int, seed: int) -> DataFrame:
    """psi draws with replacement from each group's own sample, in the order of its hashes."""
    from vigil.operators.positions import row_index
    placed = row_index(rows, keys, ["__h", "__key", "x"], "place")
    draws = placed.select(*keys, F.floor(hash_unit(seed, "draw", F.col("tree"), F.col("place")) * psi).cast("long").alias("place"))
    return draws.join(placed, [*keys, "place"])


def _model_arrays(nodes_pdf: pd.DataFrame):
    """Flat arrays of some trees: roots, and per node feature, threshold, both child places and leaf path length."""
    t = nodes_pdf.sort_values(["tree", "node"]).reset_index(drop=True)
    tree, node = t["tree"].to_numpy(), t["node"].to_numpy()
    place = pd.Series(np.arange(len(t)), index=pd.MultiIndex.from_arrays([tree, node]))
    # a side that no sampled row took is an empty leaf, one level down
    spare = len(t) + np.arange(len(t))
    left, right = (np.where(t["feature"] >= 0, place.reindex(pd.MultiIndex.from_arrays([tree, t[side]])).fillna(-1).astype(int), 0) for side in ("left", "right"))
    left, right = np.where(left < 0, spare, left), np.where(right < 0, spare, right)
    pad = lambda x, fill: np.concatenate([x, fill])
    nothing = np.zeros(len(t), dtype=int)
    depth, size = t["depth"].to_numpy(), t["size"].to_numpy()
    feat, thr = pad(t["feature"].to_numpy(), nothing - 1), pad(t["threshold"].to_numpy(), nothing.astype(float))
    inner, at = feat >= 0, np.arange(len(feat))
    # a leaf leads to itself, so that no step tells leaves from nodes
    child = np.stack([np.where(inner, pad(left, nothing), at), np.where(inner, pad(right, nothing), at)], axis=1).ravel().astype(np.int32)
    return (np.flatnonzero(node == 1), np.where(inner, feat, 0).astype(np.int32), np.where(inner, thr, np.inf), child,
            pad(depth + c_factor(size), depth + 1.0))


def tree_paths(x: np.ndarray, arrays) -> np.ndarray:
    """Path length of each row of x (rows) in each tree of ``arrays`` (columns); one level of every tree per step."""
    roots, feature, level, child, leaf_len = arrays
    flat, base = np.ascontiguousarray(x).ravel(), (np.arange(len(x)) * x.shape[1])[:, None]
    node = np.repeat(roots[None, :].astype(np.int32), len(x), axis=0)
    while True:
        right_side = flat[base + feature[node]] >= level[node]
        below = child[2 * node + right_side]
        if (below == node).all():
            return leaf_len[node]
        node = below


def path_sums(x: np.ndarray, arrays, trees: np.ndarray, prefixes: list[int]) -> np.ndarray:
    """Per row and prefix, the summed path lengths in those trees whose number is below the prefix."""
    out = np.full((len(x), len(prefixes)), np.nan)
    at = np.flatnonzero(~np.isnan(x).any(axis=1))
    step = max(1, 100_000 // max(1, len(trees)))                                # rows x trees held at once: in the cache
    for s in range(0, len(at), step):
        paths = tree_paths(x[at[s:s + step]], arrays)
        for j, k in enumerate(prefixes):
            out[at[s:s + step], j] = paths[:, trees < k].sum(axis=1)
    return out


class _Units:
    """``hash_unit`` of one tree's nodes, each computed once for all forests that have the tree."""

    def __init__(self, seed: int, tree: int, limit: int):
        self.text = {kind: f"{seed}:{kind}:{tree}:" for kind in ("feature", "threshold")}
        self.known = {kind: np.full(1 << (limit + 1), np.nan) for kind in self.text}

    def of(self, kind: str, nodes: np.ndarray) -> np.ndarray:
        known, text = self.known[kind], self.text[kind]
        new = nodes[np.isnan(known[nodes])]
        known[new] = [int(hashlib.md5(f"{text}{i}".encode()).hexdigest()[:13], 16) for i in new.tolist()]
        known[new] /= 1 << 52
        return known[nodes]


def grow_tree(x: np.ndarray, own: np.ndarray, limit: int, units: _Units):
    """One tree over the columns of x (a feature per row), as the flat arrays that ``tree_paths`` walks (root 0).

    The same nodes as ``grow_subtrees`` makes; ``own`` marks the features it may split.
    """
    parts, starts, node, base = [], np.zeros(1, np.int64), np.ones(1, np.int64), 0
    for depth in range(limit + 1):
        size = np.diff(np.r_[starts, x.shape[1]])
        lo, hi = np.minimum.reduceat(x, starts, axis=1), np.maximum.reduceat(x, starts, axis=1)
        open_ = (hi > lo) & own[:, None]
        able = open_.sum(axis=0)
        inner = (size > 1) & (able > 0) & (depth < limit)
        at = np.flatnonzero(inner)
        feature, level = np.zeros(len(node), np.int32), np.full(len(node), np.inf)
        nth = (units.of("feature", node[at]) * able[at]).astype(np.int64)
        f = (np.cumsum(open_[:, at], axis=0) == nth + 1).argmax(axis=0)
        feature[at] = f
        level[at] = lo[f, at] + units.of("threshold", node[at]) * (hi[f, at] - lo[f, at])
        child = np.repeat(base + np.arange(len(node)), 2)               # a leaf leads to itself
        child[2 * at], child[2 * at + 1] = -1, -1
        parts.append((feature, level, child, size, np.full(len(node), depth)))
        if not len(at):
            break
        mine = np.repeat(np.arange(len(node), dtype=np.int32), size)
        stay = np.flatnonzero(inner[mine])
        mine = mine[stay]
        side = 2 * mine + (x[feature[mine], stay] >= level[mine])
        order = np.argsort(side.astype(np.uint16) if 2 * len(node) <= 1 << 16 else side, kind="stable")
        side, x = side[order], np.take(x, stay[order], axis=1)
        starts = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
        first, base = side[starts], base + len(node)
        child[first] = base + np.arange(len(first))
        node = 2 * node[first // 2] + first % 2
    feature, level, child, size, depth = (np.concatenate(c) for c in zip(*parts))
    empty = np.flatnonzero(child < 0)                                   # a side that no sampled row took: a leaf, one level down
    spare = len(feature) + np.arange(len(empty))
    child[empty] = spare
    pad = lambda a, fill: np.concatenate([a, np.full(len(empty), fill, a.dtype)])
    lengths = np.concatenate([depth + c_factor(size), depth[empty // 2] + 1.0])
    return np.zeros(1, np.int64), pad(feature, 0), pad(level, np.inf), np.concatenate([child, np.repeat(spare, 2)]).astype(np.int32), lengths


def _beside(trees: list):
    """Flat arrays of several trees as one."""
    shift = np.cumsum([0] + [len(t[1]) for t in trees[:-1]])
    return (np.concatenate([t[0] + s for t, s in zip(trees, shift)]), *[np.concatenate([t[i] for t in trees]) for i in (1, 2)],
            np.concatenate([t[3] + s for t, s in zip(trees, shift)]).astype(np.int32), np.concatenate([t[4] for t in trees]))


def fold_paths(rows: DataFrame, forests: list[tuple], n_trees: int, limit: float, width: int, counts: list[int], seed: int) -> DataFrame:
    """(forest, row, sums) as ``score_blocks`` gives them, for forests fitted on all folds but one and asked for that one.

    ``rows`` has fold, row, __key and x (``width`` numbers); ``forests`` are (forest, fold, psi, features per tree, trees).  Every (tree,
    row) pair moves once: a task reads the candidates of a tree (rows whose hash is below ``limit``: a tree's share of the rows, at
    most about ``TREE_ROWS``), grows that tree of every forest from them, and then lets all rows stream through it.  Nodes stay in the task.
    """
    spark = rows.sparkSession
    by_fold: dict = {}
    for i, f, psi, subset, trees in forests:
        by_fold.setdefault(f, []).append((i, psi, subset, trees))
    most = max(len(v) for v in by_fold.values())
    pairs = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))).withColumn("__hex", hash_hex(seed, F.col("tree"), F.col("__key")))
    near = hash_below(F.col("__hex"), limit)
    pairs = pairs.select("tree", "fold", "row", "x", F.when(near, hex_unit(F.col("__hex"))).alias("h"), F.when(near, F.col("__key")).alias("key"))
    pairs = pairs.withColumn("turn", F.col("tree") * 2 + F.col("h").isNull().cast("int"))     # candidates come first
    tasks = max(1, min(n_trees, max(shuffle_partitions(spark), 2 * spark.sparkContext.defaultParallelism)))
    pairs = pairs.withColumn("task", F.col("tree") % tasks).repartitionById(tasks, "task").drop("task").sortWithinPartitions("turn")

    def grown(tree, held):
        h, fold, key, x = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(h, kind="stable")
        if (np.diff(h[order]) == 0).any():                              # equal keys
            order = np.array(sorted(range(len(h)), key=lambda i: (h[i], key[i], tuple(x[i]))))
        x, fold = x[order], fold[order]
        units = _Units(seed, tree, max(depth_limit(psi) for _, _, psi, _, _ in forests))
        out = {}
        for f, mine in by_fold.items():
            mine = [(n, psi, subset) for n, (_, psi, subset, trees) in enumerate(mine) if tree < trees]
            if not mine:
                continue
            others = np.flatnonzero(fold != f)
            if len(others) < max(psi for _, psi, _ in mine):            # odds below 1e-14 a tree
                raise RuntimeError("a tree drew too few candidates; choose another seed")
            made = [grow_tree(np.ascontiguousarray(x[others[:psi]].T), _own_features(seed, tree, width, subset) if subset < width else np.ones(width, bool),
                              depth_limit(psi), units) for _, psi, subset in mine]
            out[f] = [n for n, _, _ in mine], _beside(made)
        return out

    def paths(tree, model, fold, row, x):
        got, known = np.zeros((len(row), most)), np.zeros(len(row), bool)
        for f, (places, arrays) in model.items():
            at = np.flatnonzero(fold == f)
            step = max(1, 100_000 // len(places))
            for s in range(0, len(at), step):
                part = at[s:s + step]
                got[part[:, None], places] = tree_paths(x[part], arrays)
            known[at] = True
        got, row = got[known], row[known]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, most, dtype=np.int32)), pa.array(got.ravel()))
        band = np.full(len(row), np.searchsorted(counts, tree, side="right"), np.int32)
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(band), lists], names=["row", "band", "paths"])

    def run(batches):
        tree, model, held = None, None, []

        def close():
            nonlocal model
            if held:
                model = grown(tree, [c[:4] for c in held])
                for _, fold, _, x, row in held:
                    for s in range(0, len(row), 50_000):
                        yield paths(tree, model, fold[s:s + 50_000], row[s:s + 50_000], x[s:s + 50_000])
                held.clear()
        for batch in batches:
            turn, fold, row = (batch.column(c).to_numpy() for c in ("turn", "fold", "row"))
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(row), width)
            h, key = batch.column("h").to_numpy(zero_copy_only=False), batch.column("key").to_numpy(zero_copy_only=False)
            cuts = np.r_[np.flatnonzero(np.r_[True, turn[1:] != turn[:-1]]), len(turn)] if len(turn) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if turn[a] // 2 != tree:
                    yield from close()
                    tree, model = int(turn[a] // 2), None
                if turn[a] % 2 == 0:
                    held.append((h[a:b], fold[a:b], key[a:b], x[a:b], row[a:b]))
                else:
                    yield from close()
                    if model is None:
                        raise RuntimeError("a tree drew too few candidates; choose another seed")
                    yield paths(tree, model, fold[a:b], row[a:b], x[a:b])
        yield from close()
    parts = pairs.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, band int, paths array<double>")
    summed = parts.groupBy("row", "band").agg(*[F.sum(F.col("paths")[i]).alias(f"p{i}") for i in range(most)])
    # a forest of fewer trees is the first trees of a larger one
    upto = [F.sum(F.when(F.col("band") <= j, F.col(f"p{i}"))) for i in range(most) for j in range(len(counts))]
    total = summed.groupBy("row").agg(*[F.coalesce(c, F.lit(0.0)).alias(f"t{n}") for n, c in enumerate(upto)])
    sums = F.array(*[F.array(*[f"t{i * len(counts) + j}" for j in range(len(counts))]) for i in range(most)])
    named = spark.createDataFrame([(f, [i for i, *_ in v]) for f, v in by_fold.items()], "fold int, forests array<int>")
    total = total.select("row", sums.alias("sums")).join(rows.select("row", "fold"), "row").join(F.broadcast(named), "fold")
    return total.select("row", F.explode(F.arrays_zip("forests", F.slice("sums", F.lit(1), F.size("forests")).alias("sums"))).alias("z")).select(
        "z.forests", "row", "z.sums").toDF("forest", "row", "sums")


def score_blocks(rows: DataFrame, nodes: DataFrame, features: list[str], prefixes: list[int], chunk_nodes: int | None = None,
                 row_block: int | None = None) -> DataFrame:
    """(forest, row, sums): path lengths of every row in its forest, summed over the trees below each of ``prefixes``.

    ``rows`` has forest, row (an id) and the features; a row may be in several forests.  Trees are dealt to blocks
    of about ``chunk_nodes`` nodes, rows to blocks of about ``row_block``; each (row block, tree block) pair is one
    group, and its partial sums are added up in one shuffle.
    """
    chunk, block = chunk_nodes or CHUNK_NODES, row_block or ROW_BLOCK
    size = nodes.groupBy("forest", "tree").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("forest").orderBy("tree")                            # one row per tree
    blocks = size.withColumn("tb", F.floor((F.sum("n").over(w) - F.col("n")) / F.lit(chunk)).cast("int"))
    row_blocks = rows.groupBy("forest").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("rbs"))
    used = materialize(blocks.join(row_blocks, "forest"), "forest-blocks")
    mine = used.select(F.col("forest").alias("f_"), F.col("tree").alias("t_"), "tb", "rbs")
    left = rows.join(used.groupBy("forest").agg(F.collect_set("tb").alias("tbs"), F.first("rbs").alias("rbs")), "forest")
    left = (left.withColumn("tb", F.explode("tbs")).withColumn("rb", F.pmod(F.xxhash64("row"), F.col("rbs")).cast("int"))
            .select("forest", "tb", "rb", "row", *features))
    right = (nodes.join(mine, (F.col("forest") == F.col("f_")) & (F.col("tree") == F.col("t_")))
             .withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("rbs") - 1))).select("forest", "tb", "rb", *NODE_COLUMNS))

    def add(r: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if r.empty or t.empty:
            return pd.DataFrame({"forest": [], "row": [], "sums": []})
        sums = path_sums(r[features].to_numpy(dtype=float), _model_arrays(t), np.sort(t["tree"].unique()), prefixes)
        return pd.DataFrame({"forest": r["forest"].to_numpy(), "row": r["row"].to_numpy(), "sums": list(sums)})
    keys = ["forest", "tb", "rb"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(add, f"forest int, row {rows.schema['row'].dataType.simpleString()}, sums array<double>")
    total = [F.sum(F.element_at("sums", j + 1)).alias(f"s{j}") for j in range(len(prefixes))]
    return parts.groupBy("forest", "row").agg(*total).select("forest", "row", F.array(*[f"s{j}" for j in range(len(prefixes))]).alias("sums"))


def shared_paths(df: DataFrame, nodes: DataFrame, features: list[str], prefixes: list[int], out: str = "__paths") -> DataFrame:
    """``df`` plus the summed path lengths below each of ``prefixes``; the forest is sent to the tasks, rows stay where they are."""
    model = nodes.toPandas()                                                    # CHUNK_NODES rows at most
    shared = df.sparkSession.sparkContext.broadcast((_model_arrays(model), np.sort(model["tree"].unique())))

    def add(batches):
        arrays, trees = shared.value
        for pdf in batches:
            yield pdf.assign(**{out: list(path_sums(pdf[features].to_numpy(dtype=float), arrays, trees, prefixes))})
    return df.mapInPandas(add, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def _norm(psi: int) -> float:
    return float(c_factor(np.array([psi]))[0]) or 1.0


def path_score(total, n_trees: int, psi: int) -> F.Column:
    """2^(-mean path / c(psi)), null where the path is unknown."""
    return F.when(~F.isnan(total) & total.isNotNull(), F.pow(F.lit(2.0), -total / F.lit(n_trees * _norm(psi))))


def iforest_score(df: DataFrame, nodes: DataFrame, psi: int, features: list[str], out: str = "score",
                  partitions: int | None = None, chunk_nodes: int | None = None) -> DataFrame:
    """anomaly score 2^(-E[h]/c(psi)) in (0, 1); larger = more anomalous.

    A forest of at most ``chunk_nodes`` nodes is sent to the tasks, a larger one meets the rows in blocks
    (``score_blocks``).  Rows with a null feature keep a null score.  ``partitions`` spreads an input of few scan splits.
    """
    spark, chunk = df.sparkSession, chunk_nodes or CHUNK_NODES
    size = nodes.agg(F.count_distinct("tree").alias("trees"), F.count(F.lit(1)).alias("nodes")).first()
    if not size["trees"]:
        return df.withColumn(out, F.lit(None).cast("double"))
    if not df.isStreaming:
        df = spread(df, partitions)
    if size["nodes"] <= chunk or df.isStreaming:
        scored = shared_paths(df, nodes, features, [1 << 62])
        return scored.withColumn(out, path_score(F.col("__paths")[0], size["trees"], psi)).drop("__paths")
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "forest-scored-rows")
    asked = rows.select(F.lit(0).alias("forest"), F.col("__row").alias("row"), *[F.col(c).cast("double").alias(c) for c in features])
    sums = score_blocks(asked, nodes.select(F.lit(0).alias("forest"), *NODE_COLUMNS), features, [1 << 62], chunk)
    sums = sums.select(F.col("row").alias("__row"), F.col("sums")[0].alias("__path"))
    return rows.join(sums, "__row", "left").withColumn(out, path_score(F.col("__path"), size["trees"], psi)).drop("__row", "__path")
