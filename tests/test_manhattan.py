"""Manhattan neighbours on a grid of small integers, and rows that meet themselves once, against all pairs."""

import numpy as np
import pytest

from vigil.operators import manhattan as MH
from vigil.operators import neighbors as NB
from vigil.operators import pivots as PV


def _best(x, y, xid, yid, k):
    out = []
    for i, v in enumerate(x):
        d = np.abs(v - y).sum(axis=1)
        d[yid == xid[i]] = np.inf
        j = np.lexsort((yid, d))[:k]
        out.append((list(yid[j]), list(d[j])))
    return out


def _check(got, want, yid, k):
    i, j, d = got
    assert (np.diff(i) >= 0).all() and (np.bincount(i, minlength=len(want)) == k).all()
    for r, (ids, near) in enumerate(want):
        at = slice(r * k, r * k + k)
        assert list(yid[j[at]]) == ids and np.allclose(d[at], near, rtol=1e-12, atol=0)


def _unit(rng, n, dim):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("shape", ["unit", "far rows", "whole numbers"])
def test_blocks_both_ways(shape, monkeypatch):
    rng = np.random.default_rng(11)
    x, y = _unit(rng, 1300, 48), _unit(rng, 1500, 48)
    if shape == "far rows":
        x[::400] *= 1e6
        y[7] = 1e12
    if shape == "whole numbers":                                       # many equal distances
        x, y = np.round(x * 12), np.round(y * 12)
    xid, yid = np.arange(1300) * 3, np.arange(1500) * 2
    measured = []
    exact = MH._measured
    monkeypatch.setattr(MH, "_measured", lambda a, b, i, j: measured.append(len(i)) or exact(a, b, i, j))
    monkeypatch.setattr(MH, "TILE", 500)
    unknown = np.full(1300, np.inf), np.full(1500, np.inf)
    for bounds in (None, unknown):
        met = MH.nearest(x, y, xid, yid, xid, yid, 4, True, True, bounds)
        assert met is not None or shape == "whole numbers" or bounds is unknown
        if met is None:
            continue
        if bounds is None and shape != "whole numbers":
            assert sum(measured) < 0.1 * len(x) * len(y)               # all others are settled by the grid
        _check(met[0], _best(x, y, xid, yid, 4), yid, 4)
        _check(met[1], _best(y, x, yid, xid, 4), xid, 4)
    for pairs, want, ids in zip(NB.both_pairs(x, y, xid, yid, 4, True, unknown), (_best(x, y, xid, yid, 4), _best(y, x, yid, xid, 4)), (yid, xid)):
        _check(pairs, want, ids, 4)


def test_equal_rows_and_few_rows():
    rng = np.random.default_rng(5)
    x = _unit(rng, 1400, 16)
    x[:200] = x[0]                                                     # more copies than neighbours
    ids = np.arange(1400)
    _check(NB.best_pairs(x, x, ids, ids, 5, 1.0), _best(x, x, ids, ids, 5), ids, 5)
    for got in NB.both_pairs(x[:1200], x[1200:], ids[:1200], ids[1200:], 5, True, (np.full(1200, np.inf), np.full(200, np.inf))):
        assert len(got[0]) in (1200 * 5, 200 * 5)
    assert MH.nearest(x, np.zeros((1400, 16)), ids, ids, ids, ids, 65, False) is None


def test_rows_meet_themselves_once(spark, monkeypatch):
    """A pair of blocks is one group, whichever of the two asks; results are those of all pairs."""
    rng = np.random.default_rng(8)
    x = _unit(rng, 700, 24)
    x[300:340] = x[300]
    df = spark.createDataFrame([(i % 2, i, [float(v) for v in r]) for i, r in enumerate(x)], "s long, rid long, vec array<double>").repartition(3)
    monkeypatch.setattr(PV, "FULL_ROWS", 60)
    monkeypatch.setattr(MH, "LEAST_ROWS", 10)
    sizes = []
    once = NB.block_edges_once

    def seen(rows, keys, k, block_rows, exclude_self, partitions):
        sizes.append((block_rows, partitions))
        assert rows.filter("__bound is null or __bound <= 0 and rid not between 300 and 339").isEmpty()
        return once(rows, keys, k, block_rows, exclude_self, partitions)
    monkeypatch.setattr(NB, "block_edges_once", seen)
    got: dict = {}
    for r in NB.knn_edges(df, df, ["s"], "rid", "vec", 3, 1.0, block_rows=40).orderBy("rid", "rank").collect():
        got.setdefault(r["rid"], []).append((r["nid"], r["d"]))
    block, tasks = sizes[0]
    nb = -(-350 // block)
    assert tasks == 3 * 2 * nb * (nb + 1) // 2                         # not nb * nb groups a series
    for s in (0, 1):
        ids = np.flatnonzero(np.arange(700) % 2 == s)
        for i, (nids, near) in zip(ids, _best(x[ids], x[ids], ids, ids, 3)):
            assert [n for n, _ in got[i]] == nids and np.allclose([d for _, d in got[i]], near)
