"""Pivot neighbours against all pairs."""

import numpy as np
import pytest

from vigil.operators import neighbors as NB
from vigil.operators import pivots as PV

SCHEMA = "s long, rid long, vec array<double>"


def brute(q, r, k, p, exclude_self):
    out = {}
    for s, i, x in q:
        best = sorted((float((np.abs(np.array(x) - np.array(y)) ** p).sum() ** (1 / p)), j) for t, j, y in r if t == s and not (exclude_self and i == j))[:k]
        out[s, i] = best
    return out


def shapes(rng, n, dim):
    """Clusters of different width, a line of equal rows, and far rows."""
    centre = rng.normal(size=(6, dim)) * 10
    x = np.concatenate([centre[rng.integers(6, size=n)] + rng.normal(size=(n, dim)) * rng.choice([0.1, 1.0], size=(n, 1)),
                        np.tile(centre[0], (n // 5, 1)), rng.normal(size=(5, dim)) * 1000])
    return np.round(x, 3)


@pytest.mark.parametrize("p,k,dim", [(2.0, 3, 3), (1.0, 5, 2), (3.0, 2, 4), (2.0, 40, 2)])
def test_pivot_neighbours_are_exact(spark, p, k, dim):
    rng = np.random.default_rng(int(10 * p + k))
    x = shapes(rng, 240, dim)
    rows = [(i % 3 if i % 7 else 1, i, [float(v) for v in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows, rows, k, p, True)
    got = {}
    for r in NB.knn_edges(df, df, ["s"], "rid", "vec", k, p, block_rows=25).collect():
        got.setdefault((r["s"], r["rid"]), []).append((r["rank"], r["d"], r["nid"]))
    for key, best in want.items():
        mine = sorted(got[key])
        assert np.allclose([d for _, d, _ in mine], [d for d, _ in best]) and len(mine) == len(best)
        if p != 3.0:                      # equal distances differ in the last bit for powers
            assert [j for _, _, j in mine] == [j for _, j in best] or np.allclose(np.diff(sorted(d for d, _ in best)).min(initial=1), 0, atol=1e-9)


def test_search_of_other_rows_and_missing_numbers(spark):
    rng = np.random.default_rng(3)
    refs = [(0, i, [float(v) for v in x]) for i, x in enumerate(shapes(rng, 300, 2))]
    queries = [(0, i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(40, 2)) * 12)] + [(0, 900, None), (0, 901, [None, 1.0]), (5, 902, [0.0, 0.0])]
    bad = [(0, 2000, None), (0, 2001, [float("nan"), 0.0])]
    q, r = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(refs + bad, SCHEMA)
    want = brute(queries[:40], refs, 4, 2.0, False)
    got = {}
    for e in NB.knn_edges(q, r, ["s"], "rid", "vec", 4, block_rows=20, exclude_self=False).collect():
        got.setdefault((e["s"], e["rid"]), []).append(e["d"])
    assert set(got) == set(want) and all(np.allclose(sorted(got[i]), [d for d, _ in want[i]]) for i in want)
    scored = NB.knn_score(r, ["s"], "rid", "vec", 2, block_rows=20).collect()
    assert len(scored) == len(refs) + 2 and {x["rid"] for x in scored if x["score"] is None} == {2000, 2001}


def test_few_pivots_change_nothing(spark, monkeypatch):
    rows = [(0, i, [float(v) for v in x]) for i, x in enumerate(shapes(np.random.default_rng(4), 200, 2))]
    df = spark.createDataFrame(rows, SCHEMA)
    all_ = sorted(map(tuple, NB.knn_edges(df, df, [], "rid", "vec", 3, block_rows=20).select("rid", "rank", "d").collect()))
    monkeypatch.setattr(PV, "MAX_VALUES", 8)
    assert sorted(map(tuple, NB.knn_edges(df, df, [], "rid", "vec", 3, block_rows=20).select("rid", "rank", "d").collect())) == all_
    assert len(PV.choose(df, [], 20)[()]) < 15


def test_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(0, i, [float(i)]) for i in range(30)], SCHEMA)
    assert NB.knn_edges(df, df, [], "rid", "vec", 50, block_rows=5).count() == 30 * 29


@pytest.mark.parametrize("k", [1, 3, 17])
def test_intervals_are_the_nearest_rows(k):
    """Sorted values with ties: the same neighbours as ranking (distance, gap, position), and their sums."""
    rng = np.random.default_rng(k)
    groups = [np.sort([np.round(rng.normal(size=n) * 50), rng.normal(size=n), np.r_[rng.normal(size=n - 1), 1e6 * (-1) ** i]][i % 3])
              for i, n in enumerate([1, 2, 5, 18, 40, 77, 9, 30, 64])]
    v, size = np.concatenate(groups), np.array([len(g) for g in groups])
    begin = np.repeat(np.cumsum(size) - size, size)
    end = begin + np.repeat(size, size)
    kk = np.minimum(k, end - begin - 1)
    kth, pdist, ev = NB.interval_stats(v, begin, end, kk, 3.0)
    want = []
    for g in groups:
        near = [sorted((abs(x - y), abs(i - j), j) for j, y in enumerate(g) if j != i)[:k] for i, x in enumerate(g)]
        pd = [3 * np.sqrt(sum(d * d for d, _, _ in e) / max(len(e), 1)) for e in near]
        want += [(e[-1][0] if e else 0.0, p, sum(pd[j] for _, _, j in e) / max(len(e), 1)) for e, p in zip(near, pd)]
    assert np.allclose(np.array([kth, pdist, ev]).T, want, rtol=1e-9, atol=1e-12)


def test_one_column_scores_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 4 if i % 9 else None, i, None if i % 50 == 7 else float(np.round(rng.normal() * 20, 1))) for i in range(900)] + [(77, 5000, 1.0)]
    df = spark.createDataFrame(rows, "s long, rid long, x double").repartition(5)
    for k in (2, 60, 400):
        for op in (NB.knn_score_1d, NB.loop_1d):
            a, b = ({(r["s"], r["rid"]): r["score"] for r in op(df, ["s"], "x", "rid", k=k, block=block).collect()} for block in (10_000, 23))
            assert set(a) == set(b) == {(s, i) for s, i, _ in rows}
            assert all((a[i] is None) == (b[i] is None) and (a[i] is None or abs(a[i] - b[i]) < 1e-9) for i in a)
            assert a[77, 5000] is None


@pytest.mark.parametrize("block_rows", [1000, 20])
def test_farthest_rows(spark, block_rows):
    rows = [(0, i, [float(v) for v in x]) for i, x in enumerate(shapes(np.random.default_rng(6), 200, 3))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {}
    for r in PV.farthest(df, ["s"], 7, block_rows).collect():
        got.setdefault(r["rid"], []).append(r["d"])
    for _, i, x in rows:
        d = sorted((float(np.linalg.norm(np.array(x) - np.array(y))) for _, _, y in rows), reverse=True)[:7]
        assert np.allclose(sorted(got[i], reverse=True), d)


def test_far_loop_equals_loop_with_as_many_neighbours(spark):
    rows = [(i % 2, i, [float(v) for v in x]) for i, x in enumerate(shapes(np.random.default_rng(7), 80, 2))] + [(0, 999, None), (5, 998, [1.0, 2.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    far = {r["rid"]: r["score"] for r in NB.loop_vec_far(df, ["s"], "rid", "vec", 10, block_rows=15).collect()}
    assert far[999] is None and far[998] is None and len(far) == len(rows)
    for s in (0, 1):
        mine = df.filter(f"s = {s} AND rid < 990")
        near = {r["rid"]: r["score"] for r in NB.loop_vec(mine, ["s"], "rid", "vec", k=mine.count() - 10).collect()}
        assert all(abs(far[i] - near[i]) < 1e-6 for i in near)


def test_dense_vectors_meet_by_blocks(spark, monkeypatch):
    """Where nearly every cell is reachable no query is copied once per cell: nearest, Manhattan and farthest rows."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 24))
    rows = [(0, i, [float(v) for v in y]) for i, y in enumerate(np.concatenate([x, np.tile(x[:1], (30, 1))]))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    written = []
    keep = PV.materialize
    monkeypatch.setattr(PV, "materialize", lambda d, name: written.append(name) or keep(d, name))
    for p in (1.0, 2.0):
        got = {}
        for e in NB.knn_edges(df, df, [], "rid", "vec", 4, p, block_rows=40).collect():
            got.setdefault((0, e["rid"]), []).append((round(e["d"], 9), e["nid"]))
        want = brute(rows, rows, 4, p, True)
        assert {i: sorted(v) for i, v in got.items()} == {i: [(round(d, 9), j) for d, j in v] for i, v in want.items()}
    got = {}
    for e in PV.farthest(df, ["s"], 5, 40).collect():
        got.setdefault(e["rid"], []).append((round(e["d"], 9), e["nid"]))
    for _, i, y in rows:
        d = sorted(((round(float(np.linalg.norm(np.array(y) - np.array(z))), 9), j) for _, j, z in rows), reverse=True)[:5]
        assert sorted(got[i], reverse=True) == d
    assert not {"knn-visits", "far-visits"} & set(written)


@pytest.mark.parametrize("p", [1.0, 2.0, 3.0])
def test_block_search_holds_few_distances(p):
    """Chunks change nothing; many equal references cost no more than k of them."""
    rng = np.random.default_rng(5)
    r = np.concatenate([rng.normal(size=(5000, 3)), np.zeros((4000, 3))])
    q = np.concatenate([rng.normal(size=(150, 3)), np.zeros((3, 3))])
    rid = rng.permutation(len(r))
    i, j, d = NB.best_pairs(q, r, np.arange(len(q)), rid, 6, p, exclude_self=True)
    for n, y in enumerate(q):
        all_ = (np.abs(r - y) ** p).sum(axis=1) ** (1 / p)
        order = [o for o in np.lexsort((rid, all_)) if rid[o] != n][:6]
        assert np.allclose(np.sort(d[i == n]), all_[order]) and list(rid[j[i == n]]) == list(rid[order])
