"""Rows-only operators: invariants."""

from pyspark.sql import functions as F

from testdata_paths import SF_SMALL
from vigil.operators import evaluate as G
from vigil.operators import forest as FR
from vigil.sources import catalog as C


def test_forest_scores_range_repeatability_and_quality(spark):
    df, spec = C.dataset(spark, SF_SMALL, "lineitem")
    feats = list(spec.values)
    nodes, psi = FR.iforest_fit(df, list(C.LINE_KEY), feats, n_trees=40, max_samples=128, seed=7)
    s1 = FR.iforest_score(df.select(*C.LINE_KEY, *feats, "is_anomaly"), nodes, psi, feats)
    # same seed, different partitioning of the input -> the same forest and scores
    nodes2, _ = FR.iforest_fit(df.repartition(5), list(C.LINE_KEY), feats, n_trees=40, max_samples=128, seed=7)
    assert nodes.exceptAll(nodes2).count() == 0
    stats = s1.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).head()
    assert 0.0 < stats["lo"] <= stats["hi"] < 1.0
    assert G.auroc(s1, [], "score").head()["auroc"] > 0.9


def test_every_tree_gets_exactly_its_sample_and_nodes_add_up(spark):
    df, spec = C.dataset(spark, SF_SMALL, "lineitem")
    for kw in ({"max_samples": 64}, {"max_samples": 0.3, "n_trees": 3}, {"max_samples": 50, "bootstrap": True, "max_features": 0.5}):
        nodes, psi = FR.iforest_fit(df, list(C.LINE_KEY), list(spec.values), **{"n_trees": 10, "seed": 1} | kw)
        want = int(kw["max_samples"]) if kw["max_samples"] > 1 else int(kw["max_samples"] * df.count())
        t = nodes.toPandas()
        assert psi == want and (t[t.node == 1]["size"] == psi).all() and (t.node == 1).sum() == kw.get("n_trees", 10)
        size = {(a, b): c for a, b, c in zip(t.tree, t.node, t["size"])}
        limit = int(t.depth.max())
        for r in t.itertuples():
            if r.feature >= 0:
                assert size.get((r.tree, r.left), 0) + size.get((r.tree, r.right), 0) == r.size
            else:
                assert r.size == 1 or r.depth == limit or kw.get("max_features")
        if kw.get("max_features"):
            assert t[t.feature >= 0].groupby("tree").feature.nunique().max() <= 2


def test_scores_do_not_depend_on_tree_chunks(spark):
    df, spec = C.dataset(spark, SF_SMALL, "lineitem")
    feats = list(spec.values)
    nodes, psi = FR.iforest_fit(df, list(C.LINE_KEY), feats, n_trees=6, max_samples=32, seed=3)
    rows = df.select(*C.LINE_KEY, *feats).limit(500)
    a = {tuple(r)[:3]: round(r["score"], 9) for r in FR.iforest_score(rows, nodes, psi, feats).collect()}
    b = {tuple(r)[:3]: round(r["score"], 9) for r in FR.iforest_score(rows, nodes, psi, feats, chunk_nodes=50).collect()}
    assert a == b and len(set(a.values())) > 10


def test_forests_do_not_depend_on_how_they_are_grown(spark):
    df, spec = C.dataset(spark, SF_SMALL, "lineitem")
    feats = list(spec.values)
    for kw in ({"max_samples": 0.2}, {"max_samples": 300, "bootstrap": True, "max_features": 0.5}):
        a = FR.iforest_fit(df, list(C.LINE_KEY), feats, n_trees=4, seed=9, **kw)[0]
        b = FR.iforest_fit(df, list(C.LINE_KEY), feats, n_trees=4, seed=9, subtree_rows=100, **kw)[0]
        assert a.count() == b.count() > 500 and a.exceptAll(b).count() == 0


def test_smallest_hashes_of_every_group(spark, monkeypatch):
    import random
    rng = random.Random(4)
    rows = [(t, round(rng.random() ** 3, 3), str(rng.randrange(40)), [float(i)]) for t in range(4) for i in range(700)]
    rows += [(9, 0.5, "same", [float(i % 3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "tree int, __h double, __key string, x array<double>").repartition(5)
    monkeypatch.setattr(FR, "SLICES", 8)
    for psi in (1, 37, 299):
        got = sorted((r["tree"], r["__h"], r["__key"], list(r["x"])) for r in FR.smallest(df, ["tree"], psi).collect())
        assert got == [(t, h, k, x) for t in (0, 1, 2, 3, 9) for h, k, x in sorted((h, k, x) for u, h, k, x in rows if u == t)[:psi]]


def test_large_forest_scores_without_sending_it(spark):
    """800 trees of a fifth of the rows: one pass over row blocks x tree blocks, nothing broadcast."""
    df, spec = C.dataset(spark, SF_SMALL, "events")
    df = df.limit(400).withColumn("value", F.round("value", 1))
    nodes, psi = FR.iforest_fit(df, ["rid"], ["value"], n_trees=800, max_samples=0.2, seed=5)
    assert psi == 80 and nodes.select("tree").distinct().count() == 800
    a = {r["rid"]: round(r["score"], 9) for r in FR.iforest_score(df, nodes, psi, ["value"]).collect()}
    b = FR.iforest_score(df, nodes, psi, ["value"], chunk_nodes=3000)
    assert "Broadcast variable" not in b._jdf.queryExecution().toString() and {r["rid"]: round(r["score"], 9) for r in b.collect()} == a


def test_rows_with_missing_features(spark):
    rows = [(i, float(i % 17), None if i % 10 == 0 else float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "rid long, a double, b double")
    nodes, psi = FR.iforest_fit(df, "rid", ["a", "b"], n_trees=5, max_samples=50)
    for chunk in (None, 20):
        out = FR.iforest_score(df, nodes, psi, ["a", "b"], chunk_nodes=chunk).collect()
        assert len(out) == 300 and {r["rid"] for r in out if r["score"] is None} == set(range(0, 300, 10))


def test_forecasters_predict_every_row_with_history(spark):
    from vigil.operators import forecast as FC
    from vigil.operators import positions as P
    from vigil.operators import splits as S
    df, _ = C.dataset(spark, SF_SMALL, "events_collective")
    p = P.row_index(df, [], ["ts", "rid"])
    train = S.split_fraction(p, [], 0.75).filter("is_train = 1")
    for model in ("linear", "gbt"):
        m = FC.forecast_fit(train, [], ["value"], 5, model=model, max_iter=10)
        pred = FC.forecast_error(FC.forecast_predict(p, m, [], ["value"], 5), ["value"])
        assert pred.filter(F.col("error").isNotNull()).count() == p.count() - 5


def test_grid_of_a_small_forest_moves_no_rows(spark, monkeypatch):
    """A forest that fits the tasks is sent to them; rows are not dealt to blocks, and both ways give the same grid."""
    from vigil.operators import search as H
    df, spec = C.dataset(spark, SF_SMALL, "lineitem")
    nodes, psi = FR.iforest_fit(df, list(C.LINE_KEY), list(spec.values), n_trees=6, max_samples=64, seed=3)
    ask = lambda: sorted(map(tuple, H.forest_grid_f1(df, nodes, psi, list(spec.values), [2, 6], [0.02, 0.05]).collect()))
    monkeypatch.setattr(FR, "CHUNK_NODES", 100)
    want = ask()
    monkeypatch.undo()

    def refuse(*a, **b):
        raise AssertionError("rows were dealt to blocks")
    monkeypatch.setattr(FR, "score_blocks", refuse)
    assert ask() == want and len(want) == 4
