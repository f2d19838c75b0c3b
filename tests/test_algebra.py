"""Algebra and scale-path checks on the driver tables."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from testdata_paths import SF_SMALL
from vigil.operators import evaluate as G
from vigil.operators import neighbors as NB
from vigil.operators import positions as P
from vigil.operators import stats as D
from vigil.operators import windows as W
from vigil.sources import catalog as C


def test_row_index_matches_global_row_number(spark):
    df, _ = C.dataset(spark, SF_SMALL, "events_by_user")
    got = P.row_index(df, ["series_id"], ["ts", "rid"], partitions=7)
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("series_id").orderBy("ts", "rid")) - 1)
    bad = got.join(ref.select("rid", "ref"), "rid").filter(F.col("row_idx") != F.col("ref")).count()
    assert bad == 0


def test_row_index_with_ties_is_a_permutation(spark):
    df, _ = C.dataset(spark, SF_SMALL, "events")
    got = P.row_index(df.select("series_id", "value"), ["series_id"], ["value"], partitions=5)
    agg = got.agg(F.countDistinct("row_idx").alias("d"), F.min("row_idx").alias("lo"),
                  F.max("row_idx").alias("hi"), F.count("*").alias("n")).head()
    assert agg["d"] == agg["n"] and agg["lo"] == 0 and agg["hi"] == agg["n"] - 1
    # positions follow the value order
    w = Window.orderBy("row_idx")
    assert got.withColumn("prev", F.lag("value").over(w)).filter(F.col("prev") > F.col("value")).count() == 0


def test_running_sum_small_blocks(spark):
    df, _ = C.dataset(spark, SF_SMALL, "events")
    p = P.row_index(df, ["series_id"], ["ts", "rid"])
    got = P.running_sum(p, ["series_id"], "row_idx", ["is_anomaly"], block=13)
    ref = p.withColumn("ref", F.sum("is_anomaly").over(Window.orderBy("row_idx")))
    joined = got.join(ref.select("rid", "ref"), "rid")
    assert joined.filter(F.col("is_anomaly_cum") != F.col("ref")).count() == 0


def test_block_halo_windows_equal_global(spark):
    df, _ = C.dataset(spark, SF_SMALL, "events")
    p = P.row_index(df, ["series_id"], ["ts", "rid"])
    small = W.sliding_windows(p, ["series_id"], ["value"], 9, 2, block=17)
    big = W.sliding_windows(p, ["series_id"], ["value"], 9, 2, block=1_000_000)
    assert small.count() == big.count() == p.count() - 10
    assert small.exceptAll(big).count() == 0


def test_knn_1d_small_blocks_equal(spark):
    df, _ = C.dataset(spark, SF_SMALL, "events")
    a = NB.knn_score_1d(df, ["series_id"], "value", "rid", 4, block=11)
    b = NB.knn_score_1d(df, ["series_id"], "value", "rid", 4)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_f2_equals_f1_on_one_column(spark):
    df, _ = C.dataset(spark, SF_SMALL, "events_by_user")
    one = NB.knn_score_1d(df, ["series_id"], "value", "rid", 3)
    multi = NB.knn_score(df.withColumn("vec", F.array("value")), ["series_id"], "rid", "vec", 3, block_rows=16)
    j = one.join(multi.withColumnRenamed("score", "s2"), ["series_id", "rid"])
    assert j.count() == one.count()
    assert j.filter(F.abs(F.col("score") - F.col("s2")) > 1e-9).count() == 0


def test_trapezoid_equals_rank_auroc(spark):
    df, _ = C.dataset(spark, SF_SMALL, "events_weak")
    a = G.auroc(df, [], "value").head()["auroc"]
    t = G.auc_trapezoid(G.roc_curve(df, [], "value"), []).head()["auc"]
    assert a == pytest.approx(t, abs=1e-12)


def test_inverse_scale_roundtrip(spark):
    df, _ = C.dataset(spark, SF_SMALL, "lineitem")
    ch = list(C.LINE_CHANNELS)
    m = D.scale_fit(df, [], ch)
    back = D.scale_apply(D.scale_apply(df, m, [], ch), m, [], ch, inverse=True)
    j = back.select("rid", "l_partkey", "l_suppkey", F.col("l_tax").alias("t2")).join(
        df.select("rid", "l_partkey", "l_suppkey", "l_tax"), ["rid", "l_partkey", "l_suppkey"])
    assert j.filter(F.abs(F.col("t2") - F.col("l_tax")) > 1e-9).count() == 0


def test_reverse_windowing_of_constant_is_constant(spark):
    df, _ = C.dataset(spark, SF_SMALL, "events")
    p = P.row_index(df, ["series_id"], ["ts", "rid"])
    ws = W.sliding_windows(p, ["series_id"], ["value"], 5, 1).select("series_id", "win_start",
                                                                    F.lit(2.5).alias("score"))
    out = W.reverse_windowing(p, ws, ["series_id"], 6, block=50)
    assert out.filter(F.col("score") != 2.5).count() == 0 and out.count() == p.count()


def test_sweep_matches_brute_force(spark):
    df, _ = C.dataset(spark, SF_SMALL, "events")
    sc = df.withColumn("score", F.col("value") / 1000.0)
    fast = {r["j"]: (r["tp"], r["fp"]) for r in G.threshold_sweep(sc, [], "score", step=0.01).collect()}
    rows = sc.select("score", "is_anomaly").collect()
    mn = min(r["score"] for r in rows)
    for j, (tp, fp) in fast.items():
        t = mn + j * 0.01
        assert tp == sum(1 for r in rows if r["score"] >= t and r["is_anomaly"] == 1)
        assert fp == sum(1 for r in rows if r["score"] >= t and r["is_anomaly"] == 0)


def test_wide_exact_knn_matches_numpy_brute_force(spark):
    import numpy as np

    from vigil.plans.q_detect import wide_knn
    got = {r["row_idx"]: r["score"] for r in wide_knn(spark, SF_SMALL, k=11, block_rows=1500).collect()}
    df, spec = C.dataset(spark, SF_SMALL, "lineitem")
    pdf = df.select(*C.LINE_KEY, *spec.values).toPandas().sort_values(list(spec.order), kind="stable")
    x = pdf[list(spec.values)].to_numpy(float)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    sq = (x * x).sum(1)
    d = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, 10]
    assert len(got) == len(want)
    assert max(abs(got[i] - want[i]) for i in range(len(want))) < 1e-6


def test_hot_series_spreads_over_range_partitions(spark):
    """One series holding a third of the rows must not land in one task."""
    df, _ = C.dataset(spark, SF_SMALL, "events_by_user")
    users = sorted(r[0] for r in df.select("series_id").distinct().collect())
    cut = users[len(users) // 3]
    hot = df.withColumn("series_id", F.when(F.col("series_id") <= cut, F.lit(-1)).otherwise(F.col("series_id")))
    n_hot = hot.filter("series_id = -1").count()
    assert n_hot * 4 > df.count()          # at least a quarter of all rows in one series
    ranged = hot.repartitionByRange(8, "series_id", "ts", "rid").withColumn("pid", F.spark_partition_id())
    per_part = [r["count"] for r in ranged.filter("series_id = -1").groupBy("pid").count().collect()]
    assert len(per_part) >= 2 and max(per_part) < n_hot * 0.75
    got = P.row_index(hot, ["series_id"], ["ts", "rid"], partitions=8)
    ref = hot.withColumn("ref", F.row_number().over(Window.partitionBy("series_id").orderBy("ts", "rid")) - 1)
    assert got.join(ref.select("rid", "ref"), "rid").filter(F.col("row_idx") != F.col("ref")).count() == 0


def test_every_detector_takes_missing_values(spark):
    """Two channels with gaps: every row stays, only rows without a full window lack a score."""
    from vigil.operators import forecast as FC
    from vigil.operators import reconstruct as RC
    from vigil.operators import positions as P
    rows = [(i, float(i * 7919 % 101) if i % 11 else None, float(i * i % 67) if i % 17 else None) for i in range(400)]
    p = P.row_index(spark.createDataFrame(rows, "rid long, a double, b double"), [], ["rid"])
    for model in ("linear", "squared", "gbt"):
        out = FC.forecast_model_score(p, [], ["a", "b"], 2, model=model, **({"max_iter": 3} if model == "gbt" else {})).collect()
        full = {i for i in range(398) if all(None not in rows[j] for j in (i, i + 1, i + 2))}
        assert len(out) == 400 and {r["row_idx"] for r in out if r["score"] is not None} == {i + d for i in full for d in (0, 1, 2)}
    out = RC.reconstruct_score(p, [], ["a", "b"], 3, 2)[0].collect()
    assert {r["row_idx"] - 3 for r in out} == {i for i in range(397) if all(None not in rows[j] for j in range(i, i + 4))}
    assert all(r["score"] is not None and len(r["channel_mae"]) == 2 for r in out)


def test_quantiles_are_order_statistics(spark):
    """Skewed, tied, tiny and huge values; several series; missing scores; against numpy."""
    import numpy as np
    rng = np.random.default_rng(8)
    series = {"a": rng.normal(size=3000), "b": np.exp(rng.normal(size=500) * 40), "c": np.repeat([1.0, 2.0, 5.0], [5, 900, 2]), "d": np.array([3.5]),
              "e": np.r_[-1e308, 1e308, rng.uniform(size=50) * 1e-300], None: rng.integers(0, 9, size=200).astype(float)}
    rows = [(k, float(v)) for k, x in series.items() for v in x] + [("a", None), ("z", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    qs = [0.0, 0.01, 0.25, 0.5, 0.97, 0.98, 1.0]
    got = {(r["k"], r["q"]): r["value"] for r in D.quantiles(df, ["k"], "v", qs).collect()}
    assert set(got) == {(k, q) for k in series for q in qs}
    for (k, q), v in got.items():
        x = np.sort(series[k])
        h = q * (len(x) - 1)
        lo, hi = x[int(np.floor(h))], x[int(np.ceil(h))]
        assert v == lo + (h - np.floor(h)) * (hi - lo) or np.isclose(v, lo + (h - np.floor(h)) * (hi - lo), rtol=1e-12)
    whole = np.sort(np.concatenate([series[k] for k in ("a", "c")]))
    one = D.quantiles(df.filter("k IN ('a', 'c')"), [], "v", [0.9]).collect()
    assert len(one) == 1 and np.isclose(one[0]["value"], np.quantile(whole, 0.9))
    assert D.quantiles(df.filter("k = 'z'"), [], "v", [0.5]).count() == 0


@pytest.mark.parametrize("window,block", [(1, 1000), (2, 7), (5, 40), (5, 1000)])
def test_window_moments_equal_those_of_built_windows(spark, window, block):
    import numpy as np
    from vigil.operators import positions as P
    from vigil.operators import reconstruct as RC
    rng = np.random.default_rng(window)
    rows = [(s, i, *[None if rng.random() < 0.04 else float(v) for v in rng.normal(size=3).round(2)], int(i < 70)) for s in (1, 2, None) for i in range(110)]
    p = P.row_index(spark.createDataFrame(rows, "s long, rid long, a double, b double, c double, t int"), ["s"], ["rid"])
    n, mean, cov = RC.window_moments(p, ["s"], ["a", "b", "c"], window, train="t", block=block)
    built = []
    for s in (1, 2, None):
        mine = [r for r in rows if r[0] == s]
        for i in range(len(mine) - window):
            part = mine[i:i + window + 1]
            if all(None not in r[2:5] for r in part) and part[window - 1][5]:
                built.append([r[c] for c in (2, 3, 4) for r in part[:window]])
    x = np.array(built)
    assert n == len(x) > 50 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T), atol=1e-9)
    if window == 5 and block == 1000:
        w = spark.createDataFrame([(list(map(float, v)),) for v in built], "flat array<double>")
        a, b = RC.reconstruct_fit(w, 3), RC.reconstruct_fit_moments((n, mean, cov), 3)
        assert np.allclose(a["pc"] @ a["pc"].T, b["pc"] @ b["pc"].T, atol=1e-8) and np.allclose(a["mean"], b["mean"])


def test_refined_sweep_of_equal_percentiles(spark, tmp_path):
    """Every value twice: all scores are 0, the first sweep has no level and the refined one no rows."""
    from vigil.plans.registry import QUERIES
    from testdata_paths import SF_SMALL
    e = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    e.unionByName(e.withColumn("event_id", e.event_id + 1_000_000)).write.parquet(str(tmp_path / "events.parquet"))
    out = QUERIES["g10_threshold_refine"](spark, str(tmp_path))
    assert out.columns == ["j", "t", "tp", "fp", "fn", "f1"] and out.count() == 0
