"""Tiny hand-checked fixtures (FIXTURES.md §3)."""

import math

import pytest
from pyspark.sql import functions as F

from vigil.operators import evaluate as G
from vigil.operators import neighbors as NB
from vigil.operators import positions as P
from vigil.operators import stats as D
from vigil.operators import windows as W
from vigil.sources import board as BD


def _series(spark, values, col="value"):
    rows = [(0, i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"series_id long, rid long, {col} double")


def test_reverse_windowing_size3(spark):
    ws = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0)], "series_id long, win_start long, score double")
    rows = spark.createDataFrame([(0, i) for i in range(5)], "series_id long, row_idx long")
    out = W.reverse_windowing(rows, ws, ["series_id"], 3).orderBy("row_idx").collect()
    assert [r["score"] for r in out] == [1.0, 1.5, 2.0, 2.5, 3.0]


def test_window_count(spark):
    df = P.row_index(_series(spark, range(10)), ["series_id"], ["rid"])
    assert W.sliding_windows(df, ["series_id"], ["value"], 3, 1).count() == 7
    assert W.sliding_windows(df, ["series_id"], ["value"], 3, 1, short=True).count() == 6


@pytest.mark.parametrize("k,expected", [(1, [1, 1, 2, 7]), (2, [3, 2, 3, 9])])
def test_knn_1d_and_multid(spark, k, expected):
    df = _series(spark, [0, 1, 3, 10])
    one = NB.knn_score_1d(df, ["series_id"], "value", "rid", k).orderBy("rid").collect()
    assert [r["score"] for r in one] == expected
    vec = df.withColumn("vec", F.array("value"))
    multi = NB.knn_score(vec, ["series_id"], "rid", "vec", k, block_rows=2).orderBy("rid").collect()
    assert [r["score"] for r in multi] == expected


def test_auroc_fixtures(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "is_anomaly int, score double")
    assert G.auroc(df, [], "score").head()["auroc"] == pytest.approx(0.75)
    eq = spark.createDataFrame([(0, 0.5), (1, 0.5)], "is_anomaly int, score double")
    assert G.auroc(eq, [], "score").head()["auroc"] == pytest.approx(0.5)
    one = spark.createDataFrame([(0, 0.5), (0, 0.7)], "is_anomaly int, score double")
    assert G.auroc(one, [], "score").head()["auroc"] is None


def test_prf_no_positive_flags(spark):
    conf = spark.createDataFrame([(0, 0, 3, 5)], "tp long, fp long, fn long, tn long")
    r = G.prf(conf).head()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)


def test_population_vs_sample_std(spark):
    df = _series(spark, [1, 2, 3, 4])
    pop = D.moments(df, [], ["value"]).head()["value__std"]
    smp = D.moments(df, [], ["value"], sample=True).head()["value__std"]
    assert pop == pytest.approx(1.118034, abs=1e-6)
    assert smp == pytest.approx(1.290994, abs=1e-6)


def test_percentile_99(spark):
    df = _series(spark, range(101))
    assert D.percentile_of(df, [], "value", 99).head()["threshold"] == pytest.approx(99.0)


def test_contamination_floor(spark):
    df = spark.createDataFrame([(0,), (0,)], "is_anomaly int")
    assert D.contamination(df, []).head()["contamination"] == 4.9e-324


def test_lenient_cast(spark):
    from vigil.operators import series as B
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "v string")
    assert [r["v"] for r in B.to_numeric_coerce(df, ["v"]).collect()] == [1.5, None, None]


def test_align_window_score(spark):
    ws = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.2)], "series_id long, win_start long, score double")
    rows = spark.createDataFrame([(0, i) for i in range(6)], "series_id long, row_idx long")
    out = W.align_window_score(rows, ws, ["series_id"], 3).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in out] == [3, 4]


def test_board_upsert(spark):
    board = BD.empty_board(spark, "d")
    new = spark.createDataFrame([("d", "LoOP", 0.5, 0.6)], BD.BOARD_SCHEMA)
    out = {r["detector"]: r for r in BD.upsert(board, new).collect()}
    assert len(out) == 5 and out["LoOP"]["f1"] == 0.5 and out["Knn"]["f1"] is None


def test_erf_matches_math(spark):
    from vigil.functions.columns import erf
    xs = [-2.0, -0.5, 0.0, 0.3, 1.0, 3.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(erf("x")).collect()]
    for x, g in zip(xs, got):
        assert abs(g - math.erf(x)) < 2e-7


def test_degenerate_series_give_nulls_not_errors(spark):
    df = _series(spark, [0, 0, 0])
    assert [r["value"] for r in D.max_normalise(df, [], "value").collect()] == [None] * 3
    assert [r["value"] for r in D.standardised_error(df, [], "value").collect()] == [None] * 3


def test_single_class_roc_and_lonely_row_loop(spark):
    one = spark.createDataFrame([(0, 0.2), (0, 0.4)], "is_anomaly int, score double")
    pts = G.roc_curve(one, [], "score").filter("point > 0").collect()
    assert all(r["tpr"] is None for r in pts)
    lonely = spark.createDataFrame([(7, 1, 1.0), (8, 2, 1.0), (8, 3, 4.0)], "series_id long, rid long, value double")
    s = {r["rid"]: r["score"] for r in NB.loop_1d(lonely, ["series_id"], "value", "rid", k=1).collect()}
    assert set(s) == {1, 2, 3} and s[1] is None and s[2] is not None


def test_multid_knn_keeps_short_series(spark):
    df = spark.createDataFrame([(1, 1, [0.0]), (2, 2, [0.0]), (2, 3, [2.0])], "series_id long, rid long, vec array<double>")
    s = {r["rid"]: r["score"] for r in NB.knn_score(df, ["series_id"], "rid", "vec", 1).collect()}
    assert s == {1: None, 2: 2.0, 3: 2.0}


def test_intervals_across_midnight(spark):
    from vigil.operators import series as B
    rows = spark.createDataFrame([(1, "2024-01-01 23:50:00"), (2, "2024-01-02 00:05:00"), (3, "2024-01-02 00:30:00"),
                                  (4, "2024-01-03 12:00:00")], "rid long, t string").selectExpr(
        "rid", "cast(t as timestamp_ntz) as ts")
    iv = spark.createDataFrame([("2024-01-01 23:45:00", "2024-01-02 00:10:00"),
                                ("2024-01-03 11:00:00", "2024-01-03 12:00:00")], "s string, e string").selectExpr(
        "cast(s as timestamp_ntz) as start", "cast(e as timestamp_ntz) as end")
    got = {r["rid"]: r["is_anomaly"] for r in B.label_by_intervals(rows, "ts", iv).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 1}
