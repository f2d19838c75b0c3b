"""Driver contract and oracle agreement on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as E
from testdata_paths import SF_SMALL
from vigil.plans import registry

# one or more queries from every SURVEY §2 area (the full set runs in scripts/compare.py)
ORACLE_SAMPLE = ["knn_events_by_user_board", "f2_knn_1d_by_user", "f4_loop_by_user", "g3_auroc_weak",
                 "g7_threshold_sweep", "e5_reverse_windowing", "f19_knn_classify", "d9_score_percentile",
                 "h3_grid_search_cv", "b12_row_index_global", "a5_write_read_scores", "a8_leaderboard_upsert",
                 "b8_label_by_intervals", "c4_split_tail_validation", "d5_zscore_sample_drop_constant",
                 "e3_sequences", "f14_window_mae_channel", "g5_roc_curve", "g10_threshold_refine",
                 "knn_job_from_config"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["dataset", "detector", "f1", "auroc"] and len(rows) == 1


def test_every_query_is_registered_with_an_oracle_or_rows_only():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    rows_only = set(registry.QUERIES) - set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(qs)
    assert rows_only == {"f8_forecast_fit", "f8_forecast_fit_gbt", "f9_forecast_predict", "f12_reconstruct_fit",
                         "f13_reconstruct_predict", "f3_knn_wide_exact"}


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_oracle_agreement_small(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    got = sorted((tuple(_norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    cur = duck.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    want = sorted((tuple(_norm(float(r[i]) if hasattr(r[i], "as_integer_ratio") and not isinstance(r[i], int)
                               else r[i]) for i in order) for r in cur.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(cols)
    assert got == want


def test_job_config_rejects_unknown_keys(spark):
    from vigil.plans import jobs as J
    with pytest.raises(KeyError):
        J.run_job(spark, SF_SMALL, {"dataset": "events", "detector": "knn", "K": 5})
    with pytest.raises(KeyError):
        J.run_job(spark, SF_SMALL, {"dataset": "nope", "detector": "knn"})


@pytest.mark.parametrize("conf,title", [
    ({"dataset": "events", "detector": "loop", "k": 10}, "LoOP"),
    ({"dataset": "lineitem", "detector": "iforest", "n_trees": 5, "max_samples": 32, "max_features": 0.5, "bootstrap": True,
      "contamination": 0.05}, "IForest"),
    ({"dataset": "lineitem", "detector": "knn", "k": 3}, "Knn"),
    ({"dataset": "events_collective", "detector": "forecast", "window": 20, "level": 0.5, "model": "baseline"}, "Baseline"),
    ({"dataset": "lineitem", "detector": "forecast", "window": 3, "model": "squared"}, "DeeP-ANT"),
    ({"dataset": "lineitem", "detector": "reconstruct", "window": 4, "rank": 2}, "LSTM-AE"),
    ({"dataset": "embeddings", "detector": "knn", "k": 5, "percentile": 95.0}, "Knn"),
    ({"dataset": "embeddings", "detector": "iforest", "n_trees": 5, "max_samples": 32}, "IForest"),
])
def test_jobs_keep_every_row_and_count_the_board_from_them(spark, conf, title):
    from vigil.plans import jobs as J
    from vigil.sources import catalog as C
    flagged, row = J.run_job(spark, SF_SMALL, conf)
    got = row.collect()
    rows = flagged.select("is_anomaly", "flag", "score").collect()
    assert len(rows) == C.dataset(spark, SF_SMALL, conf["dataset"])[0].count()
    tp = sum(r["is_anomaly"] == 1 and r["flag"] == 1 for r in rows)
    fp = sum(r["is_anomaly"] == 0 and r["flag"] == 1 for r in rows)
    fn = sum(r["is_anomaly"] == 1 and r["flag"] != 1 for r in rows)
    pos = [r["score"] if r["score"] is not None else -math.inf for r in rows if r["is_anomaly"] == 1]
    neg = [r["score"] if r["score"] is not None else -math.inf for r in rows if r["is_anomaly"] == 0]
    neg.sort()
    import bisect
    wins = sum(bisect.bisect_left(neg, p) + (bisect.bisect_right(neg, p) - bisect.bisect_left(neg, p)) / 2 for p in pos)
    assert len(got) == 1 and got[0]["detector"] == title
    assert abs(got[0]["f1"] - (2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0)) < 1e-9
    if pos and neg:
        assert abs(got[0]["auroc"] - wins / (len(pos) * len(neg))) < 1e-9
    else:
        assert got[0]["auroc"] is None


def test_reconstruction_model_round_trip_and_unflatten(spark, tmp_path):
    import numpy as np

    from vigil.operators import reconstruct as RC
    w = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]],)], "window array<array<double>>")
    back = RC.unflatten_window(RC.flatten_window(w), 2, "flat").head()["recon_window"]
    assert back == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]
    model = {"mean": np.arange(3.0), "pc": np.arange(6.0).reshape(3, 2), "rank": 2}
    again = RC.load_reconstruction(spark, RC.save_reconstruction(spark, model, str(tmp_path / "m")))
    assert (again["mean"] == model["mean"]).all() and (again["pc"] == model["pc"]).all() and again["rank"] == 2


def test_arrow_functions_run_from_another_folder(tmp_path):
    """Executors get the package from the driver: no PYTHONPATH, another working folder."""
    import subprocess
    import sys

    from testdata_paths import ROOT
    code = f"""import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from vigil.session import configure
from vigil.operators import forest as FR
configure(spark)
df = spark.range(50).selectExpr("id", "double(id) AS x")
nodes, psi = FR.iforest_fit(df, "id", ["x"], n_trees=2, max_samples=8)
print("scored", FR.iforest_score(df, nodes, psi, ["x"]).filter("score > 0").count())"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "scored 50" in out.stdout, out.stderr[-2000:]


def test_intermediate_tables_live_in_the_checkpoint_folder(spark):
    from vigil.session import checkpoint_dir, materialize
    df = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id")
    out = materialize(df, "probe")
    files = out.inputFiles()
    root = checkpoint_dir(spark).replace("file:", "")
    assert files and all(root in f.replace("file:", "") for f in files)
    assert out.count() == df.count()
