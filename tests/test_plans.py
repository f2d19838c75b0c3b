"""Plan checks: no nested-loop/cartesian joins, pruned scans."""

import re

import pytest

import __spark_entry__ as E
from testdata_paths import SF_SMALL

CHECKED = ["knn_events_by_user_board", "f2_knn_1d_global", "f4_loop_by_user", "f1_knn_multid",
           "e1_sliding_windows_global", "g5_roc_curve", "g7_threshold_sweep", "d9_score_percentile",
           "b8_label_by_intervals", "f11_forecast_baseline_score", "h1_param_grid"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_nested_loop_or_cartesian(spark, name):
    plan = plan_of(E.queries()[name](spark, SF_SMALL))
    assert "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan


def test_scan_is_pruned_and_filter_pushed(spark):
    plan = plan_of(E.queries()["a2_scan_columns"](spark, SF_SMALL))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert set(x.split(":")[0] for x in schema.split(",")) == {"ts", "value"}
    plan = plan_of(E.queries()["b9_filter_anomalies"](spark, SF_SMALL))
    assert "ts" not in re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
