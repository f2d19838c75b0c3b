"""Registered queries: sources (A), preparation (B), splits (C), statistics (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import positions as P
from vigil.operators import series as B
from vigil.operators import splits as S
from vigil.operators import stats as D
from vigil.operators import windows as W
from vigil.plans import jobs as J
from vigil.plans import oracle_sql as O
from vigil.plans.base import finish, query, r6
from vigil.session import output_dir
from vigil.sources import board as BD
from vigil.sources import catalog as C
from vigil.sources import files as FS

EV, EVU = O.EVENTS, O.EVENTS_BY_USER

# ------------------------------------------------------------------ A


@query("a1_scan_series", f"SELECT series_id, rid, ts, {r6('value', 'value')}, is_anomaly FROM ({EVU})")
def a1_scan_series(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events_by_user")
    return finish(df)


@query("a2_scan_columns", "SELECT ts, value FROM events")
def a2_scan_columns(spark, sf_dir):
    return C.scan_columns(spark, sf_dir, "events", ["ts", "value"])


@query("a3_dataset_catalog", " UNION ALL ".join(
    f"SELECT '{name}' AS dataset, count(*) AS n_rows, CAST(sum(is_anomaly) AS BIGINT) AS n_anomalies, "
    f"count(DISTINCT series_id) AS n_series FROM ({sql})" for name, sql in O.DATASETS.items()))
def a3_dataset_catalog(spark, sf_dir):
    out = None
    for name in O.DATASETS:
        df, _ = C.dataset(spark, sf_dir, name)
        r = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("is_anomaly").cast("bigint").alias("n_anomalies"),
                   F.countDistinct("series_id").alias("n_series")).select(F.lit(name).alias("dataset"), "*")
        out = r if out is None else out.unionByName(r)
    return out


_POS_KNN = f"""SELECT p.series_id, p.row_idx, {r6('k.score', 'score')}
FROM {O.with_pos(EV)} p JOIN {O.knn_1d_band(EV, 1)} k USING (series_id, rid)"""


@query("a5_write_read_scores", _POS_KNN)
def a5_write_read_scores(spark, sf_dir):
    """A5 then A4: keyed kNN scores written as CSV and read back with a schema."""
    df, _ = C.dataset(spark, sf_dir, "events")
    pos = P.row_index(df.select("series_id", "rid", "ts"), [], ["ts", "rid"])
    sc = J.knn_scores(df, [], 1).join(pos, "rid")
    path = output_dir(spark, "a5-scores")
    FS.write_scores(finish(sc.select("series_id", "row_idx", "score")), path)
    return FS.read_scores(spark, path)


@query("a6_write_scored_table", f"""SELECT s.series_id, s.rid, {r6('s.value', 'value')}, s.is_anomaly,
{r6('k.score', 'score')} FROM ({EVU}) s LEFT JOIN {O.knn_1d(EVU, 3)} k USING (series_id, rid)""")
def a6_write_scored_table(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events_by_user")
    sc = J.knn_scores(df, ["series_id"], 3)
    path = output_dir(spark, "a6-scored")
    FS.write_scored_table(finish(df.drop("ts")), finish(sc), ["series_id", "rid"], path)
    return spark.read.schema("series_id long, rid long, value double, is_anomaly int, score double") \
        .option("header", True).csv(path)


@query("a7_export_csv", f"SELECT series_id, rid, ts, {r6('value', 'value')}, is_anomaly FROM ({EV})")
def a7_export_csv(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events")
    path = output_dir(spark, "a7-export")
    FS.export_csv(finish(df), path)
    return FS.read_csv(spark, path, "series_id long, rid long, ts timestamp_ntz, value double, is_anomaly int")


def _board_sql():
    from vigil.plans.base import ORACLES
    return ORACLES["knn_events_by_user_board"]


@query("a8_leaderboard_upsert", f"""
WITH k AS ({_board_sql()}),
b AS (SELECT 'events_by_user' AS dataset, d AS detector FROM (SELECT unnest({list(BD.DETECTORS)}) AS d))
SELECT b.dataset, b.detector, k.f1, k.auroc FROM b LEFT JOIN k USING (dataset, detector)
""")
def a8_leaderboard_upsert(spark, sf_dir):
    """The reference's flow: read the dataset's board file, set the detector's cells, write a new version."""
    base = output_dir(spark, "a8-board")
    BD.write_board(BD.empty_board(spark, "events_by_user"), base, 0)
    board = BD.read_board(spark, f"{base}/v0")
    scored, flagged = J.knn_1d_scored_and_flagged(spark, sf_dir, "events_by_user", k=1, q=98.0)
    row = J.board_row(flagged, "events_by_user", "Knn", scores=scored)
    BD.write_board(BD.upsert(board, finish(row)), base, 1)
    return finish(BD.read_board(spark, f"{base}/v1"))


@query("a9_attach_scores", f"""SELECT s.series_id, s.rid, s.is_anomaly, {r6('k.score', 'score')}
FROM ({EVU}) s LEFT JOIN {O.knn_1d(EVU, 2)} k USING (series_id, rid)""")
def a9_attach_scores(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events_by_user")
    return finish(FS.attach_scores(df.select("series_id", "rid", "is_anomaly"), J.knn_scores(df, ["series_id"], 2),
                                   ["series_id", "rid"]))


# ------------------------------------------------------------------ B


@query("b1_drop_columns", f"SELECT series_id, rid, {r6('value', 'value')}, is_anomaly FROM ({EV})")
def b1_drop_columns(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events")
    return finish(B.drop_columns(df, ["ts"]))


@query("b2_rename_columns", "SELECT event_id AS rid, CASE WHEN event_type = 'error' THEN 'Attack' ELSE 'Normal' "
       "END AS is_anomaly FROM events")
def b2_rename_columns(spark, sf_dir):
    e = C.table(spark, sf_dir, "events")
    raw = e.select(F.col("event_id").alias("rid"),
                   F.when(F.col("event_type") == "error", "Attack").otherwise("Normal").alias("Normal/Attack"))
    return B.rename_columns(raw, {"Normal/Attack": "is_anomaly"})


@query("b3_cast_all_double", "SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id, "
       "value, CAST(CASE WHEN event_type = 'error' THEN '1' ELSE '0' END AS DOUBLE) AS label FROM events")
def b3_cast_all_double(spark, sf_dir):
    e = C.table(spark, sf_dir, "events").select(
        "event_id", "user_id", "value", F.when(F.col("event_type") == "error", "1").otherwise("0").alias("label"))
    return B.cast_all_double(e)


_TEXT = "CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END"


def _text_values(spark, sf_dir):
    e = C.table(spark, sf_dir, "events")
    txt = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return e.select(F.col("event_id").alias("rid"), txt.alias("value"))


@query("b4_to_numeric_coerce", f"SELECT event_id AS rid, TRY_CAST({_TEXT} AS DOUBLE) AS value FROM events")
def b4_to_numeric_coerce(spark, sf_dir):
    return B.to_numeric_coerce(_text_values(spark, sf_dir), ["value"])


@query("b5_dropna_subset", f"SELECT * FROM (SELECT event_id AS rid, TRY_CAST({_TEXT} AS DOUBLE) AS value "
       "FROM events) WHERE value IS NOT NULL")
def b5_dropna_subset(spark, sf_dir):
    return B.dropna_subset(B.to_numeric_coerce(_text_values(spark, sf_dir), ["value"]), ["value"])


@query("b6_recode_label", "SELECT event_id AS rid, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_anomaly "
       "FROM events")
def b6_recode_label(spark, sf_dir):
    e = C.table(spark, sf_dir, "events")
    raw = e.select(F.col("event_id").alias("rid"),
                   F.when(F.col("event_type") == "error", "Attack").otherwise("Normal").alias("is_anomaly"))
    return B.recode_label(raw, "is_anomaly").withColumn("is_anomaly", F.col("is_anomaly").cast("int"))


@query("b7_parse_timestamp", """SELECT event_id AS rid, strftime(ts, ' %d/%m/%Y %I:%M:%S %p') AS ts_text,
CAST(epoch(strptime(ltrim(strftime(ts, ' %d/%m/%Y %I:%M:%S %p')), '%d/%m/%Y %I:%M:%S %p')) AS BIGINT) AS epoch_s
FROM events""")
def b7_parse_timestamp(spark, sf_dir):
    e = C.table(spark, sf_dir, "events")
    t = e.select(F.col("event_id").alias("rid"), F.date_format("ts", " dd/MM/yyyy hh:mm:ss a").alias("ts_text"))
    p = B.parse_timestamp(t, "ts_text", " d/M/y h:mm:ss a", out="__ts")
    return p.select("rid", "ts_text", F.unix_timestamp("__ts").alias("epoch_s"))


@query("b8_label_by_interval", f"SELECT rid, is_anomaly FROM ({O.EVENTS_INTERVAL})")
def b8_label_by_interval(spark, sf_dir):
    e = C.table(spark, sf_dir, "events").select(F.col("event_id").alias("rid"), "ts")
    return B.label_by_interval(e, "ts", *C.INTERVAL).select("rid", "is_anomaly")


@query("b8_label_by_intervals", """SELECT e.event_id AS rid,
CASE WHEN EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase'
                  AND e.ts BETWEEN p.ts AND p.ts + INTERVAL 10 MINUTE) THEN 1 ELSE 0 END AS is_anomaly
FROM events e""")
def b8_label_by_intervals(spark, sf_dir):
    """B8 with many intervals: every purchase opens a 10-minute interval (a range join, bucketed by day)."""
    e = C.table(spark, sf_dir, "events")
    iv = e.filter(F.col("event_type") == "purchase").select(
        F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("end"))
    rows = e.select(F.col("event_id").alias("rid"), "ts")
    return B.label_by_intervals(rows, "ts", iv).select("rid", "is_anomaly")


@query("b9_filter_anomalies", f"SELECT series_id, rid, {r6('value', 'value')} FROM ({EV}) WHERE is_anomaly = 1")
def b9_filter_anomalies(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events")
    return finish(B.filter_anomalies(df).select("series_id", "rid", "value"))


@query("b10_select_channels", f"SELECT rid, l_partkey, l_suppkey, l_quantity, l_discount, l_tax FROM ({O.LINEITEM})")
def b10_select_channels(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "lineitem")
    return B.select_channels(df, ["l_quantity", "l_discount", "l_quantity", "l_tax"], keep=list(C.LINE_KEY))


@query("b11_features_labels", f"SELECT rid, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
       f"is_anomaly FROM ({O.LINEITEM})")
def b11_features_labels(spark, sf_dir):
    df, spec = C.dataset(spark, sf_dir, "lineitem")
    feats, label = B.features_labels(df, spec)
    return df.select(*spec.key_cols(), *feats, label)


def _events_pos(spark, sf_dir, name="events"):
    df, _ = C.dataset(spark, sf_dir, name)
    return P.row_index(df, ["series_id"] if name.endswith("_by_user") else [], ["ts", "rid"])


@query("b13_head_rows", f"SELECT rid, row_idx FROM {O.with_pos(EV)} WHERE row_idx < 5000")
def b13_head_rows(spark, sf_dir):
    return B.head_rows(_events_pos(spark, sf_dir), 5000).select("rid", "row_idx")


@query("b14_positional_slice", f"SELECT rid, row_idx FROM {O.with_pos(EV)} WHERE row_idx >= 4000 AND row_idx < 9970")
def b14_positional_slice(spark, sf_dir):
    return B.positional_slice(_events_pos(spark, sf_dir), 4000, 9970).select("rid", "row_idx")


# ------------------------------------------------------------------ C


@query("c1_split_fraction", f"""SELECT series_id, rid, row_idx,
CAST(row_idx < floor(0.4 * count(*) OVER (PARTITION BY series_id)) AS INTEGER) AS is_train
FROM {O.with_pos(EVU)}""")
def c1_split_fraction(spark, sf_dir):
    p = _events_pos(spark, sf_dir, "events_by_user")
    return S.split_fraction(p, ["series_id"], 0.4).select("series_id", "rid", "row_idx", "is_train")


@query("c2_split_at", f"SELECT rid, CAST(row_idx >= 6000 AS INTEGER) AS is_train FROM {O.with_pos(EV)}")
def c2_split_at(spark, sf_dir):
    return S.split_at(_events_pos(spark, sf_dir), 6000, reverse=True).select("rid", "is_train")


@query("c2_split_at_forward", f"SELECT rid, CAST(row_idx < 4000 AS INTEGER) AS is_train FROM {O.with_pos(EV)}")
def c2_split_at_forward(spark, sf_dir):
    """Train on the first 4000 rows (the reversed variant is c2_split_at)."""
    return S.split_at(_events_pos(spark, sf_dir), 4000).select("rid", "is_train")


@query("c3_split_random", f"SELECT rid, CAST({O.unit(chr(39) + '42' + chr(39), chr(39) + 'split' + chr(39), 'rid')} < 0.2 AS INTEGER) AS is_test FROM ({O.EMBEDDINGS})")
def c3_split_random(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "embeddings")
    return S.split_random(df.select("rid"), "rid", 0.2, 42)


@query("c4_split_tail_validation", f"""SELECT series_id, win_start,
CAST(win_start >= floor(count(*) OVER (PARTITION BY series_id) * 0.9) AS INTEGER) AS is_validation
FROM {O.windows(EVU, 24, 1)} WHERE full_marker IS NOT NULL""")
def c4_split_tail_validation(spark, sf_dir):
    p = _events_pos(spark, sf_dir, "events_by_user")
    w = W.sequences_with_next(p, ["series_id"], "value", 24)
    return S.split_tail_validation(w, ["series_id"], 0.1).select("series_id", "win_start", "is_validation")


@query("c5_kfold", f"""SELECT rid, {O.kfold_expr('row_idx', 'count(*) OVER ()', 5)} AS fold
FROM {O.with_pos(EV)}""")
def c5_kfold(spark, sf_dir):
    return S.kfold(_events_pos(spark, sf_dir), [], 5).select("rid", "fold")


# ------------------------------------------------------------------ D


@query("d1_zscore_filter", f"""SELECT series_id, rid FROM (SELECT *, avg(value) OVER (PARTITION BY series_id) AS m,
stddev_pop(value) OVER (PARTITION BY series_id) AS s FROM ({EVU}))
WHERE abs(CASE WHEN s > 0 THEN (value - m) / s ELSE 0.0 END) < 3.0""")
def d1_zscore_filter(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events_by_user")
    return D.zscore_filter(df, ["series_id"], "value", 3.0).select("series_id", "rid")


_CH = list(C.LINE_CHANNELS)


@query("d2_standard_scale", "SELECT rid, l_partkey, l_suppkey, " + ", ".join(
    f"round((({c}) - avg({c}) OVER ()) / (CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () "
    f"ELSE 1.0 END), 6) AS {c}" for c in _CH) + f" FROM ({O.LINEITEM})")
def d2_standard_scale(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "lineitem")
    return finish(D.standard_scale(df.select(*C.LINE_KEY, *_CH), [], _CH))


_TRAIN_STATS = f"""(SELECT avg(value) AS m, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1.0 END AS s
FROM {O.with_pos(EV)} WHERE row_idx < 4000)"""


def _d3(spark, sf_dir):
    p = _events_pos(spark, sf_dir)
    model = D.scale_fit(B.head_rows(p, 4000), [], ["value"])
    return p, model, D.scale_apply(p, model, [], ["value"])


@query("d3_standard_scale_train_test", f"SELECT rid, round((value - m) / s, 6) AS value FROM ({EV}), {_TRAIN_STATS}")
def d3_standard_scale_train_test(spark, sf_dir):
    return finish(_d3(spark, sf_dir)[2].select("rid", "value"))


@query("d4_inverse_scale", f"SELECT rid, round(((value - m) / s) * s + m, 6) AS value FROM ({EV}), {_TRAIN_STATS}")
def d4_inverse_scale(spark, sf_dir):
    _, model, scaled = _d3(spark, sf_dir)
    return finish(D.scale_apply(scaled, model, [], ["value"], inverse=True).select("rid", "value"))


@query("d5_zscore_sample_drop_constant", "SELECT rid, l_partkey, l_suppkey, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}" for c in _CH)
    + f" FROM ({O.LINEITEM})")
def d5_zscore_sample_drop_constant(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "lineitem")
    d = df.select(*C.LINE_KEY, *_CH, (F.col("l_tax") * 0.0).alias("l_flat"))
    out, _kept = D.zscore_sample_drop_constant(d, _CH + ["l_flat"])
    return finish(out)


@query("d6_zscore_population_column", f"""SELECT rid, round((value - avg(value) OVER ()) /
stddev_pop(value) OVER (), 6) AS value FROM ({EV})""")
def d6_zscore_population_column(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events")
    return finish(D.standard_scale(df.select("rid", "value"), [], ["value"]))


@query("d7_range_stats", f"SELECT series_id, {r6('min(value)', 'min_value')}, {r6('max(value)', 'max_value')} "
       f"FROM ({EVU}) GROUP BY series_id")
def d7_range_stats(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events_by_user")
    return finish(D.range_stats(df, ["series_id"], "value"))


@query("d8_contamination", " UNION ALL ".join(
    [f"SELECT '{n}' AS dataset, greatest(avg(CAST(is_anomaly AS DOUBLE)), 4.9e-324) AS contamination FROM ({s})"
     for n, s in O.DATASETS.items() if n != "embeddings"]
    + [f"SELECT 'events_weak_capped' AS dataset, least(greatest(avg(CAST(is_anomaly AS DOUBLE)), 4.9e-324), 0.1) "
       f"AS contamination FROM ({O.EVENTS_WEAK})"]))
def d8_contamination(spark, sf_dir):
    out = None
    for n in [n for n in O.DATASETS if n != "embeddings"] + ["events_weak_capped"]:
        src = "events_weak" if n == "events_weak_capped" else n
        df, _ = C.dataset(spark, sf_dir, src)
        r = D.contamination(df, [], cap=0.1 if n == "events_weak_capped" else None)
        r = r.select(F.lit(n).alias("dataset"), "contamination")
        out = r if out is None else out.unionByName(r)
    return out


@query("d10_max_normalise", f"SELECT series_id, rid, round(value / max(value) OVER (PARTITION BY series_id), 6) "
       f"AS value FROM ({EVU})")
def d10_max_normalise(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events_by_user")
    return finish(D.max_normalise(df.select("series_id", "rid", "value"), ["series_id"], "value"))


@query("d11_standardised_error", f"""SELECT series_id, rid, round(abs(value - avg(value) OVER (PARTITION BY series_id))
/ stddev_samp(value) OVER (PARTITION BY series_id), 6) AS value FROM ({EVU})""")
def d11_standardised_error(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events_by_user")
    return finish(D.standardised_error(df.select("series_id", "rid", "value"), ["series_id"], "value"))


@query("d12_row_and_label_counts", f"""SELECT series_id, count(*) AS n_rows, CAST(count_if(is_anomaly = 1) AS BIGINT) AS n_anomalies,
CAST(count_if(value > 400.0) AS BIGINT) AS n_flagged FROM ({EVU}) GROUP BY series_id""")
def d12_row_and_label_counts(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events_by_user")
    d = df.withColumn("flag", (F.col("value") > 400.0).cast("int"))
    return D.row_and_label_counts(d, ["series_id"], flag="flag")


@query("d13_outlier_share", f"SELECT series_id, {r6('avg(CAST(is_anomaly AS DOUBLE))', 'outlier_share')} "
       f"FROM ({EVU}) GROUP BY series_id")
def d13_outlier_share(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events_by_user")
    return finish(D.outlier_share(df, ["series_id"]))
