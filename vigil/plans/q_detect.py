"""Registered queries: windows (E) and detectors (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import flags as FL
from vigil.operators import forecast as FC
from vigil.operators import forest as FR
from vigil.operators import lsh as LSH
from vigil.operators import neighbors as NB
from vigil.operators import positions as P
from vigil.operators import reconstruct as RC
from vigil.operators import splits as S
from vigil.operators import stats as D
from vigil.operators import windows as W
from vigil.plans import jobs as J
from vigil.plans import oracle_sql as O
from vigil.plans.base import finish, query, r6
from vigil.session import discard, materialize, output_dir, shuffle_partitions, written_tables
from vigil.sources import catalog as C
from vigil.sources import files as FS

dbl = lambda x: f"CAST({x!r} AS DOUBLE)"

EV, EVU = O.EVENTS, O.EVENTS_BY_USER
UK = ["series_id"]   # one series per user
GK: list = []         # one long series: no series key (stats attach as scalar subqueries)


def positioned(spark, sf_dir, name="events"):
    df, _ = C.dataset(spark, sf_dir, name)
    return P.row_index(df, (UK if name.endswith("_by_user") else GK), ["ts", "rid"])


def _summary(w, by=True):
    s = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    cols = (["series_id"] if by else []) + ["win_start"]
    return finish(w.select(*cols, F.size("window").alias("n_window"), s.alias("window_sum"),
                           F.element_at("window", 1).alias("window_first"),
                           F.element_at("window", -1).alias("window_last"),
                           F.element_at("target", 1).alias("target")))


def _win_sql(src, w, p, by="series_id"):
    cols = f"{by + ', ' if by else ''}win_start"
    return f"""SELECT {cols}, n_window, {r6('window_sum', 'window_sum')}, {r6('window_first', 'window_first')},
    {r6('window_last', 'window_last')}, {r6('target', 'target')} FROM {O.windows(src, w, p, by)}
    WHERE full_marker IS NOT NULL"""


# ------------------------------------------------------------------ E


@query("e1_sliding_windows_by_user", _win_sql(EVU, 30, 1))
def e1_sliding_windows_by_user(spark, sf_dir):
    return _summary(W.sliding_windows(positioned(spark, sf_dir, "events_by_user"), UK, ["value"], 30, 1))


@query("e1_sliding_windows_global", _win_sql(EV, 45, 1, by=""))
def e1_sliding_windows_global(spark, sf_dir):
    return _summary(W.sliding_windows(positioned(spark, sf_dir), GK, ["value"], 45, 1), by=False)


@query("e1_sliding_windows_short", _win_sql(EV, 45, 1, by="").replace(
    "WHERE full_marker IS NOT NULL", f"WHERE full_marker IS NOT NULL AND win_start < (SELECT count(*) FROM ({EV})) - 46"))
def e1_sliding_windows_short(spark, sf_dir):
    """E1 variant with one window fewer (n - w - p windows)."""
    return _summary(W.sliding_windows(positioned(spark, sf_dir), GK, ["value"], 45, 1, short=True), by=False)


@query("e2_sequences_with_next", _win_sql(EV, 24, 1, by=""))
def e2_sequences_with_next(spark, sf_dir):
    return _summary(W.sequences_with_next(positioned(spark, sf_dir), GK, "value", 24), by=False)


_LI_ORDER = ", ".join(C.LINE_ORDER)
_LI_POS = O.with_pos(O.LINEITEM, order=_LI_ORDER)


@query("e3_sequences", f"""SELECT win_start, n_window, {r6('qty_sum', 'qty_sum')}, {r6('tax_last', 'tax_last')} FROM (
SELECT row_idx AS win_start, CAST(count(*) OVER w AS INTEGER) AS n_window, sum(l_quantity) OVER w AS qty_sum,
       lead(l_tax, 29) OVER (ORDER BY row_idx) AS tax_last, lead(l_tax, 30) OVER (ORDER BY row_idx) AS nxt
FROM {_LI_POS} WINDOW w AS (ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)) WHERE nxt IS NOT NULL""")
def e3_sequences(spark, sf_dir):
    df, spec = C.dataset(spark, sf_dir, "lineitem")
    p = P.row_index(df, GK, list(spec.order))
    w = W.sequences(p, GK, list(spec.values), 30)
    return finish(w.select("win_start", F.size("window").alias("n_window"),
                           F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0]).alias("qty_sum"),
                           F.element_at("window", -1)[3].alias("tax_last")))


@query("e4_lag_features", f"""SELECT series_id, row_idx, {r6('l5', 'first_lag')}, {r6('l1+l2+l3+l4+l5', 'lag_sum')} FROM (
SELECT series_id, row_idx, lag(value, 5) OVER w AS l5, lag(value, 4) OVER w AS l4, lag(value, 3) OVER w AS l3,
       lag(value, 2) OVER w AS l2, lag(value, 1) OVER w AS l1
FROM {O.with_pos(EVU)} WINDOW w AS (PARTITION BY series_id ORDER BY row_idx)) WHERE l5 IS NOT NULL""")
def e4_lag_features(spark, sf_dir):
    lf = W.lag_features(positioned(spark, sf_dir, "events_by_user"), UK, ["value"], 5)
    return finish(lf.select("series_id", "row_idx", F.col("features")[0].alias("first_lag"),
                            F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("lag_sum")))


_WMEAN = f"(SELECT win_start, window_sum / 45.0 AS score FROM {O.windows(EV, 45, 1, '')} WHERE full_marker IS NOT NULL)"


def _window_means(p):
    w = W.sliding_windows(p, GK, ["value"], 45, 1)
    return w.select("win_start", (F.aggregate("window", F.lit(0.0), lambda a, x: a + x) / F.lit(45.0)).alias("score"))


@query("e5_reverse_windowing", f"""SELECT row_idx, round(avg(score) OVER (ORDER BY row_idx ROWS BETWEEN 45 PRECEDING
AND CURRENT ROW), 6) AS score FROM (SELECT r.row_idx, ws.score FROM {O.with_pos(EV)} r
LEFT JOIN {_WMEAN} ws ON ws.win_start = r.row_idx)""")
def e5_reverse_windowing(spark, sf_dir):
    p = positioned(spark, sf_dir)
    return finish(W.reverse_windowing(p, _window_means(p), GK, 46).select("row_idx", "score"))


@query("e6_align_window_score", f"""SELECT r.rid, r.row_idx, {r6('ws.score', 'score')} FROM {O.with_pos(EV)} r
JOIN {_WMEAN} ws ON r.row_idx = ws.win_start + 45""")
def e6_align_window_score(spark, sf_dir):
    p = positioned(spark, sf_dir)
    return finish(W.align_window_score(p.select("series_id", "rid", "row_idx"), _window_means(p), GK, 45)
                  .select("rid", "row_idx", "score"))


# ------------------------------------------------------------------ F (neighbours)


@query("f1_knn_multid", f"SELECT rid, {r6('d', 'score')} FROM ({O.edges_vec(O.EMBEDDINGS, O.EMBEDDINGS, 11)}) "
       "QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d DESC, nid DESC) = 1")
def f1_knn_multid(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "embeddings")
    return finish(NB.knn_score(df, GK, "rid", "vec", 11).select("rid", "score"))


@query("f1_knn_multid_manhattan", f"SELECT rid, {r6('d', 'score')} FROM "
       f"({O.edges_vec(O.EMBEDDINGS, O.EMBEDDINGS, 5, p=1)}) "
       "QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d DESC, nid DESC) = 1")
def f1_knn_multid_manhattan(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "embeddings")
    return finish(NB.knn_score(df, GK, "rid", "vec", 5, p=1.0).select("rid", "score"))


def _wide(spark, sf_dir):
    """Standardised channels of the wide table as (row_idx, vec): lineitem keys repeat, positions do not."""
    df, spec = C.dataset(spark, sf_dir, "lineitem")
    ch = list(spec.values)
    p = P.row_index(df.select(*C.LINE_KEY, *ch), GK, list(spec.order))
    return D.standard_scale(p, GK, ch).select("row_idx", F.array(*ch).alias("vec"))


def wide_knn(spark, sf_dir, k=11, block_rows=4096):
    """Exact kNN on the standardised wide table, keyed by position."""
    return NB.knn_score(_wide(spark, sf_dir), GK, "row_idx", "vec", k, block_rows=block_rows)


@query("f3_knn_wide_exact")
def f3_knn_wide_exact(spark, sf_dir):
    """Rows-only (all pairs are too many for SQL; f3_knn_wide_search has it for every 50th row):
    the plant-scale kNN path, exact k=11 on the standardised 4-channel table."""
    return wide_knn(spark, sf_dir)


_WIDE_SQL = "(SELECT row_idx, [" + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()" for c in C.LINE_CHANNELS) + f"] AS vec FROM {_LI_POS})"
_EVERY = 50          # queries: positions divisible by this, against all rows


@query("f3_knn_wide_search", f"""WITH v AS MATERIALIZED {_WIDE_SQL},
e AS (SELECT a.row_idx, list_distance(a.vec, b.vec) AS d FROM v a JOIN v b ON a.row_idx % {_EVERY} = 0 AND a.row_idx <> b.row_idx)
SELECT row_idx, round(list_sort(min(d, 11))[11], 6) AS score FROM e GROUP BY row_idx""")
def f3_knn_wide_search(spark, sf_dir):
    """Exact search: 11th neighbour distance of every 50th row among all rows."""
    v = _wide(spark, sf_dir)
    e = NB.knn_edges(v.filter(F.col("row_idx") % _EVERY == 0), v, GK, "row_idx", "vec", 11)
    return finish(NB.kth_distance(e, GK, "row_idx", 11))


def _lsh_sql(k, tables=4, hashes=3, per_bucket=400.0):
    dirs, shifts = LSH.directions(len(C.LINE_CHANNELS), tables, hashes)
    dot = lambda a: "(" + " + ".join(f"vec[{i + 1}] * {dbl(c)}" for i, c in enumerate(a)) + ")"
    spread = "(" + " + ".join(f"stddev_pop({dot(a)})" for t in dirs for a in t) + f") / {tables * hashes}"
    slab = lambda a, b: f"CAST(floor({dot(a)} / w + {dbl(b)}) AS BIGINT)"
    rows = " UNION ALL ".join(f"SELECT row_idx, vec, {i} AS t, " + ", ".join(f"{slab(a, b)} AS s{j}" for j, (a, b) in enumerate(zip(dirs[i], shifts[i])))
                              + " FROM v, width" for i in range(tables))
    near = [[(step if j == h else 0) for j in range(hashes)] for h in range(hashes) for step in (-1, 1)]
    probes = " UNION ALL ".join("SELECT row_idx, t, " + ", ".join(f"s{j} + ({d}) AS s{j}" for j, d in enumerate(o)) + f" FROM r WHERE row_idx % {_EVERY} = 0"
                                for o in [[0] * hashes, *near])
    on = " AND ".join(["p.t = r.t", *[f"p.s{j} = r.s{j}" for j in range(hashes)]])
    return f"""WITH v AS MATERIALIZED {_WIDE_SQL},
    width AS (SELECT round(4.0::DOUBLE * {spread} * pow({per_bucket}::DOUBLE / count(*), 1.0::DOUBLE / {hashes}), 6) AS w FROM v),
    r AS MATERIALIZED ({rows}), p AS ({probes}),
    c AS (SELECT DISTINCT p.row_idx, r.row_idx AS nid FROM p JOIN r ON {on} WHERE p.row_idx <> r.row_idx),
    x AS (SELECT a.row_idx, b.row_idx AS nid, list_distance(a.vec, b.vec) AS d FROM v a JOIN v b ON a.row_idx % {_EVERY} = 0 AND a.row_idx <> b.row_idx),
    e AS (SELECT row_idx, unnest(min({{'d': d, 'nid': nid}}, {k})) AS n FROM x GROUP BY row_idx)
    SELECT count(DISTINCT e.row_idx) AS queries, count(*) AS neighbours, count(c.nid) AS found,
      round(count(c.nid) / count(*)::DOUBLE, 6) AS recall, count(c.nid) >= 0.9 * count(*) AS enough
    FROM e LEFT JOIN c ON c.row_idx = e.row_idx AND c.nid = e.n.nid"""


@query("f3_knn_lsh", _lsh_sql(11))
def f3_knn_lsh(spark, sf_dir):
    """Approximate search for every 50th row among all rows, and its recall against the exact search."""
    wide = _wide(spark, sf_dir)
    v = materialize(wide, "wide-vectors")
    discard(written_tables(wide), v)
    q = v.filter(F.col("row_idx") % _EVERY == 0)
    found = LSH.knn_lsh(q, v, "row_idx", "vec", 11, LSH.fit(v, "vec", len(C.LINE_CHANNELS)))
    r = LSH.recall(found, NB.knn_edges(q, v, GK, "row_idx", "vec", 11, written=True), "row_idx")
    discard(written_tables(v), r)                                       # the search has its own copy by cells
    return finish(r.withColumn("enough", F.col("found") >= 0.9 * F.col("neighbours")))


@query("f4_loop_by_user", f"SELECT series_id, rid, {r6('score', 'score')} FROM "
       f"{O.loop_from_edges(O.edges_1d(EVU, 20))}")
def f4_loop_by_user(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events_by_user")
    return finish(NB.loop_1d(df, UK, "value", "rid", k=20))


@query("f4_loop_multid", f"SELECT rid, {r6('score', 'score')} FROM "
       f"{O.loop_from_edges(O.edges_vec(O.EMBEDDINGS, O.EMBEDDINGS, 20))}")
def f4_loop_multid(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "embeddings")
    return finish(NB.loop_vec(df, GK, "rid", "vec", k=20))


def _band_edges(src, k):
    """k nearest others among the 2k rows around each row in value order (ties: position gap, then position)."""
    p = O.with_pos(src, order="value, rid", name="vp")
    return f"""SELECT series_id, rid, nid, d FROM (SELECT a.series_id, a.rid, b.rid AS nid, abs(a.value - b.value) AS d,
        row_number() OVER (PARTITION BY a.series_id, a.rid ORDER BY abs(a.value - b.value), abs(a.vp - b.vp), b.vp) AS rn
        FROM {p} a JOIN {p} b ON a.series_id = b.series_id AND b.vp BETWEEN a.vp - {k} AND a.vp + {k} AND b.vp <> a.vp) WHERE rn <= {k}"""


@query("f2_knn_1d_large_k", f"SELECT rid, {r6('max(d)', 'score')} FROM ({_band_edges(EV, 2000)}) GROUP BY rid HAVING count(*) = 2000")
def f2_knn_1d_large_k(spark, sf_dir):
    """2000th neighbour distance on one column."""
    df, _ = C.dataset(spark, sf_dir, "events")
    return finish(NB.knn_score_1d(df, GK, "value", "rid", 2000).select("rid", "score").filter(F.col("score").isNotNull()))


@query("f4_loop_large_k", f"SELECT rid, {r6('score', 'score')} FROM {O.loop_from_edges(_band_edges(EV, 2000))}")
def f4_loop_large_k(spark, sf_dir):
    """LoOP with 2000 neighbours on one column."""
    df, _ = C.dataset(spark, sf_dir, "events")
    return finish(NB.loop_1d(df, GK, "value", "rid", k=2000).select("rid", "score"))


_FAR_EDGES = f"""SELECT series_id, rid, nid, d FROM (SELECT a.series_id, a.rid, b.rid AS nid, list_distance(a.vec, b.vec) AS d,
    row_number() OVER (PARTITION BY a.rid ORDER BY list_distance(a.vec, b.vec), b.rid) AS rn, count(*) OVER (PARTITION BY a.rid) + 1 AS n
    FROM ({O.EMBEDDINGS}) a JOIN ({O.EMBEDDINGS}) b ON a.rid <> b.rid) WHERE rn <= n - 100"""


@query("f4_loop_far_k", f"SELECT rid, {r6('score', 'score')} FROM {O.loop_from_edges(_FAR_EDGES)}")
def f4_loop_far_k(spark, sf_dir):
    """LoOP on vectors with all but 100 rows as neighbours."""
    df, _ = C.dataset(spark, sf_dir, "embeddings")
    return finish(NB.loop_vec_far(df, GK, "rid", "vec", 100).select("rid", "score"))


def _fold_split(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "embeddings")
    p = P.row_index(df, GK, ["rid"])
    return S.kfold(p, GK, 5)


_EMB_FOLDS = (f"SELECT *, {O.kfold_expr('row_idx', 'count(*) OVER ()', 5)} AS fold FROM "
              f"{O.with_pos(O.EMBEDDINGS, order='rid')}")


def _vote_sql(edges, k):
    return f"""SELECT rid, arg_max(class_label, n * 100 - class_label) AS pred FROM (
        SELECT e.rid, t.class_label, count(*) AS n FROM ({edges}) e JOIN ({_EMB_FOLDS}) t ON t.rid = e.nid
        WHERE e.rk <= {k} GROUP BY e.rid, t.class_label) GROUP BY rid"""


def _ranked_edges_sql(q, r, k, p=2):
    return f"SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, nid) AS rk FROM ({O.edges_vec(q, r, k, p, False)})"


@query("f19_knn_classify", _vote_sql(_ranked_edges_sql(f"SELECT * FROM ({_EMB_FOLDS}) WHERE fold = 0",
                                                       f"SELECT * FROM ({_EMB_FOLDS}) WHERE fold <> 0", 5), 5))
def f19_knn_classify(spark, sf_dir):
    d = _fold_split(spark, sf_dir)
    test, train = d.filter(F.col("fold") == 0), d.filter(F.col("fold") != 0)
    pred = NB.knn_classify(train, test, GK, "rid", "vec", "class_label", 5)
    return pred.select("rid", "pred")


# ------------------------------------------------------------------ F (forest)


def _forest(spark, sf_dir, n_trees=100, psi=256):
    df, spec = C.dataset(spark, sf_dir, "lineitem")
    nodes, psi = FR.iforest_fit(df, list(C.LINE_KEY), list(spec.values), n_trees=n_trees, max_samples=psi, seed=42)
    return df, spec, nodes, psi


FOREST = (O.LINEITEM_SRC, list(C.LINE_KEY), list(C.LINE_CHANNELS))


@query("f5_iforest_fit", O.forest_nodes(*FOREST, 100, 256))
def f5_iforest_fit(spark, sf_dir):
    """Node table (tree, node, feature, threshold, left, right, size, depth) of 100 trees of 256 rows."""
    return finish(_forest(spark, sf_dir)[2])


@query("f6_iforest_score", O.forest_scores(*FOREST, ", ".join([*C.LINE_KEY, *C.LINE_CHANNELS, "is_anomaly"]), 100, 256))
def f6_iforest_score(spark, sf_dir):
    """Isolation-forest score for every lineitem row."""
    df, spec, nodes, psi = _forest(spark, sf_dir)
    scored = FR.iforest_score(df.select(*C.LINE_KEY, *spec.values, "is_anomaly"), nodes, psi, list(spec.values),
                              partitions=shuffle_partitions(spark))
    return scored.withColumn("score", F.round("score", 6))


@query("h5_seeded", """SELECT * FROM (VALUES (1, CAST(0 AS BIGINT)), (2, CAST(0 AS BIGINT))) t(run, differing_nodes)""")
def h5_seeded(spark, sf_dir):
    """Equal seeds give equal forests under two other partitionings of the whole table: nodes that differ."""
    df, spec = C.dataset(spark, sf_dir, "lineitem")
    fit = lambda d: FR.iforest_fit(d, list(C.LINE_KEY), list(spec.values), n_trees=50, max_samples=256, seed=42)[0]
    nodes, out = fit(df), None
    for run, other in ((1, df.repartition(5)), (2, df.repartition(11, "l_partkey"))):
        twin = fit(other)
        diff = nodes.exceptAll(twin).unionByName(twin.exceptAll(nodes)).agg(F.count(F.lit(1)).alias("differing_nodes"))
        diff = diff.select(F.lit(run).alias("run"), "differing_nodes")
        out = diff if out is None else out.unionByName(diff)
    return out


@query("f7_contamination_label", f"""SELECT series_id, rid, flag FROM
(SELECT k.*, CASE WHEN k.score > t.th THEN 1 ELSE 0 END AS flag FROM {O.knn_1d(EVU, 5)} k JOIN
 (SELECT series_id, quantile_cont(score, 0.95) AS th FROM {O.knn_1d(EVU, 5)} GROUP BY series_id) t USING (series_id))""")
def f7_contamination_label(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events_by_user")
    s = materialize(NB.knn_score_1d(df, UK, "value", "rid", 5), "knn-scores")
    return FL.contamination_label(s, UK, "score", 0.05).select("series_id", "rid", "flag")


@query("a11_model_roundtrip", O.forest_scores(*FOREST, ", ".join(C.LINE_KEY), 50, 256))
def a11_model_roundtrip(spark, sf_dir):
    """Fit a forest, save its node table, load it back and score with the loaded model."""
    df, spec, nodes, psi = _forest(spark, sf_dir, n_trees=50)
    path = output_dir(spark, "a11-forest")
    FS.save_forest(nodes, psi, path)
    nodes2, psi2 = FS.load_forest(spark, path)
    scored = FR.iforest_score(df.select(*C.LINE_KEY, *spec.values), nodes2, psi2, list(spec.values))
    return scored.select(*C.LINE_KEY, F.round("score", 6).alias("score"))


# ------------------------------------------------------------------ F (forecast / reconstruction)


@query("f8_forecast_fit")
def f8_forecast_fit(spark, sf_dir):
    """Rows-only: Huber linear forecaster on 10 lags, trained on the first 75 % of the series,
    saved and reloaded (A11) before its coefficients are reported."""
    p = positioned(spark, sf_dir, "events_collective")
    train = S.split_fraction(p, GK, 0.75).filter("is_train = 1")
    from pyspark.ml.regression import LinearRegressionModel
    fitted = FC.forecast_fit(train, GK, ["value"], 10)["value"]
    path = output_dir(spark, "f8-model")
    m = FS.load_ml_model(LinearRegressionModel, FS.save_ml_model(fitted, path))   # A11 round trip
    rows = [(i, float(c)) for i, c in enumerate(m.coefficients.toArray())] + [(-1, float(m.intercept))]
    return spark.createDataFrame(rows, "lag_index int, coefficient double")


@query("f9_forecast_predict")
def f9_forecast_predict(spark, sf_dir):
    """Rows-only: predictions and F10 errors for every row with 10 predecessors."""
    p = positioned(spark, sf_dir, "events_collective")
    train = S.split_fraction(p, GK, 0.75).filter("is_train = 1")
    models = FC.forecast_fit(train, GK, ["value"], 10)
    pred = FC.forecast_predict(p, models, GK, ["value"], 10)
    return FC.forecast_error(pred, ["value"]).select("row_idx", "value__pred", "error")


@query("f8_forecast_fit_gbt")
def f8_forecast_fit_gbt(spark, sf_dir):
    """Rows-only: absolute-loss boosted trees with a validation-based stop; predictions and errors."""
    p = positioned(spark, sf_dir, "events_collective")
    train = S.split_fraction(p, GK, 0.75).filter("is_train = 1")
    models = FC.forecast_fit(train, GK, ["value"], 10, model="gbt", max_iter=30)
    pred = FC.forecast_predict(p, models, GK, ["value"], 10)
    return FC.forecast_error(pred, ["value"]).select("row_idx", "value__pred", "error")


@query("f10_forecast_error", f"""SELECT win_start, {r6('abs(t - l)', 'error')} FROM (SELECT row_idx AS win_start,
lead(value, 9) OVER (ORDER BY row_idx) AS l, lead(value, 10) OVER (ORDER BY row_idx) AS t FROM {O.with_pos(EV)})
WHERE t IS NOT NULL""")
def f10_forecast_error(spark, sf_dir):
    w = W.sliding_windows(positioned(spark, sf_dir), GK, ["value"], 10, 1)
    return finish(FC.window_forecast_error(w, "last").select("win_start", "error"))


def f11_sql(src, w=45):
    ws = O.windows(src, w, 1, "")
    return f"""(WITH e AS (SELECT win_start, abs(target - window_sum / {w}.0) AS err FROM {ws}
                WHERE full_marker IS NOT NULL),
    z AS (SELECT win_start, abs(err - avg(err) OVER ()) / stddev_samp(err) OVER () AS score FROM e),
    r AS (SELECT p.row_idx, avg(z.score) OVER (ORDER BY p.row_idx ROWS BETWEEN {w} PRECEDING AND CURRENT ROW) AS s
          FROM {O.with_pos(src)} p LEFT JOIN z ON z.win_start = p.row_idx)
    SELECT row_idx, s / max(s) OVER () AS score FROM r)"""


F11 = f11_sql(O.EVENTS_COLLECTIVE)


def f11_scores(spark, sf_dir):
    p = positioned(spark, sf_dir, "events_collective")
    s = FC.forecast_baseline_score(p, GK, "value", 45, 1)
    return materialize(p.select("series_id", "row_idx", "is_anomaly").join(s, GK + ["row_idx"]), "f11-scored")


@query("f11_forecast_baseline_score", f"SELECT row_idx, {r6('score', 'score')} FROM {F11}")
def f11_forecast_baseline_score(spark, sf_dir):
    return finish(f11_scores(spark, sf_dir).select("row_idx", "score"))


def _pca(spark, sf_dir):
    p = positioned(spark, sf_dir)
    w = W.sequences_with_next(p, GK, "value", 24)
    w = RC.flatten_window(w)
    train = w.filter(F.col("win_start") < 4000)
    model = RC.reconstruct_fit(train, rank=4)
    return w, model


@query("f12_reconstruct_fit")
def f12_reconstruct_fit(spark, sf_dir):
    """Rows-only: the linear autoencoder (window mean and 4 principal components)."""
    _, m = _pca(spark, sf_dir)
    rows = [(i, float(m["mean"][i]), [float(x) for x in m["pc"][i]]) for i in range(len(m["mean"]))]
    return spark.createDataFrame(rows, "position int, mean double, components array<double>")


@query("f13_reconstruct_predict")
def f13_reconstruct_predict(spark, sf_dir):
    """Rows-only: rebuilt windows and their F15 error for every window."""
    w, m = _pca(spark, sf_dir)
    r = RC.reconstruct_predict(w, m)
    return RC.window_mae(r).select("win_start", "mae")


def _band_mae_sql(src, w, col, order="ts, rid"):
    pos = O.with_pos(src, order=order)
    return f"""(SELECT a.row_idx AS win_start, avg(abs(b.{col} - a.m)) AS mae FROM
    (SELECT row_idx, avg({col}) OVER (ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS m,
            lead({col}, {w}) OVER (ORDER BY row_idx) AS nxt FROM {pos}) a
    JOIN {pos} b ON b.row_idx BETWEEN a.row_idx AND a.row_idx + {w - 1} WHERE a.nxt IS NOT NULL
    GROUP BY a.row_idx)"""


def _mean_recon(w, col="flat", out="recon"):
    m = F.aggregate(col, F.lit(0.0), lambda a, x: a + x) / F.size(col)
    return w.withColumn(out, F.transform(col, lambda x: m))


@query("f15_window_mae", f"SELECT win_start, {r6('mae', 'mae')} FROM {_band_mae_sql(EV, 30, 'value')}")
def f15_window_mae(spark, sf_dir):
    w = RC.flatten_window(W.sequences_with_next(positioned(spark, sf_dir), GK, "value", 30))
    return finish(RC.window_mae(_mean_recon(w)).select("win_start", "mae"))


_F14_PARTS = [f"{_band_mae_sql(O.LINEITEM, 10, c, _LI_ORDER)} c{i}" for i, c in enumerate(C.LINE_CHANNELS)]


@query("f14_window_mae_channel", "SELECT c0.win_start, " + ", ".join(
    f"round(c{i}.mae, 6) AS mae_c{i}" for i in range(4)) + " FROM " + _F14_PARTS[0] + "".join(
    f" JOIN {p} USING (win_start)" for p in _F14_PARTS[1:]))
def f14_window_mae_channel(spark, sf_dir):
    df, spec = C.dataset(spark, sf_dir, "lineitem")
    p = P.row_index(df, GK, list(spec.order))
    w = W.sequences(p, GK, list(spec.values), 10)
    rec = RC.window_mean(w, "window", "recon_window")
    r = RC.window_mae_channel(rec, "window", "recon_window")
    return finish(r.select("win_start", *[F.col("mae_channel")[i].alias(f"mae_c{i}") for i in range(4)]))


@query("f16_flag_threshold", f"SELECT row_idx, CASE WHEN score > 0.7 THEN 1 ELSE 0 END AS flag FROM {F11}")
def f16_flag_threshold(spark, sf_dir):
    return FL.flag_threshold(f11_scores(spark, sf_dir), "score", 0.7).select("row_idx", "flag")


def loop_user_scored(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events_by_user")
    s = NB.loop_1d(df, UK, "value", "rid", k=20)
    scored = materialize(df.select("series_id", "rid", "is_anomaly").join(s, UK + ["rid"]), "loop-scored")
    return FL.flag_share(scored, UK, "score")


LOOP_USER_FLAGS = f"""(SELECT l.series_id, l.rid, s.is_anomaly, l.score,
CASE WHEN l.score > sh.share THEN 1 ELSE 0 END AS flag
FROM {O.loop_from_edges(O.edges_1d(EVU, 20))} l JOIN ({EVU}) s USING (series_id, rid)
JOIN (SELECT series_id, avg(CAST(is_anomaly AS DOUBLE)) AS share FROM ({EVU}) GROUP BY series_id) sh
USING (series_id))"""


@query("f17_flag_share", f"SELECT series_id, rid, flag FROM {LOOP_USER_FLAGS}")
def f17_flag_share(spark, sf_dir):
    return loop_user_scored(spark, sf_dir).select("series_id", "rid", "flag")


@query("f18_flag_percentile", f"SELECT series_id, rid, flag FROM {O.percentile_flag(O.knn_1d(EVU, 5)[1:-1], 98.0)}")
def f18_flag_percentile(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events_by_user")
    s = materialize(NB.knn_score_1d(df, UK, "value", "rid", 5), "knn-scores")
    return FL.flag_percentile(s, UK, "score", 98.0).select("series_id", "rid", "flag")


# ------------------------------------------------------------------ jobs, end to end


def _board_sql(scored: str, name: str, title: str, level: float) -> str:
    """Board row of scored rows (is_anomaly, score) flagged above a level; rows without a score rank lowest."""
    flagged = f"(SELECT *, CASE WHEN score > {level} THEN 1 ELSE 0 END AS flag FROM {scored})"
    return f"""WITH s AS MATERIALIZED (SELECT * FROM {flagged}),
    c AS (SELECT count_if(is_anomaly = 1 AND flag = 1) AS tp, count_if(is_anomaly = 0 AND flag = 1) AS fp, count_if(is_anomaly = 1 AND flag = 0) AS fn FROM s),
    r AS (SELECT is_anomaly, rank() OVER (ORDER BY coalesce(score, -1e300)) + (count(*) OVER (PARTITION BY coalesce(score, -1e300)) - 1) / 2.0 AS mid FROM s),
    a AS (SELECT sum(CASE WHEN is_anomaly = 1 THEN mid END) AS w, CAST(count_if(is_anomaly = 1) AS DOUBLE) AS p, CAST(count_if(is_anomaly = 0) AS DOUBLE) AS n FROM r)
    SELECT '{name}' AS dataset, '{title}' AS detector,
      round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1,
      round(CASE WHEN p > 0 AND n > 0 THEN (w - p * (p + 1) / 2) / (p * n) END, 6) AS auroc FROM c, a"""


# least squares on one lag: slope and intercept of value on the value before, over the first 75 % of the rows
ONE_LAG = f"""(WITH p AS MATERIALIZED (SELECT *, lag(value) OVER (ORDER BY row_idx) AS x FROM {O.with_pos(O.EVENTS_COLLECTIVE)}),
    m AS (SELECT regr_slope(value, x) AS b, regr_intercept(value, x) AS a FROM p WHERE row_idx < (SELECT floor(0.75 * count(*)) FROM p) AND x IS NOT NULL),
    e AS (SELECT row_idx - 1 AS win_start, abs(a + b * x - value) AS err FROM p, m WHERE x IS NOT NULL),
    z AS (SELECT win_start, abs(err - avg(err) OVER ()) / stddev_samp(err) OVER () AS score FROM e),
    r AS (SELECT p.row_idx, p.is_anomaly, avg(z.score) OVER (ORDER BY p.row_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s
          FROM p LEFT JOIN z ON z.win_start = p.row_idx)
    SELECT row_idx, is_anomaly, s / max(s) OVER () AS score FROM r)"""


@query("job_forecast_one_lag", _board_sql(ONE_LAG, "events_collective", "DeeP-ANT", 0.3))
def job_forecast_one_lag(spark, sf_dir):
    """Trained forecaster (one lag, squared loss) from fit to board row."""
    conf = {"dataset": "events_collective", "detector": "forecast", "model": "squared", "window": 1, "level": 0.3}
    return finish(J.run_job(spark, sf_dir, conf)[1])


# windows of two scaled values rebuilt from one component: the 2 x 2 covariance has its eigenvector in closed form
WINDOW_TWO = f"""(WITH p AS MATERIALIZED (SELECT row_idx, is_anomaly, value FROM {O.with_pos(O.EVENTS_COLLECTIVE)}),
    cut AS (SELECT floor(0.4 * count(*)) AS n FROM p),
    st AS (SELECT avg(value) AS m, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1.0 END AS s FROM p, cut WHERE row_idx < n),
    w AS MATERIALIZED (SELECT * FROM (SELECT row_idx, (value - m) / s AS x, (lead(value) OVER (ORDER BY row_idx) - m) / s AS y,
        lead(value, 2) OVER (ORDER BY row_idx) AS nxt FROM p, st) WHERE nxt IS NOT NULL),
    c AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS d FROM w, cut WHERE row_idx + 1 < n),
    v AS (SELECT *, ((a + d) + sqrt((a - d) * (a - d) + 4 * b * b)) / 2 AS l FROM c),
    u AS (SELECT *, b / sqrt(b * b + (l - a) * (l - a)) AS v1, (l - a) / sqrt(b * b + (l - a) * (l - a)) AS v2 FROM v),
    e AS (SELECT row_idx + 2 AS row_idx, (abs(x - mx - v1 * (v1 * (x - mx) + v2 * (y - my))) + abs(y - my - v2 * (v1 * (x - mx) + v2 * (y - my)))) / 2 AS score FROM w, u)
    SELECT p.row_idx, p.is_anomaly, e.score FROM p LEFT JOIN e USING (row_idx))"""


@query("job_reconstruct_window_two", _board_sql(WINDOW_TWO, "events_collective", "LSTM-AE", 0.5))
def job_reconstruct_window_two(spark, sf_dir):
    """Reconstruction detector (window 2, one component) from scaling to board row."""
    conf = {"dataset": "events_collective", "detector": "reconstruct", "window": 2, "rank": 1, "level": 0.5}
    return finish(J.run_job(spark, sf_dir, conf)[1])


@query("f13_reconstruct_window_two", f"SELECT row_idx, {r6('score', 'score')} FROM {WINDOW_TWO} WHERE score IS NOT NULL")
def f13_reconstruct_window_two(spark, sf_dir):
    """Rebuild error of every window of two scaled values."""
    s, _ = RC.reconstruct_score(positioned(spark, sf_dir, "events_collective"), GK, ["value"], 2, 1)
    return finish(s.select("row_idx", "score"))


# ------------------------------------------------------------------ trained detectors on channels with gaps

_PAIR = O.with_pos(O.EVENTS_SPARSE_PAIR)
# least squares of each channel on the one lag of both, over rows whose four numbers are known: normal equations of two centred predictors
PAIR_FORECAST = f"""(WITH p AS MATERIALIZED (SELECT *, lag(value) OVER (ORDER BY row_idx) AS x, lag(minute) OVER (ORDER BY row_idx) AS y FROM {_PAIR}),
    k AS (SELECT * FROM p WHERE value IS NOT NULL AND minute IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL),
    m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(value) AS mu, avg(minute) AS mv, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy,
          covar_pop(x, value) AS xu, covar_pop(y, value) AS yu, covar_pop(x, minute) AS xv, covar_pop(y, minute) AS yv
          FROM k WHERE row_idx < (SELECT floor(0.75 * count(*)) FROM p)),
    b AS (SELECT *, (yy * xu - xy * yu) / (xx * yy - xy * xy) AS ux, (xx * yu - xy * xu) / (xx * yy - xy * xy) AS uy,
          (yy * xv - xy * yv) / (xx * yy - xy * xy) AS vx, (xx * yv - xy * xv) / (xx * yy - xy * xy) AS vy FROM m),
    e AS (SELECT row_idx - 1 AS win_start, sqrt(power(mu + ux * (x - mx) + uy * (y - my) - value, 2) + power(mv + vx * (x - mx) + vy * (y - my) - minute, 2)) AS err FROM k, b),
    z AS (SELECT win_start, abs(err - avg(err) OVER ()) / stddev_samp(err) OVER () AS score FROM e),
    r AS (SELECT p.row_idx, p.is_anomaly, avg(z.score) OVER (ORDER BY p.row_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s
          FROM p LEFT JOIN z ON z.win_start = p.row_idx)
    SELECT row_idx, is_anomaly, s / max(s) OVER () AS score FROM r)"""


def _pair_scored(spark, sf_dir, score):
    p = positioned(spark, sf_dir, "events_sparse_pair")
    return finish(p.select("row_idx", "is_anomaly").join(score(p), "row_idx", "left").select("row_idx", "is_anomaly", "score"))


@query("f9_forecast_sparse_pair", f"SELECT row_idx, is_anomaly, {r6('score', 'score')} FROM {PAIR_FORECAST}")
def f9_forecast_sparse_pair(spark, sf_dir):
    """Trained forecaster of two channels with gaps: every row stays, rows without a full window have no score."""
    return _pair_scored(spark, sf_dir, lambda p: FC.forecast_model_score(p, GK, ["value", "minute"], 1, model="squared"))


@query("job_forecast_sparse_pair", _board_sql(PAIR_FORECAST, "events_sparse_pair", "DeeP-ANT", 0.3))
def job_forecast_sparse_pair(spark, sf_dir):
    """The same from fit to board row."""
    conf = {"dataset": "events_sparse_pair", "detector": "forecast", "model": "squared", "window": 1, "level": 0.3}
    return finish(J.run_job(spark, sf_dir, conf)[1])


# windows of one step of two scaled channels, rebuilt from one component
PAIR_REBUILT = f"""(WITH p AS MATERIALIZED (SELECT row_idx, is_anomaly, value, minute, lead(value) OVER (ORDER BY row_idx) AS nv, lead(minute) OVER (ORDER BY row_idx) AS nm FROM {_PAIR}),
    cut AS (SELECT floor(0.4 * count(*)) AS n FROM p),
    st AS (SELECT avg(value) AS mu, stddev_pop(value) AS su, avg(minute) AS mv, stddev_pop(minute) AS sv FROM p, cut WHERE row_idx < n),
    w AS MATERIALIZED (SELECT row_idx, (value - mu) / su AS x, (minute - mv) / sv AS y FROM p, st WHERE value IS NOT NULL AND minute IS NOT NULL AND nv IS NOT NULL AND nm IS NOT NULL),
    c AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS d FROM w, cut WHERE row_idx < n),
    v AS (SELECT *, ((a + d) + sqrt((a - d) * (a - d) + 4 * b * b)) / 2 AS l FROM c),
    u AS (SELECT *, b / sqrt(b * b + (l - a) * (l - a)) AS v1, (l - a) / sqrt(b * b + (l - a) * (l - a)) AS v2 FROM v),
    e AS (SELECT row_idx + 1 AS row_idx, (abs(x - mx - v1 * (v1 * (x - mx) + v2 * (y - my))) + abs(y - my - v2 * (v1 * (x - mx) + v2 * (y - my)))) / 2 AS score FROM w, u)
    SELECT p.row_idx, p.is_anomaly, e.score FROM p LEFT JOIN e USING (row_idx))"""


@query("f13_reconstruct_sparse_pair", f"SELECT row_idx, is_anomaly, {r6('score', 'score')} FROM {PAIR_REBUILT}")
def f13_reconstruct_sparse_pair(spark, sf_dir):
    """Reconstruction of two channels with gaps: rows behind a window that is not full have no score."""
    return _pair_scored(spark, sf_dir, lambda p: RC.reconstruct_score(p, GK, ["value", "minute"], 1, 1)[0])


_COV_STEPS = [(c, k) for c in ("value", "minute") for k in range(3)]
_COV_LAGS = ", ".join(f"lead({c}, {k}) OVER (ORDER BY row_idx) AS {c}{k}" for c in ("value", "minute") for k in range(4))
_COV_FULL = " AND ".join(f"{c}{k} IS NOT NULL" for c in ("value", "minute") for k in range(4))


@query("f12_window_covariance", f"""WITH w AS MATERIALIZED (SELECT * FROM (SELECT {_COV_LAGS} FROM {_PAIR}) WHERE {_COV_FULL})
""" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, count(*) AS windows, {r6(f'avg({a}{x})', 'mean_i')}, {r6(f'covar_samp({a}{x}, {b}{y})', 'covariance')} FROM w"
                         for i, (a, x) in enumerate(_COV_STEPS) for j, (b, y) in enumerate(_COV_STEPS)))
def f12_window_covariance(spark, sf_dir):
    """Mean and covariance of all windows of three steps of two channels with gaps, from lagged cross products."""
    n, mean, cov = RC.window_moments(positioned(spark, sf_dir, "events_sparse_pair"), GK, ["value", "minute"], 3)
    rows = [(i, j, n, float(mean[i]), float(cov[i, j])) for i in range(6) for j in range(6)]
    return finish(spark.createDataFrame(rows, "i int, j int, windows long, mean_i double, covariance double"))


@query("job_reconstruct_sparse_pair", _board_sql(PAIR_REBUILT, "events_sparse_pair", "LSTM-AE", 0.5))
def job_reconstruct_sparse_pair(spark, sf_dir):
    """The same from scaling to board row."""
    conf = {"dataset": "events_sparse_pair", "detector": "reconstruct", "window": 1, "rank": 1, "level": 0.5}
    return finish(J.run_job(spark, sf_dir, conf)[1])


_BASE4 = O.with_pos(O.LINEITEM, order=_LI_ORDER)
_MISS = " + ".join(f"power(lead({c}, 10) OVER o - avg({c}) OVER (ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), 2)" for c in C.LINE_CHANNELS)


@query("f11_forecast_baseline_wide", f"""WITH e AS (SELECT win_start, err FROM (SELECT row_idx AS win_start, sqrt({_MISS}) AS err,
    lead(row_idx, 10) OVER o AS full_marker FROM {_BASE4} WINDOW o AS (ORDER BY row_idx)) WHERE full_marker IS NOT NULL),
z AS (SELECT win_start, abs(err - avg(err) OVER ()) / stddev_samp(err) OVER () AS score FROM e),
r AS (SELECT p.row_idx, avg(z.score) OVER (ORDER BY p.row_idx ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS s FROM {_BASE4} p LEFT JOIN z ON z.win_start = p.row_idx)
SELECT row_idx, round(s / max(s) OVER (), 6) AS score FROM r""")
def f11_forecast_baseline_wide(spark, sf_dir):
    """Baseline forecast over all four lineitem channels together."""
    df, spec = C.dataset(spark, sf_dir, "lineitem")
    return finish(FC.forecast_baseline_score(P.row_index(df, GK, list(spec.order)), GK, list(spec.values), 10))


# series with missing values and series of one row: scores are null there, and every metric keeps the rows
SPARSE = """(SELECT CASE WHEN event_id % 53 = 7 THEN -event_id ELSE user_id END AS series_id, event_id AS rid,
    CASE WHEN event_id % 31 <> 5 THEN value + 600.0 * (CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) END AS value,
    CASE WHEN event_id % 97 = 0 OR event_id % 310 = 5 OR event_id % 530 = 7 THEN 1 ELSE 0 END AS is_anomaly FROM events)"""
SPARSE_SCORED = f"""(SELECT s.series_id, s.rid, s.is_anomaly, n.score FROM {SPARSE} s
    LEFT JOIN {O.knn_1d(f"SELECT * FROM {SPARSE} WHERE value IS NOT NULL", 1)} n USING (series_id, rid))"""


def sparse_scored(spark, sf_dir):
    e = C.table(spark, sf_dir, "events")
    i = F.col("event_id")
    d = e.select(F.when(i % 53 == 7, -i).otherwise(F.col("user_id")).alias("series_id"), i.alias("rid"),
                 F.when(i % 31 != 5, F.col("value") + F.lit(C.PLANT_SHIFT) * C.planted_flag("event_id")).alias("value"),
                 F.when((i % 97 == 0) | (i % 310 == 5) | (i % 530 == 7), 1).otherwise(0).alias("is_anomaly"))
    return materialize(NB.knn_score_1d(d, UK, "value", "rid", 1, carry=("is_anomaly",)), "sparse-scored")


@query("f2_knn_1d_missing", f"SELECT series_id, rid, {r6('score', 'score')} FROM {SPARSE_SCORED}")
def f2_knn_1d_missing(spark, sf_dir):
    """Every row keeps its place: null scores for rows without a value or neighbours."""
    return finish(sparse_scored(spark, sf_dir).select("series_id", "rid", "score"))


@query("g_board_with_missing_scores", _board_sql(SPARSE_SCORED, "events_sparse", "Knn", 5.0))
def g_board_with_missing_scores(spark, sf_dir):
    """F1 and AUROC count rows without a score as not flagged and ranked lowest."""
    s = sparse_scored(spark, sf_dir)
    return finish(J.board_row(FL.flag_threshold(s, "score", 5.0), "events_sparse", "Knn", scores=s))
