"""Registered queries: evaluation (G), leaderboards (A10, G17, G18), model selection (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import evaluate as G
from vigil.operators import neighbors as NB
from vigil.operators import search as H
from vigil.operators import stats as D
from vigil.plans import jobs as J
from vigil.plans import oracle_sql as O
from vigil.operators import forest as FR
from vigil.plans.q_detect import F11, FOREST, LOOP_USER_FLAGS, _fold_split, f11_scores, loop_user_scored
from vigil.plans.base import finish, query, r6
from vigil.session import materialize
from vigil.sources import board as BD
from vigil.sources import catalog as C

EV, EVU = O.EVENTS, O.EVENTS_BY_USER
UK = ["series_id"]
GK: list = []


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


# flagship rows: per-user kNN k=1, flagged above the per-user 98th percentile
KNN_FLAGS = O.percentile_flag(
    f"SELECT s.series_id, s.rid, s.is_anomaly, n.score FROM ({EVU}) s JOIN {O.knn_1d(EVU, 1)} n USING (series_id, rid)",
    98.0)


def knn_flags(spark, sf_dir):
    return J.scored_knn_1d(spark, sf_dir, "events_by_user", k=1, q=98.0)


def _conf_sql(src):
    return f"""SELECT CAST(count_if(is_anomaly = 1 AND flag = 1) AS BIGINT) AS tp, CAST(count_if(is_anomaly = 0 AND flag = 1) AS BIGINT) AS fp,
    CAST(count_if(is_anomaly = 1 AND flag = 0) AS BIGINT) AS fn, CAST(count_if(is_anomaly = 0 AND flag = 0) AS BIGINT) AS tn FROM {src}"""


@query("g1_confusion", _conf_sql(KNN_FLAGS))
def g1_confusion(spark, sf_dir):
    return G.confusion(knn_flags(spark, sf_dir), [])


@query("g2_precision_recall_f1", f"""SELECT tp, fp, fn, tn,
round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision,
round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1
FROM ({_conf_sql(KNN_FLAGS)})""")
def g2_precision_recall_f1(spark, sf_dir):
    return finish(G.prf(G.confusion(knn_flags(spark, sf_dir), [])))


@query("g4_auroc_of_flags", f"""SELECT round((CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2.0, 6)
AS auroc FROM ({_conf_sql(LOOP_USER_FLAGS)})""")
def g4_auroc_of_flags(spark, sf_dir):
    return finish(G.auroc_of_flags(G.confusion(loop_user_scored(spark, sf_dir), [])).select("auroc"))


_ROC = f"""(WITH per AS (SELECT value AS threshold, sum(is_anomaly) AS pos, sum(1 - is_anomaly) AS neg
                      FROM ({O.EVENTS_WEAK}) GROUP BY value),
    c AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp,
                 row_number() OVER (ORDER BY threshold DESC) AS point FROM per),
    tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM per)
    SELECT point, threshold, CAST(fp AS DOUBLE) / N AS fpr, CAST(tp AS DOUBLE) / P AS tpr FROM c, tot
    UNION ALL SELECT CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), 0.0, 0.0)"""


def weak_curve(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events_weak")
    return G.roc_curve(df, [], "value")


@query("g5_roc_curve", f"SELECT point, threshold, {r6('fpr', 'fpr')}, {r6('tpr', 'tpr')} FROM {_ROC}")
def g5_roc_curve(spark, sf_dir):
    return finish(weak_curve(spark, sf_dir).select("point", "threshold", "fpr", "tpr"))


@query("g6_auc_trapezoid", f"""SELECT round(sum((fpr - f0) * (tpr + t0) / 2.0), 6) AS auc FROM (
SELECT fpr, tpr, lag(fpr) OVER (ORDER BY point) AS f0, lag(tpr) OVER (ORDER BY point) AS t0 FROM {_ROC})
WHERE f0 IS NOT NULL""")
def g6_auc_trapezoid(spark, sf_dir):
    return finish(G.auc_trapezoid(weak_curve(spark, sf_dir), []))


# ---------------------------------------------------------------- sweeps

F11_SCORED = f"""(SELECT f.row_idx, f.score, p.is_anomaly FROM {F11} f
JOIN {O.with_pos(O.EVENTS_COLLECTIVE)} p USING (row_idx))"""


def _sweep_sql(src, step, inclusive, start, count, last=None):
    """Brute force: one comparison of every score with every grid level."""
    op = ">=" if inclusive else ">"
    t = f"({start} + CAST(j AS DOUBLE) * {dbl(step)})"
    if last is not None:
        t = f"(CASE WHEN j = {count} - 1 THEN {dbl(last)} ELSE {t} END)"
    return f"""(WITH s AS (SELECT * FROM {src}), b AS (SELECT min(score) AS mn, max(score) AS mx FROM s),
    g AS (SELECT j, {t} AS t FROM b, range(0, CAST({count} AS BIGINT)) r(j))
    SELECT j, t, tp, fp, fn, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1
    FROM (SELECT g.j, g.t, CAST(count_if(s.score {op} g.t AND s.is_anomaly = 1) AS BIGINT) AS tp,
                 CAST(count_if(s.score {op} g.t AND s.is_anomaly = 0) AS BIGINT) AS fp,
                 CAST(count_if(NOT (s.score {op} g.t) AND s.is_anomaly = 1) AS BIGINT) AS fn
          FROM g, s GROUP BY g.j, g.t))"""


def _sweep_out(src):
    return f"SELECT j, {r6('t', 't')}, tp, fp, fn, {r6('f1', 'f1')} FROM {src}"


G7_SQL = _sweep_sql(F11_SCORED, 0.01, True, "mn", f"ceil((mx - mn) / {dbl(0.01)})")


@query("g7_threshold_sweep", _sweep_out(G7_SQL))
def g7_threshold_sweep(spark, sf_dir):
    return finish(G.threshold_sweep(f11_scores(spark, sf_dir), [], "score", step=0.01))


_STEP89 = 1.0 / 89.0


@query("g8_sweep_linspace", _sweep_out(_sweep_sql(F11_SCORED, _STEP89, False, dbl(0.0), 90, last=1.0)))
def g8_sweep_linspace(spark, sf_dir):
    return finish(G.threshold_sweep(f11_scores(spark, sf_dir), [], "score", step=_STEP89, inclusive=False,
                                    bounds=(0.0, 1.0), count=90, last=1.0))


KNN_GLOBAL = f"""(SELECT k.score, s.is_anomaly FROM {O.knn_1d_band(EV, 1)} k JOIN ({EV}) s USING (series_id, rid))"""
_P = f"(SELECT quantile_cont(score, 0.01) AS p1, quantile_cont(score, 0.95) AS p95 FROM {KNN_GLOBAL})"
G9_SQL = _sweep_sql(f"(SELECT * FROM {KNN_GLOBAL}, {_P})", 0.01, False, "(SELECT p1 FROM " + _P + ")",
                    f"ceil(((SELECT p95 FROM {_P}) - (SELECT p1 FROM {_P})) / {dbl(0.01)})")
_BEST9 = f"(SELECT t FROM {G9_SQL} ORDER BY f1 DESC, t LIMIT 1)"
G10_SQL = _sweep_sql(KNN_GLOBAL, 0.001, False, f"({_BEST9} - {dbl(0.05)})",
                     f"ceil((({_BEST9} + {dbl(0.05)}) - ({_BEST9} - {dbl(0.05)})) / {dbl(0.001)})")


def knn_global(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events")
    s = NB.knn_score_1d(df, GK, "value", "rid", 1)
    return materialize(df.select("series_id", "rid", "is_anomaly").join(s, GK + ["rid"]), "knn-global")


def _g9(spark, sf_dir, expand=True):
    sc = knn_global(spark, sf_dir)
    q = {r["q"]: r["value"] for r in D.quantiles(sc, [], "score", [0.01, 0.95]).collect()}
    return sc, G.threshold_sweep(sc, [], "score", step=0.01, inclusive=False, bounds=(q[0.01], q[0.95]), expand=expand)


@query("g9_sweep_percentile", _sweep_out(G9_SQL))
def g9_sweep_percentile(spark, sf_dir):
    return finish(_g9(spark, sf_dir)[1])


@query("g10_threshold_refine", _sweep_out(G10_SQL))
def g10_threshold_refine(spark, sf_dir):
    sc, sw = _g9(spark, sf_dir, expand=False)
    best = G.best_threshold(sw, []).head()["best_t"]
    # the first sweep has no level if its percentiles are equal: nothing to refine
    around = (None, None) if best is None else (best - 0.05, best + 0.05)
    return finish(G.threshold_sweep(sc, [], "score", step=0.001, inclusive=False, bounds=around))


@query("g11_best_threshold", f"SELECT {r6('t', 'best_t')}, {r6('f1', 'best_f1')} FROM {G7_SQL} "
       "ORDER BY f1 DESC, t LIMIT 1")
def g11_best_threshold(spark, sf_dir):
    runs = G.threshold_sweep(f11_scores(spark, sf_dir), [], "score", step=0.01, expand=False)
    return finish(G.best_threshold(runs, []))


@query("g12_combined_metric", f"""SELECT {r6('t', 'best_t')}, {r6('f1', 'f1')}, {r6('auroc', 'auroc')},
{r6('0.5 * (f1 + auroc)', 'combined')} FROM {G7_SQL}, {O.auroc_sql(F11_SCORED)}
ORDER BY 0.5 * (f1 + auroc) DESC, t LIMIT 1""")
def g12_combined_metric(spark, sf_dir):
    sc = f11_scores(spark, sf_dir)
    sw = G.threshold_sweep(sc, [], "score", step=0.01)
    sw = sw.withColumn("auroc", G.auroc(sc, [], "score").select("auroc").scalar())
    c = G.combined_metric(sw)
    best = F.max_by(F.struct(F.col("t").alias("best_t"), "f1", "auroc", "combined"), F.struct("combined", -F.col("t")))
    return finish(c.agg(best.alias("b")).select("b.*"))


@query("g13_label_agreement", f"""SELECT series_id, rid, CASE WHEN flag = 1 THEN 'flagged_not_labelled'
ELSE 'labelled_not_flagged' END AS disagreement FROM {KNN_FLAGS} WHERE flag <> is_anomaly""")
def g13_label_agreement(spark, sf_dir):
    return G.label_agreement(knn_flags(spark, sf_dir), keys=UK)


def _f19_sql():
    from vigil.plans.base import ORACLES  # f19 is registered by q_detect (imported above)
    return ORACLES["f19_knn_classify"]


@query("g14_accuracy", f"""SELECT round(avg(CAST(p.pred = t.class_label AS DOUBLE)), 6) AS accuracy
FROM ({_f19_sql()}) p JOIN ({O.EMBEDDINGS}) t USING (rid)""")
def g14_accuracy(spark, sf_dir):
    from vigil.plans.q_detect import f19_knn_classify
    pred = f19_knn_classify(spark, sf_dir)
    df, _ = C.dataset(spark, sf_dir, "embeddings")
    return finish(G.accuracy(pred.join(df.select("rid", "class_label"), "rid"), [], "pred", "class_label"))


@query("g15_point_categories", f"""SELECT series_id, rid, CASE WHEN is_anomaly = 1 AND flag = 1 THEN 'true_positive'
WHEN is_anomaly = 0 AND flag = 1 THEN 'false_positive' WHEN is_anomaly = 1 AND flag = 0 THEN 'false_negative'
ELSE 'true_negative' END AS category FROM {KNN_FLAGS}""")
def g15_point_categories(spark, sf_dir):
    return G.point_categories(knn_flags(spark, sf_dir)).select("series_id", "rid", "category")


_HS = O.knn_1d(EVU, 5)


@query("g16_score_histogram", f"""WITH s AS (SELECT score FROM {_HS}), b AS (SELECT min(score) AS mn, max(score) AS mx FROM s),
c AS (SELECT CAST(CASE WHEN mx - mn > 0 THEN least(29, floor((score - mn) * ({dbl(30.0)} / (mx - mn)))) ELSE 0 END
      AS BIGINT) AS bin, count(*) AS n FROM s, b GROUP BY 1)
SELECT r.bin, round(mn + (mx - mn) * CAST(r.bin AS DOUBLE) / {dbl(30.0)}, 6) AS bin_start, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM b, (SELECT range AS bin FROM range(0, 30)) r LEFT JOIN c ON c.bin = r.bin""")
def g16_score_histogram(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events_by_user")
    return finish(G.score_histogram(NB.knn_score_1d(df, UK, "value", "rid", 5), [], "score", 30))


# ---------------------------------------------------------------- labelled documents

def _docs_sql(label):
    return (f"SELECT CAST(0 AS BIGINT) AS series_id, d.doc_id AS rid, CAST(d.n_chars AS DOUBLE) AS score, "
            f"l.{label} AS is_anomaly FROM documents d JOIN labels l USING (doc_id)")


@query("g3_auroc_labelled_documents", " UNION ALL ".join(
    f"SELECT '{lab}' AS label, {r6('auroc', 'auroc')} FROM {O.auroc_sql(_docs_sql(lab))}" for lab in ("toxic", "quality")))
def g3_auroc_labelled_documents(spark, sf_dir):
    """G3 on labels without series: document length as the score of each binary label."""
    out = None
    for lab in ("toxic", "quality"):
        a = G.auroc(C.labelled_documents(spark, sf_dir, lab), [], "score").select(F.lit(lab).alias("label"), "auroc")
        out = a if out is None else out.unionByName(a)
    return finish(out)


@query("g2_prf_labelled_documents", f"""SELECT tp, fp, fn, tn,
round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision,
round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1
FROM ({_conf_sql(O.percentile_flag(_docs_sql('toxic'), 90.0))})""")
def g2_prf_labelled_documents(spark, sf_dir):
    """F18 + G1/G2: flag documents above the 90th length percentile, score against ``toxic``."""
    from vigil.operators import flags as FL
    d = C.labelled_documents(spark, sf_dir, "toxic")
    return finish(G.prf(G.confusion(FL.flag_percentile(d, [], "score", 90.0), [])))


# ---------------------------------------------------------------- boards

def _board_rows_sql():
    knn_user = (f"SELECT 'events_by_user' AS dataset, 'Knn' AS detector, {O.f1_sql(KNN_FLAGS[1:-1])} AS f1, "
                f"(SELECT auroc FROM {O.auroc_sql(KNN_FLAGS[1:-1])}) AS auroc")
    loop_user = (f"SELECT 'events_by_user' AS dataset, 'LoOP' AS detector, {O.f1_sql(LOOP_USER_FLAGS[1:-1])} AS f1, "
                 f"(SELECT auroc FROM {O.auroc_sql(LOOP_USER_FLAGS[1:-1])}) AS auroc")
    g = O.percentile_flag(f"SELECT 0 AS series_id, * FROM {KNN_GLOBAL}", 98.0)
    knn_glob = (f"SELECT 'events' AS dataset, 'Knn' AS detector, {O.f1_sql(g[1:-1])} AS f1, "
                f"(SELECT auroc FROM {O.auroc_sql(g[1:-1])}) AS auroc")
    return f"({knn_user} UNION ALL {loop_user} UNION ALL {knn_glob})"


BOARDS = _board_rows_sql()


def boards(spark, sf_dir):
    ks, kf = J.knn_1d_scored_and_flagged(spark, sf_dir, "events_by_user", k=1, q=98.0)
    ku = J.board_row(kf, "events_by_user", "Knn", scores=ks)
    lu = J.board_row(loop_user_scored(spark, sf_dir), "events_by_user", "LoOP")
    gs, gf = J.knn_1d_scored_and_flagged(spark, sf_dir, "events", k=1, q=98.0)
    kg = J.board_row(gf, "events", "Knn", scores=gs)
    return BD.union_boards({"events_by_user": ku.unionByName(lu), "events": kg})


@query("a10_leaderboard_union", f"SELECT dataset, detector, {r6('f1', 'f1')}, {r6('auroc', 'auroc')} FROM {BOARDS}")
def a10_leaderboard_union(spark, sf_dir):
    return finish(boards(spark, sf_dir))


@query("g17_leaderboard_long", f"""SELECT dataset, detector, 'f1' AS metric, {r6('f1', 'value')} FROM {BOARDS}
UNION ALL SELECT dataset, detector, 'auroc' AS metric, {r6('auroc', 'value')} FROM {BOARDS}""")
def g17_leaderboard_long(spark, sf_dir):
    return finish(G.leaderboard_long(boards(spark, sf_dir)))


@query("g18_leaderboard_rank", f"""SELECT dataset, detector, {r6('f1', 'f1')}, {r6('auroc', 'auroc')},
CAST(rank() OVER (PARTITION BY dataset ORDER BY f1 DESC NULLS LAST) AS INTEGER) AS rank FROM {BOARDS}""")
def g18_leaderboard_rank(spark, sf_dir):
    return finish(G.leaderboard_rank(boards(spark, sf_dir)))


# ---------------------------------------------------------------- H

KS, QS = [1, 3, 5, 11], [95.0, 97.0, 98.0, 99.0]


def _grid_sql(KS=KS, QS=QS):
    e = f"""SELECT a.series_id, a.rid, a.is_anomaly, abs(a.value - b.value) AS d,
        row_number() OVER (PARTITION BY a.series_id, a.rid ORDER BY abs(a.value - b.value)) AS rn
        FROM ({EVU}) a JOIN ({EVU}) b ON a.series_id = b.series_id AND a.rid <> b.rid"""
    th = ", ".join(f"quantile_cont(score, {q / 100.0}) AS t{int(q)}" for q in QS)
    pick = "CASE " + " ".join(f"WHEN q = {q} THEN t{int(q)}" for q in QS) + " END"
    return f"""(WITH e AS ({e}), sc AS (SELECT series_id, rid, is_anomaly, rn AS k, d AS score FROM e
        WHERE rn IN ({', '.join(map(str, KS))})),
    th AS (SELECT series_id, k, {th} FROM sc GROUP BY series_id, k),
    fl AS (SELECT sc.k, g.q, sc.is_anomaly, CASE WHEN sc.score > {pick} THEN 1 ELSE 0 END AS flag
           FROM sc JOIN th USING (series_id, k), (SELECT unnest(CAST({[float(q) for q in QS]} AS DOUBLE[])) AS q) g)
    SELECT k, q, CAST(count_if(is_anomaly = 1 AND flag = 1) AS BIGINT) AS tp, CAST(count_if(is_anomaly = 0 AND flag = 1) AS BIGINT) AS fp,
           CAST(count_if(is_anomaly = 1 AND flag = 0) AS BIGINT) AS fn FROM fl GROUP BY k, q)"""


GRID = _grid_sql()
GRID_F1 = f"(SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM {GRID})"


def knn_grid(spark, sf_dir, ks=KS, qs=QS):
    df, _ = C.dataset(spark, sf_dir, "events_by_user")
    cands = NB.knn_1d_candidates(df, UK, "value", "rid", max(ks), carry=("is_anomaly",))
    g = H.knn_grid_f1(cands, df, UK, "rid", ks, qs)
    return g.withColumn("k", F.col("k").cast("bigint"))


@query("h1_param_grid", f"SELECT k, q, tp, fp, fn, {r6('f1', 'f1')} FROM {GRID_F1}")
def h1_param_grid(spark, sf_dir):
    grid = H.param_grid(spark, {"k": KS, "q": QS}).withColumn("k", F.col("k").cast("bigint"))
    return finish(grid.join(knn_grid(spark, sf_dir), ["k", "q"]).select("k", "q", "tp", "fp", "fn", "f1"))


@query("h4_grid_search_f1", f"SELECT k, q, {r6('f1', 'f1')} FROM {GRID_F1} ORDER BY f1 DESC, k, q LIMIT 1")
def h4_grid_search_f1(spark, sf_dir):
    return finish(H.best_params(knn_grid(spark, sf_dir), ["k", "q"], "f1"))


_H2 = f"(SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM {_grid_sql(range(1, 11), range(90, 100))})"


@query("h2_param_sample", f"SELECT k, q, tp, fp, fn, {r6('f1', 'f1')} FROM {_H2} ORDER BY md5('42:' || CAST(k AS VARCHAR) || ':' || CAST(q AS VARCHAR)) LIMIT 6")
def h2_param_sample(spark, sf_dir):
    """6 (k, percentile) pairs drawn by a seeded hash from a 10 x 10 grid, evaluated on the data."""
    grid = H.param_grid(spark, {"k": list(range(1, 11)), "q": [float(q) for q in range(90, 100)]})
    picked = H.param_sample(grid, 6, seed=42).withColumn("k", F.col("k").cast("bigint"))
    drawn = [(int(r["k"]), r["q"]) for r in picked.collect()]
    ks, qs = (sorted(set(x)) for x in zip(*drawn))          # one pass over the scores for all drawn levels
    return finish(picked.join(knn_grid(spark, sf_dir, ks, qs), ["k", "q"]))


_CV_KS = [1, 3, 5, 7]


def _cv_sql():
    parts = []
    for p in (1, 2):
        for f in range(5):
            e = (f"SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, nid) AS rk FROM "
                           f"({O.edges_vec(f'SELECT * FROM ({_EMB}) WHERE fold = {f}', f'SELECT * FROM ({_EMB}) WHERE fold <> {f}', max(_CV_KS), p, False)})")
            for k in _CV_KS:
                votes = (f"SELECT e.rid, t.class_label, count(*) AS n FROM ({e}) e JOIN ({_EMB}) t ON t.rid = e.nid "
                         f"WHERE e.rk <= {k} GROUP BY e.rid, t.class_label")
                pred = f"SELECT rid, arg_max(class_label, n * 100 - class_label) AS pred FROM ({votes}) GROUP BY rid"
                parts.append(f"SELECT CAST({k} AS BIGINT) AS k, {dbl(p)} AS p, {f} AS fold, "
                             f"avg(CAST(pr.pred = t.class_label AS DOUBLE)) AS acc FROM ({pred}) pr "
                             f"JOIN ({_EMB}) t USING (rid)")
    return f"SELECT k, p, round(avg(acc), 6) AS mean_accuracy FROM ({' UNION ALL '.join(parts)}) GROUP BY k, p"


_EMB = (f"SELECT *, {O.kfold_expr('row_idx', 'count(*) OVER ()', 5)} AS fold FROM "
        f"{O.with_pos(O.EMBEDDINGS, order='rid')}")


@query("h3_grid_search_cv", _cv_sql())
def h3_grid_search_cv(spark, sf_dir):
    """5 contiguous folds x k x metric: mean accuracy; one neighbour pass per metric serves every fold and k."""
    d = _fold_split(spark, sf_dir)
    refs = d.withColumn("fold", F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda f: f != F.col("fold"))))
    out = None
    for p in (1.0, 2.0):
        e = NB.knn_edges(d, refs, ["fold"], "rid", "vec", max(_CV_KS), p, exclude_self=False)
        lab = d.select(F.col("rid").alias("nid"), F.col("class_label").alias("__lab"))
        e = e.join(lab, "nid").withColumn("k", F.explode(F.array(*[F.lit(k) for k in _CV_KS])))
        e = e.filter(F.col("rank") <= F.col("k"))
        votes = e.groupBy("fold", "k", "rid", "__lab").agg(F.count(F.lit(1)).alias("__c"))
        pred = votes.groupBy("fold", "k", "rid").agg(
            F.max_by("__lab", F.struct(F.col("__c"), -F.col("__lab"))).alias("pred"))
        acc = G.accuracy(pred.join(d.select("rid", "class_label"), "rid"), ["fold", "k"], "pred", "class_label")
        r = acc.groupBy("k").agg(F.avg("accuracy").alias("mean_accuracy")).withColumn("p", F.lit(p))
        out = r if out is None else out.unionByName(r)
    return finish(out.select(F.col("k").cast("bigint").alias("k"), "p", "mean_accuracy"))


# scores from 0 to 5e8 in steps of 0.01: fifty billion levels, of which only those where a count changes are made
WIDE = "(SELECT CASE WHEN event_id = 3 THEN 5e8 ELSE value END AS score, CASE WHEN value > 300 OR event_id = 3 THEN 1 ELSE 0 END AS is_anomaly FROM events)"


@query("g11_best_threshold_wide_range", f"""WITH s AS {WIDE}, b AS (SELECT min(score) AS mn, max(score) AS mx, sum(is_anomaly) AS pos FROM s),
l AS (SELECT CAST(floor((score - mn) / {dbl(0.01)}) AS BIGINT) AS j0, score, is_anomaly, mn, mx FROM s, b),
j AS (SELECT CASE WHEN score >= mn + (j0 + 1) * {dbl(0.01)} AND j0 + 1 < ceil((mx - mn) / {dbl(0.01)}) THEN j0 + 1 WHEN score >= mn + j0 * {dbl(0.01)} THEN j0 ELSE j0 - 1 END AS j, is_anomaly, mn, mx FROM l),
j2 AS (SELECT least(j, CAST(ceil((mx - mn) / {dbl(0.01)}) AS BIGINT) - 1) AS j, is_anomaly, mn FROM j),
c AS (SELECT j, any_value(mn) AS mn, sum(is_anomaly) AS tp, count(*) AS pp FROM j2 GROUP BY j),
r AS (SELECT coalesce(lag(j) OVER (ORDER BY j) + 1, 0) AS lo, mn, sum(tp) OVER (ORDER BY j DESC) AS tp, sum(pp) OVER (ORDER BY j DESC) AS pp FROM c)
SELECT round(r.mn + lo * {dbl(0.01)}, 6) AS best_t, round(2.0 * tp / (pp + pos), 6) AS best_f1 FROM r, b ORDER BY 2.0 * tp / (pp + pos) DESC, lo LIMIT 1""")
def g11_best_threshold_wide_range(spark, sf_dir):
    """Best level of a sweep whose grid could never be written out."""
    e = C.table(spark, sf_dir, "events")
    odd = F.col("event_id") == 3
    s = e.select(F.when(odd, F.lit(5e8)).otherwise(F.col("value")).alias("score"), ((F.col("value") > 300) | odd).cast("int").alias("is_anomaly"))
    return finish(G.best_threshold(G.threshold_sweep(s, [], "score", step=0.01, expand=False), []))


# ---------------------------------------------------------------- forest: grid and sweep

_TREES, _SHARES = [10, 25, 50], [0.01, 0.02, 0.05]
_GRID_PATHS = O.forest_paths(*FOREST, 50, 256)
_GRID_SCORES = " UNION ALL ".join(
    f"SELECT {k} AS n_trees, rowno, round(pow(2.0, -sum(h) / ({k} * {O.c_factor(256.0)})), 9) AS score FROM paths WHERE tree < {k} GROUP BY rowno" for k in _TREES)
FOREST_GRID = f"""WITH {_GRID_PATHS}, s AS MATERIALIZED (SELECT n_trees, score, is_anomaly FROM ({_GRID_SCORES}) JOIN base USING (rowno)),
t AS (SELECT n_trees, c, CASE c {' '.join(f'WHEN {c} THEN quantile_cont(score, {1.0 - c})' for c in _SHARES)} END AS th
      FROM s, (SELECT unnest(CAST({_SHARES} AS DOUBLE[])) AS c) GROUP BY n_trees, c),
g AS (SELECT n_trees, c AS contamination, count_if(is_anomaly = 1 AND score > th) AS tp, count_if(is_anomaly = 0 AND score > th) AS fp,
      count_if(is_anomaly = 1 AND score <= th) AS fn FROM s JOIN t USING (n_trees) GROUP BY n_trees, c)
SELECT CAST(n_trees AS INTEGER) AS n_trees, contamination, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM g"""


def _grid_forest(spark, sf_dir):
    df, spec = C.dataset(spark, sf_dir, "lineitem")
    nodes, psi = FR.iforest_fit(df, list(C.LINE_KEY), list(spec.values), n_trees=50, max_samples=256, seed=42)
    return df, nodes, psi, list(spec.values)


@query("h4_forest_grid_f1", FOREST_GRID)
def h4_forest_grid_f1(spark, sf_dir):
    """F1 for every (number of trees, contamination); one fitted forest serves the grid."""
    df, nodes, psi, feats = _grid_forest(spark, sf_dir)
    return finish(H.forest_grid_f1(df, nodes, psi, feats, _TREES, _SHARES))


FOREST_SCORED = f"(WITH {_GRID_PATHS} SELECT round(pow(2.0, -h / (50 * {O.c_factor(256.0)})), 9) AS score, is_anomaly FROM base JOIN (SELECT rowno, sum(h) AS h FROM paths GROUP BY rowno) USING (rowno))"


@query("g8_forest_best_level", f"""WITH s AS MATERIALIZED {FOREST_SCORED},
l AS (SELECT j, CASE WHEN j = 89 THEN 1.0::DOUBLE ELSE 0.0 + CAST(j AS DOUBLE) * {dbl(_STEP89)} END AS t FROM (SELECT unnest(range(90)) AS j)),
g AS (SELECT t, count_if(is_anomaly = 1 AND score > t) AS tp, count_if(is_anomaly = 0 AND score > t) AS fp, count_if(is_anomaly = 1 AND score <= t) AS fn FROM s, l GROUP BY t)
SELECT round(t, 6) AS best_t, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS best_f1 FROM g
ORDER BY 2.0 * tp / (2 * tp + fp + fn) DESC, t LIMIT 1""")
def g8_forest_best_level(spark, sf_dir):
    """Best of 90 levels on [0, 1] for the forest's scores."""
    df, nodes, psi, feats = _grid_forest(spark, sf_dir)
    s = FR.iforest_score(df.select(*feats, "is_anomaly"), nodes, psi, feats).select("is_anomaly", F.round("score", 9).alias("score"))
    s = materialize(s, "forest-scored")
    sw = G.threshold_sweep(s, [], "score", step=_STEP89, inclusive=False, bounds=(0.0, 1.0), count=90, last=1.0, expand=False)
    return finish(G.best_threshold(sw, []))


# ---------------------------------------------------------------- forest: cross-validated model selection

_CV_WIDTH = 8           # channels selected from the embedding
_CV_FEATS = [f"v{i}" for i in range(_CV_WIDTH)]
_CV_ROWS = f"(SELECT rid, fold, is_anomaly, {', '.join(f'vec[{i + 1}] AS {c}' for i, c in enumerate(_CV_FEATS))} FROM ({_EMB}))"
FOREST_CV_GRID = {"n_trees": [400, 500, 600], "max_samples": [0.2, 0.25, 0.3], "max_features": [0.7, 0.8, 0.9], "contamination": [0.02, 0.03, 0.04]}
FOREST_CV_SPACE = {"n_trees": [100, 200, 300, 400, 500], "max_samples": [0.1, 0.2, 0.3, 0.4, 0.5],
                   "contamination": [0.001, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05], "max_features": [0.5, 0.7, 0.9, 1.0]}


def _space_sql(params):
    lists = ", ".join(f"(SELECT unnest(CAST({v} AS {'INTEGER' if k == 'n_trees' else 'DOUBLE'}[])) AS {k})" for k, v in params.items())
    return f"SELECT * FROM {lists}"


def _cv_channels(spark, sf_dir):
    d = _fold_split(spark, sf_dir)
    return d.select("rid", "fold", "is_anomaly", *[F.element_at("vec", i + 1).alias(c) for i, c in enumerate(_CV_FEATS)])


@query("h3_forest_grid_cv", O.forest_cv(_CV_ROWS, _CV_FEATS, _space_sql(FOREST_CV_GRID), 9))
def h3_forest_grid_cv(spark, sf_dir):
    """81 forests by mean AUROC over 5 folds: trees x sample x features x contamination."""
    combos = [r.asDict() for r in H.param_grid(spark, FOREST_CV_GRID).collect()]
    return finish(H.forest_cv(_cv_channels(spark, sf_dir), ["rid"], _CV_FEATS, combos))


_CV_DRAWN = f"SELECT * FROM ({_space_sql(FOREST_CV_SPACE)}) ORDER BY md5(concat_ws(':', '42', {', '.join(f'CAST({k} AS VARCHAR)' for k in FOREST_CV_SPACE)})) LIMIT 20"


@query("h2_forest_param_sample", O.forest_cv(_CV_ROWS, _CV_FEATS, _CV_DRAWN, 10))
def h2_forest_param_sample(spark, sf_dir):
    """20 forests drawn from 700 by a seeded hash, by mean AUROC over 5 folds; only drawn ones are fitted."""
    combos = [r.asDict() for r in H.param_sample(H.param_grid(spark, FOREST_CV_SPACE), 20, seed=42).collect()]
    return finish(H.forest_cv(_cv_channels(spark, sf_dir), ["rid"], _CV_FEATS, combos))
