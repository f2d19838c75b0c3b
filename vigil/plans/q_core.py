"""Registered queries: the flagship, B12 positions, 1-D kNN, quantiles and AUROC."""

from __future__ import annotations

from vigil.operators import evaluate as G
from vigil.operators import neighbors as NB
from vigil.operators import positions as P
from vigil.operators import stats as D
from vigil.plans import jobs as J
from vigil.plans import oracle_sql as O
from vigil.plans.base import ORACLES, finish, query, r6
from vigil.sources import catalog as C


# ---------------------------------------------------------------- flagship

@query("knn_events_by_user_board", f"""
WITH s AS ({O.EVENTS_BY_USER}),
sc AS (SELECT s.series_id, s.rid, s.is_anomaly, n.score FROM s JOIN {O.knn_1d('SELECT * FROM s', 1)} n
       USING (series_id, rid)),
fl AS {O.percentile_flag('SELECT * FROM sc', 98.0)}
SELECT 'events_by_user' AS dataset, 'Knn' AS detector,
       {r6(O.f1_sql('SELECT * FROM fl'), 'f1')}, {r6('(SELECT auroc FROM ' + O.auroc_sql('SELECT * FROM fl') + ')', 'auroc')}
""")
def knn_events_by_user_board(spark, sf_dir):
    """Flagship: per-user 1-D kNN (k=1), p98 flags, F1 + AUROC as a board row."""
    scored, flagged = J.knn_1d_scored_and_flagged(spark, sf_dir, "events_by_user", k=1, q=98.0)
    return finish(J.board_row(flagged, "events_by_user", "Knn", scores=scored))


# ------------------------------------------------------------------- F2

@query("f2_knn_1d_by_user", f"""
SELECT series_id, rid, {r6('score', 'score')} FROM {O.knn_1d(O.EVENTS_BY_USER, 5)}
""")
def f2_knn_1d_by_user(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events_by_user")
    return finish(NB.knn_score_1d(df, ["series_id"], "value", "rid", 5))


@query("f2_knn_1d_global", f"""
WITH s AS ({O.EVENTS}),
p AS (SELECT rid, value, row_number() OVER (ORDER BY value, rid) AS pos FROM s),
c AS (SELECT a.rid, abs(a.value - b.value) AS d FROM p a JOIN p b
      ON b.pos BETWEEN a.pos - 3 AND a.pos + 3 AND b.pos <> a.pos),
r AS (SELECT rid, d, row_number() OVER (PARTITION BY rid ORDER BY d) AS rn FROM c)
SELECT rid, {r6('d', 'score')} FROM r WHERE rn = 3
""")
def f2_knn_1d_global(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events")
    return finish(NB.knn_score_1d(df, [], "value", "rid", 3))


# ------------------------------------------------------------------ B12

@query("b12_row_index_by_user", f"""
SELECT series_id, rid, row_number() OVER (PARTITION BY series_id ORDER BY ts, rid) - 1 AS row_idx
FROM ({O.EVENTS_BY_USER})
""")
def b12_row_index_by_user(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events_by_user")
    return P.row_index(df.select("series_id", "rid", "ts"), ["series_id"], ["ts", "rid"]).drop("ts")


@query("b12_row_index_global", f"""
SELECT rid, row_number() OVER (ORDER BY ts, rid) - 1 AS row_idx FROM ({O.EVENTS})
""")
def b12_row_index_global(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events")
    return P.row_index(df.select("rid", "ts"), [], ["ts", "rid"]).drop("ts")


# ---------------------------------------------------------- D9, F18, G

_QS = [0.01, 0.9, 0.95, 0.97, 0.98, 0.99]


@query("d9_score_percentile", " UNION ALL ".join(
    f"SELECT series_id, CAST({q} AS DOUBLE) AS q, round(CAST(quantile_cont(value, {q}) AS DOUBLE), 6) AS value "
    f"FROM ({O.EVENTS_BY_USER}) GROUP BY series_id" for q in _QS))
def d9_score_percentile(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events_by_user")
    return finish(D.quantiles(df, ["series_id"], "value", _QS))


@query("g3_auroc_weak", f"""
SELECT {r6('auroc', 'auroc')} FROM {O.auroc_sql(O.EVENTS_WEAK, 'value')}
""")
def g3_auroc_weak(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events_weak")
    return finish(G.auroc(df, [], "value"))


@query("g3_auroc_by_user", f"""
SELECT series_id, {r6('auroc', 'auroc')} FROM {O.auroc_sql(O.EVENTS_BY_USER, 'value', by='series_id')}
""")
def g3_auroc_by_user(spark, sf_dir):
    df, _ = C.dataset(spark, sf_dir, "events_by_user")
    return finish(G.auroc(df, ["series_id"], "value"))


@query("knn_job_from_config")
def knn_job_from_config(spark, sf_dir):
    """The flagship run from a JSON-like job config (the reference's entry point)."""
    conf = {"dataset": "events_by_user", "detector": "knn", "k": 1, "percentile": 98.0}
    return finish(J.run_job(spark, sf_dir, conf)[1])


ORACLES["knn_job_from_config"] = ORACLES["knn_events_by_user_board"]
