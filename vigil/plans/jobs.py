"""End-to-end detector jobs (the reference's notebooks as lazy Spark plans).

Each job: scan -> label -> (split/scale/window) -> score -> flag -> metrics.
Everything stays a DataFrame; only the final metric rows are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators import evaluate as G
from vigil.operators import flags as FL
from vigil.operators import forecast as FC
from vigil.operators import forest as FR
from vigil.operators import neighbors as NB
from vigil.operators import positions as P
from vigil.operators import reconstruct as RC
from vigil.session import materialize
from vigil.sources import catalog as C
from vigil.spec import ForecastConfig, ForestConfig, KnnConfig, LoopConfig, ReconstructConfig, from_dict


def knn_scores(df: DataFrame, keys: list[str], k: int, value: str = "value", rid: str = "rid") -> DataFrame:
    """(keys, rid, score): k-th neighbour distance on one value column."""
    return NB.knn_score_1d(df, keys, value, rid, k)


def scored_knn_1d(spark, sf_dir: str, dataset: str = "events_by_user", k: int = 1, q: float = 98.0,
                  block: int | None = None) -> DataFrame:
    """kNN (k-th neighbour distance on the value) per series, flagged above the q-th percentile."""
    return knn_1d_scored_and_flagged(spark, sf_dir, dataset, k, q, block)[1]


def knn_1d_scored_and_flagged(spark, sf_dir: str, dataset: str = "events_by_user", k: int = 1,
                              q: float = 98.0, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored, flagged): the written score table and its percentile flags."""
    df, spec = C.dataset(spark, sf_dir, dataset)
    keys = list(spec.keys)
    kw = {"block": block} if block else {}
    s = NB.knn_score_1d(df, keys, "value", "rid", k, carry=("is_anomaly",), **kw)
    # the scored table feeds the percentile, the flags and every metric: write it once
    scored = materialize(s, "knn-scored")
    return scored, FL.flag_percentile(scored, keys, "score", q)


def board_row(flagged: DataFrame, dataset: str, detector: str, score: str = "score",
              label: str = "is_anomaly", flag: str = "flag", scores: DataFrame | None = None) -> DataFrame:
    """One leaderboard row: F1 of the flags and AUROC of the scores over the dataset.

    ``scores`` (the unflagged score table) spares the AUROC sort the flag join.
    """
    f1 = G.prf(G.confusion(flagged, [], label, flag)).select("f1")
    auc = G.auroc(scores if scores is not None else flagged, [], score, label)
    return f1.select(F.lit(dataset).alias("dataset"), F.lit(detector).alias("detector"), "f1",
                     auc.select("auroc").scalar().alias("auroc"))


# ------------------------------------------------------------------ config-driven jobs

DETECTORS = ("knn", "loop", "iforest", "forecast", "reconstruct")


def _channels(df: DataFrame, spec) -> tuple[DataFrame, list[str]]:
    """Scalar channels of a dataset; a single vector column is spread over columns v0, v1, ..."""
    if spec.values != ("vec",):
        return df, list(spec.values)
    width = df.select(F.size("vec")).head()[0]
    names = [f"v{i}" for i in range(width)]
    return df.select("*", *[F.element_at("vec", i + 1).alias(n) for i, n in enumerate(names)]), names


def _vectors(df: DataFrame, spec) -> tuple[DataFrame, str, list[str]]:
    """Rows with one vector column ``vec`` and a unique id: (rows, id column, columns that name a row)."""
    keys = list(spec.keys)
    if spec.values == ("vec",):
        return df, spec.rid, [spec.rid]
    if not spec.row_key:
        return df.withColumn("vec", F.array(*[F.col(v).cast("double") for v in spec.values])), spec.rid, [spec.rid]
    # the row id repeats: rows are named by their position in the total order
    p = P.row_index(df, keys, list(spec.order))
    return p.withColumn("vec", F.array(*[F.col(v).cast("double") for v in spec.values])), "row_idx", ["row_idx", *spec.row_key]


def run_job(spark, sf_dir: str, conf: dict) -> tuple[DataFrame, DataFrame]:
    """Run one detector from a JSON-like config, like the reference's notebooks.

    conf: {"dataset": <catalog name>, "detector": knn | loop | iforest | forecast | reconstruct, ...params}.
    Unknown datasets, detectors or parameter keys raise before any job runs.  All channels of the dataset
    are used.  Returns (flagged rows, one leaderboard row).
    """
    conf = dict(conf)
    name, det = conf.pop("dataset"), conf.pop("detector")
    if det not in DETECTORS:
        raise KeyError(f"unknown detector {det!r}; known: {DETECTORS}")
    df, spec = C.dataset(spark, sf_dir, name)
    keys, label = list(spec.keys), spec.label
    univariate = spec.values == ("value",)
    if det == "knn":
        cfg = from_dict(KnnConfig, conf)
        if univariate:
            s = NB.knn_score_1d(df, keys, "value", spec.rid, cfg.k, carry=(label,))
        else:
            rows, rid, named = _vectors(df, spec)
            rows = materialize(rows.select(*keys, *named, "vec", label), "job-vectors")
            s = rows.select(*keys, *named, label).join(NB.knn_score(rows, keys, rid, "vec", cfg.k, cfg.p, cfg.block_rows), keys + [rid])
        scored = materialize(s, "job-knn")
        flagged = FL.flag_percentile(scored, keys, "score", cfg.percentile)
        title = "Knn"
    elif det == "loop":
        cfg = from_dict(LoopConfig, conf)
        if univariate:
            rows, rid, named = df, spec.rid, [spec.rid]
            s = NB.loop_1d(df, keys, "value", spec.rid, cfg.k, cfg.extent)
        else:
            rows, rid, named = _vectors(df, spec)
            rows = materialize(rows.select(*keys, *named, "vec", label), "job-vectors")
            s = NB.loop_vec(rows, keys, rid, "vec", cfg.k, cfg.extent)
        scored = materialize(rows.select(*keys, *named, label).join(s, keys + [rid], "left"), "job-loop")
        flagged = FL.flag_share(scored, keys, "score", label)
        title = "LoOP"
    elif det == "iforest":
        contamination = conf.pop("contamination", 0.1)
        cfg = from_dict(ForestConfig, conf)
        df, feats = _channels(df, spec)
        nodes, psi = FR.iforest_fit(df, list(spec.key_cols()), feats, cfg.n_trees, cfg.max_samples, cfg.seed,
                                    cfg.max_features, cfg.bootstrap)
        scored = materialize(FR.iforest_score(df.select(*keys, *spec.key_cols(), *feats, label), nodes, psi, feats),
                             "job-forest")
        flagged = FL.contamination_label(scored, keys, "score", contamination)
        title = "IForest"
    else:
        cfg = from_dict(ForecastConfig if det == "forecast" else ReconstructConfig, conf)
        df, values = _channels(df, spec)
        p = P.row_index(df, keys, list(spec.order))
        if det == "reconstruct":
            s = RC.reconstruct_score(p, keys, values, cfg.window, cfg.rank, "row_idx", cfg.train_fraction)[0].drop("channel_mae")
            title = "LSTM-AE"
        elif cfg.model == "baseline":
            s = FC.forecast_baseline_score(p, keys, values, cfg.window, cfg.horizon, block=cfg.block_rows)
            title = "Baseline"
        else:
            s = FC.forecast_model_score(p, keys, values, cfg.window, "row_idx", cfg.train_fraction, cfg.model, cfg.block_rows)
            title = "DeeP-ANT"
        # rows without a window in front have no score: they stay, unflagged
        scored = materialize(p.select(*keys, "row_idx", label).join(s, keys + ["row_idx"], "left"), f"job-{det}")
        flagged = FL.flag_threshold(scored, "score", cfg.level)
    return flagged, board_row(flagged, name, title, label=label, scores=scored)
