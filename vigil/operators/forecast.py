"""Forecast-error detectors (re-aimed CNN forecaster).

The reference trained a small CNN on one machine.  Here the contract —
"predict the next p values from the last w, score = prediction error" — is
kept, and the model family is one a cluster fits natively:
``pyspark.ml`` linear regression (Huber loss) on lag vectors, one model per
output channel.  F11 is a fully exact baseline (window mean / last value)
whose whole scoring chain can be checked against SQL.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.positions import DEFAULT_BLOCK_ROWS, with_halo
from vigil.session import materialize
from vigil.operators.splits import split_fraction, split_tail_validation
from vigil.operators.stats import max_normalise, standardised_error
from vigil.operators.windows import lag_features, reverse_windowing


def _vector(features: str) -> F.Column:
    """The lags as an ML vector.  Rows with a missing lag are filtered, but Spark may evaluate a conversion
    before a filter; it must not meet a null there."""
    return array_to_vector(F.transform(features, lambda x: F.coalesce(x, F.lit(0.0))))


def forecast_fit(train: DataFrame, keys: list[str], values: list[str], window: int, pos: str = "row_idx",
                 block: int = DEFAULT_BLOCK_ROWS, max_iter: int = 100, reg: float = 0.0, model: str = "linear",
                 validation: float = 0.1, seed: int = 42):
    """F8: one model per channel on E4 lag vectors (``train`` = positioned training rows).

    model='linear': Huber-loss linear regression (L-BFGS); model='squared': least squares.
    model='gbt': gradient-boosted trees with absolute-error loss that stop
    when the error on the last ``validation`` share of the training rows
    (C4, in order) stops improving — the reference's validation-based stop.
    Returns {channel: fitted model}; the models are the fitted parameters.
    """
    # masked training: every lag and every target known
    lf = lag_features(train, keys, values, window, pos, block).na.drop(subset=list(values))
    lf = lf.withColumn("__x", _vector("features"))
    if model == "gbt":
        lf = split_tail_validation(lf, keys, validation, pos, "__val").withColumn("__val", F.col("__val") == 1)
    models = {}
    for v in values:
        if model in ("linear", "squared"):
            est = LinearRegression(featuresCol="__x", labelCol=v, predictionCol=f"{v}__pred", maxIter=max_iter, regParam=reg,
                                   loss="huber" if model == "linear" else "squaredError", elasticNetParam=0.0)
            models[v] = est.fit(lf.select("__x", F.col(v).cast("double").alias(v)))
        elif model == "gbt":
            est = GBTRegressor(featuresCol="__x", labelCol=v, predictionCol=f"{v}__pred", lossType="absolute",
                               maxIter=max_iter, validationIndicatorCol="__val", validationTol=0.01, seed=seed)
            models[v] = est.fit(lf.select("__x", "__val", F.col(v).cast("double").alias(v)))
        else:
            raise ValueError(f"unknown forecast model {model!r}")
    return models


def forecast_predict(df: DataFrame, models: dict, keys: list[str], values: list[str], window: int,
                     pos: str = "row_idx", block: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """prediction for every row that has w known predecessors (keys, pos, values, <v>__pred)."""
    lf = lag_features(df, keys, values, window, pos, block).withColumn("__x", _vector("features"))
    for v, m in models.items():
        lf = m.transform(lf)
    return lf.drop("__x", "features")


def forecast_error(pred: DataFrame, values: list[str], out: str = "error") -> DataFrame:
    """sqrt of the summed squared error over channels (and steps)."""
    sq = None
    for v in values:
        e = (F.col(f"{v}__pred") - F.col(v)) * (F.col(f"{v}__pred") - F.col(v))
        sq = e if sq is None else sq + e
    return pred.withColumn(out, F.sqrt(sq))


def window_forecast_error(windows: DataFrame, method: str = "mean", out: str = "error") -> DataFrame:
    """F10 on E1 windows with a baseline prediction (F11): mean or last value of the window."""
    if method == "mean":
        pred = F.aggregate("window", F.lit(0.0), lambda a, x: a + x) / F.size("window")
    elif method == "last":
        pred = F.element_at("window", -1)
    else:
        raise ValueError(f"unknown baseline {method!r}")
    err = F.sqrt(F.aggregate("target", F.lit(0.0), lambda a, t: a + (t - F.col("__pred")) * (t - F.col("__pred"))))
    return windows.withColumn("__pred", pred).withColumn(out, err).drop("__pred")


def baseline_window_errors(df: DataFrame, keys: list[str], values: list[str], window: int, horizon: int = 1,
                           pos: str = "row_idx", method: str = "mean", block: int = DEFAULT_BLOCK_ROWS,
                           out: str = "error") -> DataFrame:
    """F10 of a baseline forecast for every full window: (keys, win_start, error), all channels.

    Frame aggregates and ``lead`` over (series, block) with halo; no window array is built.
    """
    if method not in ("mean", "last"):
        raise ValueError(f"unknown baseline {method!r}")
    keys, span = list(keys), window + horizon
    d = df.select(*keys, pos, *[F.col(v).cast("double").alias(v) for v in values])
    h = with_halo(d, pos, block, 0, span - 1)
    order = Window.partitionBy(*keys, "_blk").orderBy(pos)
    frame, whole = order.rowsBetween(0, window - 1), order.rowsBetween(0, span - 1)
    full, total = F.lit(True), F.lit(0.0)
    for v in values:
        full = full & (F.count(v).over(whole) == span)
        pred = F.avg(v).over(frame) if method == "mean" else F.lead(v, window - 1).over(order)
        for step in range(horizon):
            miss = F.lead(v, window + step).over(order) - pred
            total = total + miss * miss
    h = h.withColumns({"__full": full, out: F.sqrt(total)}).filter(F.col("_home") & F.col("__full"))
    return h.select(*keys, F.col(pos).alias("win_start"), out)


def score_rows(df: DataFrame, errors: DataFrame, keys: list[str], size: int, pos: str = "row_idx",
               block: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Window errors (keys, win_start, error) -> standardised (D11) -> per row (E5) -> / max."""
    e = standardised_error(materialize(errors, "window-errors"), list(keys), "error", "score")   # feeds two branches
    rows = reverse_windowing(df, e, list(keys), size, pos, "score", block)
    return max_normalise(rows, list(keys), "score")


def forecast_baseline_score(df: DataFrame, keys: list[str], value, window: int = 45, horizon: int = 1,
                            pos: str = "row_idx", method: str = "mean",
                            block: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """baseline errors of one channel or a list of them -> (keys, pos, score) for every row of the series."""
    values = [value] if isinstance(value, str) else list(value)
    e = baseline_window_errors(df, keys, values, window, horizon, pos, method, block)
    return score_rows(df, e, keys, window + horizon, pos, block)


def forecast_model_score(df: DataFrame, keys: list[str], values: list[str], window: int, pos: str = "row_idx",
                         train_fraction: float = 0.75, model: str = "linear", block: int = DEFAULT_BLOCK_ROWS,
                         **fit) -> DataFrame:
    """F8-F10 end to end: fit on the first rows of every series, score all rows of all channels together.

    Windows with a missing value (lag or target, any channel) neither train nor score; every row stays, its score
    is the mean over the full windows that cover it, null if there is none.
    """
    train = split_fraction(df, list(keys), train_fraction, pos).filter("is_train = 1")
    models = forecast_fit(train, keys, list(values), window, pos, block, model=model, **fit)
    pred = forecast_error(forecast_predict(df, models, keys, list(values), window, pos, block), list(values))
    e = pred.filter(F.col("error").isNotNull()).select(*keys, (F.col(pos) - window).alias("win_start"), "error")
    return score_rows(df, e, keys, window + 1, pos, block)
