"""Turning scores into 0/1 flags (strict ``score > level``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.stats import outlier_share, percentile_of, quantiles
from vigil.session import attach_scalars


def flag_threshold(df: DataFrame, score: str, level: float, out: str = "flag") -> DataFrame:
    """F16: fixed level."""
    return df.withColumn(out, (F.col(score) > F.lit(float(level))).cast("int"))


def flag_share(df: DataFrame, keys: list[str], score: str, label: str = "is_anomaly",
               out: str = "flag") -> DataFrame:
    """LoOP rule, flag iff score > outlier share of the series."""
    d = attach_scalars(df, outlier_share(df, keys, label), list(keys))
    return d.withColumn(out, (F.col(score) > F.col("outlier_share")).cast("int")).drop("outlier_share")


def flag_percentile(df: DataFrame, keys: list[str], score: str, q: float, out: str = "flag") -> DataFrame:
    """flag iff score > q-th percentile of the series' scores."""
    d = attach_scalars(df, percentile_of(df, keys, score, q), list(keys))
    return d.withColumn(out, (F.col(score) > F.col("threshold")).cast("int")).drop("threshold")


def contamination_label(df: DataFrame, keys: list[str], score: str, contamination: float,
                        out: str = "flag") -> DataFrame:
    """flag rows above the (1 - contamination) score quantile."""
    t = quantiles(df, keys, score, [1.0 - float(contamination)]).select(*keys, F.col("value").alias("__t"))
    d = attach_scalars(df, t, list(keys))
    return d.withColumn(out, (F.col(score) > F.col("__t")).cast("int")).drop("__t")
