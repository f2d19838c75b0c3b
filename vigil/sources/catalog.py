"""A1-A3: logical dataset names -> DataFrames in the series layout.

The driver tables stand in for the reference's catalog tables (see
FIXTURES.md): ``events`` is the univariate series, ``embeddings`` the
multivariate one, ``lineitem`` the wide numeric table.  Every builder only
selects the columns it needs, so Parquet scans are pruned, and nothing is
collected: each entry lazily returns a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.columns import in_interval
from vigil.spec import SeriesSpec

# Fixed values that define the labelled stand-ins (must match the oracles).
PLANT_EVERY = 97            # events.event_id % 97 = 0 are planted anomalies
PLANT_SHIFT = 600.0         # planted value = value + 600
LINE_PLANT_SHIFT = 100.0    # planted lineitem quantity = l_quantity + 100
INTERVAL = ("2024-01-10 00:00:00", "2024-01-10 12:00:00")
COLLECTIVE_PERIOD, COLLECTIVE_LO, COLLECTIVE_HI, COLLECTIVE_VALUE = 2000, 1000, 1059, 250.0

# One long series has no series key: every per-series statistic then attaches
# as a scalar subquery instead of a join on a constant column.
UNIVARIATE = SeriesSpec(keys=())
BY_USER = SeriesSpec(keys=("series_id",))
MULTIVARIATE = SeriesSpec(keys=(), order=("rid",), values=("vec",))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A1: full scan of one driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_columns(spark: SparkSession, sf_dir: str, name: str, cols: list[str]) -> DataFrame:
    """A2: scan only the named columns (Parquet column pruning)."""
    return table(spark, sf_dir, name).select(*cols)


def planted_flag(id_col: str) -> F.Column:
    return F.when(F.col(id_col) % PLANT_EVERY == 0, F.lit(1)).otherwise(F.lit(0))


def events_planted(spark, sf_dir, by_user: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "events")
    lab = planted_flag("event_id")
    sid = F.col("user_id") if by_user else F.lit(0).cast("bigint")
    return e.select(sid.alias("series_id"), F.col("event_id").alias("rid"), "ts",
                    (F.col("value") + F.lit(PLANT_SHIFT) * lab).alias("value"),
                    lab.alias("is_anomaly"))


def events_weak(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.lit(0).cast("bigint").alias("series_id"), F.col("event_id").alias("rid"), "ts", "value",
                    F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_anomaly"))


def events_interval(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.lit(0).cast("bigint").alias("series_id"), F.col("event_id").alias("rid"), "ts", "value",
                    in_interval("ts", *INTERVAL).alias("is_anomaly"))


def events_collective(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    m = F.col("event_id") % COLLECTIVE_PERIOD
    lab = F.when(m.between(COLLECTIVE_LO, COLLECTIVE_HI), 1).otherwise(0)
    return e.select(F.lit(0).cast("bigint").alias("series_id"), F.col("event_id").alias("rid"), "ts",
                    F.when(lab == 1, F.lit(COLLECTIVE_VALUE)).otherwise(F.col("value")).alias("value"),
                    lab.alias("is_anomaly"))


def events_sparse_pair(spark, sf_dir) -> DataFrame:
    """Two channels with gaps: the planted value and the minute of the day, each missing at places of its own."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    lab = planted_flag("event_id")
    minute = F.hour("ts") * 60 + F.minute("ts")
    return e.select(F.lit(0).cast("bigint").alias("series_id"), i.alias("rid"), "ts",
                    F.when(i % 31 != 5, F.col("value") + F.lit(PLANT_SHIFT) * lab).alias("value"),
                    F.when(i % 43 != 11, minute.cast("double")).alias("minute"), lab.alias("is_anomaly"))


def embeddings(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit(0).cast("bigint").alias("series_id"), F.col("vec_id").alias("rid"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
                    F.col("label").alias("class_label"),
                    F.when(F.col("label") == 0, 1).otherwise(0).alias("is_anomaly"))


LINE_CHANNELS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_KEY = ("rid", "l_partkey", "l_suppkey")
# (l_orderkey, l_linenumber) repeats in the data and even the key above has a
# duplicate at the smallest scale: the channel values complete a total order.
LINE_ORDER = LINE_KEY + LINE_CHANNELS


def lineitem_planted(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    lab = planted_flag("l_orderkey")
    return li.select(F.lit(0).cast("bigint").alias("series_id"),
                     (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rid"), "l_partkey", "l_suppkey",
                     (F.col("l_quantity") + F.lit(LINE_PLANT_SHIFT) * lab).alias("l_quantity"),
                     "l_extendedprice", "l_discount", "l_tax", lab.alias("is_anomaly"))


def labelled_documents(spark, sf_dir, label: str = "toxic") -> DataFrame:
    """Binary labels without series: score = n_chars, label from ``labels``."""
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("is_anomaly"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return docs.join(lab, "doc_id").select(F.lit(0).cast("bigint").alias("series_id"),
                                           F.col("doc_id").alias("rid"), "score", "is_anomaly")


CATALOG = {
    "events": (events_planted, UNIVARIATE),
    "events_by_user": (lambda s, d: events_planted(s, d, by_user=True), BY_USER),
    "events_weak": (events_weak, UNIVARIATE),
    "events_interval": (events_interval, UNIVARIATE),
    "events_collective": (events_collective, UNIVARIATE),
    "events_sparse_pair": (events_sparse_pair, SeriesSpec(keys=(), values=("value", "minute"))),
    "embeddings": (embeddings, MULTIVARIATE),
    "lineitem": (lineitem_planted, SeriesSpec(keys=(), order=LINE_ORDER, values=LINE_CHANNELS, row_key=LINE_KEY)),
}


def dataset(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, SeriesSpec]:
    """A3: logical dataset name -> (DataFrame, spec); unknown names raise."""
    if name not in CATALOG:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(CATALOG)}")
    build, spec = CATALOG[name]
    return build(spark, sf_dir), spec
