"""Score files, scored-table exports and model persistence.

Scores are always written *keyed* (series, position or row id) — the
reference wrote bare score vectors whose meaning depended on row order.
Writers are multi-file (no ``coalesce(1)``): every task writes its part.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

SCORE_SCHEMA = "series_id long, row_idx long, score double"


def write_scores(scores: DataFrame, path: str, fmt: str = "csv") -> str:
    """A5: persist one keyed score per row/window."""
    w = scores.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def read_scores(spark: SparkSession, path: str, schema: str = SCORE_SCHEMA, fmt: str = "csv") -> DataFrame:
    """A4: load a keyed score file with an explicit schema (no inference pass)."""
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.parquet(path)


def write_scored_table(series: DataFrame, scores: DataFrame, keys: list[str], path: str) -> str:
    """Series with its score columns attached by key (A9), as CSV with header."""
    attach_scores(series, scores, keys).write.mode("overwrite").option("header", True).csv(path)
    return path


def attach_scores(series: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Left equi-join on the row key (positions or ids) — never by row order."""
    return series.join(scores, list(keys), "left")


# Fixed value: timestamp text format with microseconds (the default keeps milliseconds only).
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def export_csv(df: DataFrame, path: str) -> str:
    """Table -> CSV folder with header, one file per task (timestamps keep microseconds)."""
    (df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", TS_FORMAT)
       .option("timestampFormat", TS_FORMAT).csv(path))
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read a folder written by ``export_csv`` with an explicit schema."""
    return (spark.read.schema(schema).option("header", True).option("timestampNTZFormat", TS_FORMAT)
                 .option("timestampFormat", TS_FORMAT).csv(path))


def save_forest(nodes: DataFrame, psi: int, path: str) -> str:
    """A forest is its node table (Parquet) plus psi (a one-line JSON beside it)."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    meta = nodes.sparkSession.createDataFrame([(json.dumps({"psi": int(psi)}),)], "meta string")
    meta.write.mode("overwrite").text(f"{path}/meta")
    return path


def load_forest(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    nodes = spark.read.parquet(f"{path}/nodes")
    psi = json.loads(spark.read.text(f"{path}/meta").head()[0])["psi"]
    return nodes, int(psi)


def save_ml_model(model, path: str) -> str:
    """A11 for pyspark.ml models (forecasters, PCA)."""
    model.write().overwrite().save(path)
    return path


def load_ml_model(model_cls, path: str):
    """Restore a pyspark.ml model saved by ``save_ml_model`` (pass its class)."""
    return model_cls.load(path)
