"""Per-dataset leaderboards (detector, F1, AUROC).

A board is a DataFrame (dataset, detector, f1, auroc).  On disk it keeps
the reference's CSV layout — ``Metric, F1 Score, AUROC Score`` — one folder
per dataset.  Upserts write a *new* version folder: Spark cannot overwrite
the path it is reading from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The on-disk column names and detector names of the boards.
CSV_COLUMNS = ("Metric", "F1 Score", "AUROC Score")
DETECTORS = ("LSTM-AE", "DeeP-ANT", "Knn", "IForest", "LoOP")
BOARD_SCHEMA = "dataset string, detector string, f1 double, auroc double"


def empty_board(spark: SparkSession, dataset: str) -> DataFrame:
    rows = [(dataset, d, None, None) for d in DETECTORS]
    return spark.createDataFrame(rows, BOARD_SCHEMA)


def upsert(board: DataFrame, rows: DataFrame) -> DataFrame:
    """Replace the (dataset, detector) rows present in ``rows``; others unchanged."""
    rows = rows.select("dataset", "detector", F.col("f1").cast("double"), F.col("auroc").cast("double"))
    keep = board.join(rows.select("dataset", "detector"), ["dataset", "detector"], "left_anti")
    return keep.unionByName(rows)


def write_board(board: DataFrame, base: str, version: int) -> str:
    """Write each dataset's board as CSV under base/<dataset>/v<version>."""
    path = f"{base.rstrip('/')}/v{int(version)}"
    (board.select("dataset", F.col("detector").alias(CSV_COLUMNS[0]), F.col("f1").alias(CSV_COLUMNS[1]),
                  F.col("auroc").alias(CSV_COLUMNS[2]))
          .write.mode("overwrite").partitionBy("dataset").option("header", True).csv(path))
    return path


def read_board(spark: SparkSession, path: str) -> DataFrame:
    """Read a board folder written by ``write_board`` (dataset from the folder name)."""
    schema = f"`{CSV_COLUMNS[0]}` string, `{CSV_COLUMNS[1]}` double, `{CSV_COLUMNS[2]}` double, dataset string"
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select("dataset", F.col(CSV_COLUMNS[0]).alias("detector"), F.col(CSV_COLUMNS[1]).alias("f1"),
                     F.col(CSV_COLUMNS[2]).alias("auroc"))


def union_boards(boards: dict[str, DataFrame]) -> DataFrame:
    """A10: all per-dataset boards in one DataFrame (dataset column from the key)."""
    out = None
    for name, b in boards.items():
        b = b.select(F.lit(name).alias("dataset"), "detector", "f1", "auroc")
        out = b if out is None else out.unionByName(b)
    return out
