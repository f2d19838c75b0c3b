"""Apply models fitted by the batch jobs to a stream of new rows.

The reference is batch only; this module adds no operator.  It lets a model
fitted once (scaling statistics, a forest node table) score files arriving
in a folder, micro-batch by micro-batch, with Structured Streaming's
checkpointed exactly-once file sink.  Offsets and sink metadata live in the
shared checkpoint folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.operators import forest as FR
from vigil.session import checkpoint_dir


def read_table_stream(spark: SparkSession, folder: str, table: str, schema,
                      max_files_per_trigger: int = 64) -> DataFrame:
    """Stream the Parquet files of one table (``<table>*.parquet``) arriving in ``folder``."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*.parquet")
                 .option("maxFilesPerTrigger", max_files_per_trigger).parquet(folder))


def scale_and_flag(stream: DataFrame, stats: dict, col: str, level: float, out: str = "flag") -> DataFrame:
    """D3 transform with fitted (mean, std) and an F16 flag on |z| > level."""
    z = (F.col(col) - F.lit(float(stats["mean"]))) / F.lit(float(stats["std"]))
    return stream.withColumn("z", z).withColumn(out, (F.abs(F.col("z")) > F.lit(float(level))).cast("int"))


def forest_scores(stream: DataFrame, nodes: DataFrame, psi: int, features: list[str]) -> DataFrame:
    """F6 on a streaming DataFrame (the Arrow scorer works per micro-batch)."""
    return FR.iforest_score(stream, nodes, psi, features)


def write_parquet_stream(df: DataFrame, out_path: str, name: str, once: bool = True) -> StreamingQuery:
    """Checkpointed file sink; ``once`` processes what is available, then stops."""
    ckpt = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/streams/{name}"
    w = df.writeStream.format("parquet").option("checkpointLocation", ckpt).outputMode("append")
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")
    return w.start(out_path)
