"""Session set-up and the few cluster-level helpers every operator shares.

Nothing here schedules work: it only configures Spark (AQE, UTC, Arrow),
resolves the shared checkpoint folder, and decides whether a side of a join
is small enough to broadcast after *measuring* it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names this process's written outputs, so that two runs on one shared folder keep apart.
RUN_ID = uuid.uuid4().hex[:12]


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "vigil") -> SparkSession:
    """Session with the settings the engine relies on (AQE, UTC, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Settings that must hold for results to be right whatever session we get."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (once per context): Arrow functions import it there.

    The archive is written on the driver and served by Spark itself; executors need no install,
    PYTHONPATH or shared folder for it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_vigil_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="vigil-package-"), "vigil.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    sc.addPyFile(path)
    sc._vigil_shipped = True


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must come from the session.  Only a local
    session (tests, laptops) gets a private folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running vigil jobs")
        conf_dir = tempfile.mkdtemp(prefix="vigil-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def output_dir(spark: SparkSession, name: str) -> str:
    """A folder of this run for written tables: under ``vigil.output.dir``, else beside the checkpoints (shared storage)."""
    base = spark.conf.get("vigil.output.dir", None) or os.path.join(checkpoint_dir(spark), "vigil-out")
    return f"{base.rstrip('/')}/{RUN_ID}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Used where one result feeds two branches that must agree exactly (a
    range partitioning sampled twice could differ); the files also survive
    the loss of the executors that computed them.  The shuffle files of the
    write go when it ends (Spark 4.1): the table replaces them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/vigil-tables/{name}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)
    return spark.read.parquet(path)


def written_tables(df: DataFrame) -> set[str]:
    """Folders of ``materialize`` that ``df`` reads."""
    root = checkpoint_dir(df.sparkSession).split(":")[-1].strip("/") + "/vigil-tables/"
    return {f.rsplit("/", 1)[0] for f in df.inputFiles() if root in f.rsplit("/", 1)[0]}


def discard(tables: set[str], kept: DataFrame) -> None:
    """Delete written tables (``written_tables``) that nothing but the caller read, except those that ``kept`` reads."""
    spark = kept.sparkSession
    for folder in sorted(tables - written_tables(kept)):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Round-robin the rows over ``partitions`` tasks if a number is given, else leave them where they are.

    For CPU-heavy per-row work on an input of few scan splits; the caller decides, nothing is measured.
    """
    return df.repartition(partitions) if partitions else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def join_measured(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Equi-join whose broadcast decision is made on *measured* sizes.

    No hint is given: with AQE on, Spark materialises the shuffle of each
    side first and converts the join to a broadcast hash join only when the
    measured side is below ``spark.sql.adaptive.autoBroadcastJoinThreshold``;
    otherwise it stays a (skew-split) sort-merge join.  ``on`` is a list of
    column names compared null-safely, or a join Column.
    """
    if isinstance(on, (list, tuple)):
        if not on:
            raise ValueError("join_measured needs join keys")
        renamed = small.withColumnsRenamed({c: f"__r_{c}" for c in on})
        cond = None
        for c in on:
            e = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
            cond = e if cond is None else cond & e
        return big.join(renamed, cond, how).drop(*[f"__r_{c}" for c in on])
    return big.join(small, on, how)


def attach_scalars(df: DataFrame, scalars: DataFrame, on: list[str] | None = None,
                   how: str = "inner") -> DataFrame:
    """Attach per-group statistics (one row per group) to every row.

    With no keys the statistics table has exactly one row and each of its
    columns becomes a scalar subquery (Catalyst merges them into a single
    aggregate); with keys its size is measured before choosing a broadcast.
    """
    if not on:
        return df.withColumns({c: scalars.select(c).scalar() for c in scalars.columns})
    return join_measured(df, scalars, on, how)

