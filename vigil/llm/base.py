"""Registration and table helpers of the subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import checkpoint_dir, materialize, ship_package

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: Rows per Arrow batch: batches of a few MB of text keep Python workers small.
ARROW_ROWS = 500


def tune(spark: SparkSession) -> SparkSession:
    """Arrow batch size, and the package on the executors; call it once before using the operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    ship_package(spark)
    return spark


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write once in the shared checkpoint folder and read back (cuts lineage, survives lost executors)."""
    return materialize(df, f"llm-{name}")


def drop_table(df: DataFrame) -> None:
    """Delete a table made by ``write_table`` once nothing will read it again."""
    spark = df.sparkSession
    jvm = spark._jvm
    root = checkpoint_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/vigil-tables/llm-" in folder and root.split(":")[-1].strip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def as_text(c) -> F.Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def map_text(docs: DataFrame, kernel: Callable, fields: list[tuple[str, str]], keep: list[str], text: str = "text",
             slice_bytes: int | None = None, then: tuple[Callable, str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` plus what ``kernel(bytes, offsets)`` computes for each row's whole text.

    ``kernel`` gets one slice of neighbouring rows and returns one Arrow array (or numpy array) per field.
    ``then`` = (batches -> batches, schema) goes over the result in the same Python worker (a second
    ``mapInArrow`` would keep twice as many workers on every executor).
    """
    import pyarrow as pa

    from vigil.llm.text import SLICE_BYTES, slices
    src = docs.select(*keep, *([] if text in keep else [text]))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    schema = ", ".join(f"`{n}` {t}" for n, t in [*((k, kinds[k]) for k in keep), *fields])
    names = [*keep, *(n for n, _ in fields)]
    most = slice_bytes or SLICE_BYTES

    def run(batches):
        for batch in batches:
            for i, j, buf, offs in slices(batch, text, most):
                new = kernel(buf, offs)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(i, j - i) for k in keep),
                     *(c if isinstance(c, pa.Array) else pa.array(c) for c in new)], names=names)
    if then:
        return src.mapInArrow(lambda batches: then[0](run(batches)), then[1])
    return src.mapInArrow(run, schema)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or with underscores behind it where an input column already has it (Spark ignores case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
