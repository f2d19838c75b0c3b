"""Projection, typing, labelling and positional selection.

The reference addressed rows and columns by position; here every positional
operation reads an explicit ``row_idx`` (B12, see ``positions.row_index``)
and every column is named.  All operators are column expressions or
filters, so Parquet pushdown and pruning stay intact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions import columns as X
from vigil.operators.positions import row_index, running_sum
from vigil.operators.positions import row_index  # noqa: F401  (B12 re-exported)
from vigil.spec import SeriesSpec


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """B1."""
    return df.drop(*cols)


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """B2 (e.g. 'Normal/Attack' or 'isAnomoly' -> 'is_anomaly')."""
    return df.withColumnsRenamed(mapping)


def cast_all_double(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Strict cast (ANSI: malformed text raises, as astype(float) does)."""
    cols = cols or df.columns
    return df.withColumns({c: X.strict_double(c) for c in cols})


def to_numeric_coerce(df: DataFrame, cols: list[str]) -> DataFrame:
    """Lenient cast, malformed text -> null."""
    return df.withColumns({c: X.lenient_double(c) for c in cols})


def dropna_subset(df: DataFrame, cols: list[str]) -> DataFrame:
    """B5."""
    return df.na.drop(subset=list(cols))


def recode_label(df: DataFrame, col: str, mapping: dict | None = None) -> DataFrame:
    """Normal -> 0, Attack -> 1; other values are kept (and fail a later strict cast)."""
    mapping = mapping or {"Normal": "0", "Attack": "1"}
    return df.withColumn(col, X.recode(col, mapping))


def parse_timestamp(df: DataFrame, col: str, fmt: str = " d/M/y h:mm:ss a", out: str | None = None):
    """E.g. ' 28/12/2015 10:00:00 AM' -> timestamp (bad text -> null)."""
    return df.withColumn(out or col, X.parse_timestamp(col, fmt))


def label_by_interval(df: DataFrame, ts: str, start: str, end: str, out: str = "is_anomaly") -> DataFrame:
    """1 iff start <= ts <= end (both inclusive)."""
    return df.withColumn(out, X.in_interval(ts, start, end))


def label_by_intervals(df: DataFrame, ts: str, intervals: DataFrame, out: str = "is_anomaly") -> DataFrame:
    """B8 for many intervals (columns start, end): the number of open intervals along time.

    Starts (+1), rows and ends (-1) are put in one order by time -- starts before and ends behind rows of
    the same time, both ends inclusive -- and a distributed running sum tells at each row how many
    intervals are open.  No row meets an interval; a crowded day is just more rows of the sort.  A row
    without time gets a null label, as with one interval.
    """
    own = F.struct(*[F.col(c) for c in df.columns])
    iv = intervals.filter(F.col("start") <= F.col("end"))
    rows = df.filter(F.col(ts).isNotNull()).select(F.col(ts).alias("__at"), F.lit(1).alias("__o"), F.lit(0).alias("__d"), own.alias("__row"))
    blank = F.lit(None).cast(rows.schema["__row"].dataType)
    edge = lambda c, o, d: iv.select(F.col(c).alias("__at"), F.lit(o).alias("__o"), F.lit(d).alias("__d"), blank.alias("__row"))
    line = rows.unionByName(edge("start", 0, 1)).unionByName(edge("end", 2, -1))
    line = row_index(line.withColumn("__tb", F.xxhash64("__row")), [], ["__at", "__o", "__tb"], "__pos")
    open_now = running_sum(line, [], "__pos", ["__d"]).filter(F.col("__o") == 1)
    timeless = df.filter(F.col(ts).isNull()).withColumn(out, F.lit(None).cast("int"))
    return open_now.select("__row.*", (F.col("__d_cum") > 0).cast("int").alias(out)).unionByName(timeless)


def filter_anomalies(df: DataFrame, label: str = "is_anomaly") -> DataFrame:
    """B9."""
    return df.filter(F.col(label) == 1)


def filter_normal(df: DataFrame, label: str = "is_anomaly") -> DataFrame:
    """B9 complement."""
    return df.filter(F.col(label) != 1)


def select_channels(df: DataFrame, channels: list[str], keep: list[str] = ()) -> DataFrame:
    """Feature subset; duplicated names in the list are kept once."""
    seen = list(dict.fromkeys(list(keep) + list(channels)))
    return df.select(*seen)


def features_labels(df: DataFrame, spec: SeriesSpec) -> tuple[list[str], str | None]:
    """Features are the spec's value channels; the label is never a feature."""
    feats = [c for c in spec.values if c != spec.label]
    return feats, spec.label


def head_rows(df: DataFrame, n: int, pos: str = "row_idx") -> DataFrame:
    """First n rows by position (a filter on the position, not an unordered limit)."""
    return df.filter(F.col(pos) < F.lit(int(n)))


def positional_slice(df: DataFrame, lo: int, hi: int, pos: str = "row_idx") -> DataFrame:
    """Half-open slice [lo, hi) like iloc[lo:hi]."""
    return df.filter((F.col(pos) >= F.lit(int(lo))) & (F.col(pos) < F.lit(int(hi))))
