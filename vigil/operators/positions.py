"""Row positions, blocks with halos and running sums — skew-safe.

Every positional behaviour of the reference (``iloc`` slices, windows,
"the k-th row after this one") needs an explicit 0-based position per
series.  A ``Window`` without ``partitionBy`` runs in one task and a series
holding a third of the table would do the same, so positions are computed
from a *range* partitioning of (series, order) instead:

1. ``repartitionByRange`` + ``sortWithinPartitions`` on the full order key;
   ``monotonically_increasing_id`` then carries (partition, local counter)
   with no further shuffle.
2. A tiny table of (series, partition) spans gives each span its offset
   (at most partitions + series rows; broadcast only after it is counted).

The positioned rows are written once to the shared checkpoint folder, so
the span table and the rows agree even when the order key has ties, and a
lost executor cannot change positions already handed out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import join_measured, materialize

_LOCAL_BITS = 33
_LOCAL_MASK = (1 << _LOCAL_BITS) - 1

# Rows per block for block + halo window plans (one task handles a block).
DEFAULT_BLOCK_ROWS = 1_000_000


def _order_cols(order) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c) for c in order]


def row_index(df: DataFrame, keys: list[str], order: list, out: str = "row_idx",
              partitions: int | None = None) -> DataFrame:
    """0-based position of each row within its series (``keys``) by ``order``.

    ``order`` items are column names or sort Columns (e.g. ``F.col('s').desc()``).
    """
    keys = list(keys)
    sort_key = [F.col(k) for k in keys] + _order_cols(order)
    # without an explicit count AQE may merge adjacent (still contiguous) ranges
    ranger = df.repartitionByRange(partitions, *sort_key) if partitions else df.repartitionByRange(*sort_key)
    ranged = (ranger
                .sortWithinPartitions(*sort_key)
                .withColumn("__mid", F.monotonically_increasing_id())
                .withColumn("__pid", F.shiftright("__mid", _LOCAL_BITS))
                .withColumn("__loc", F.col("__mid").bitwiseAND(F.lit(_LOCAL_MASK)))
                .drop("__mid"))
    # the span table and the rows must see the same partitioning: fix it once
    ranged = materialize(ranged, "row-index")
    spans = ranged.groupBy(*keys, "__pid").agg(F.count(F.lit(1)).alias("__n"),
                                               F.min("__loc").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*keys, "__pid",
                         (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__adj"))
    # written: its size is known, so that the rows need not be shuffled for the join
    out_df = join_measured(ranged, materialize(spans, "row-spans"), keys + ["__pid"])
    return (out_df.withColumn(out, (F.col("__loc") + F.col("__adj")).cast("bigint"))
                  .drop("__pid", "__loc", "__adj"))


def with_halo(df: DataFrame, pos: str, block: int, before: int, after: int,
              blk: str = "_blk", home: str = "_home") -> DataFrame:
    """Send each row to its home block and to every block whose rows need it.

    Row ``r`` of a block looks at rows ``r-before .. r+after``; so row ``p``
    is needed by blocks ``floor((p-after)/block) .. floor((p+before)/block)``.
    Groups (series, blk) hold at most ``block + before + after`` rows.
    """
    p = F.col(pos)
    lo = F.greatest(F.lit(0), F.floor((p - F.lit(after)) / F.lit(block))).cast("bigint")
    hi = F.floor((p + F.lit(before)) / F.lit(block)).cast("bigint")
    return (df.withColumn(blk, F.explode(F.sequence(lo, hi)))
              .withColumn(home, F.col(blk) == F.floor(p / F.lit(block)).cast("bigint")))


def running_sum(df: DataFrame, keys: list[str], pos: str, cols: list[str],
                block: int = DEFAULT_BLOCK_ROWS, suffix: str = "_cum",
                reverse: bool = False) -> DataFrame:
    """Inclusive running sums of ``cols`` along ``pos`` within each series.

    Two levels keep every task bounded: sums inside blocks of ``block``
    positions, then block offsets from a per-series table of n/block rows.
    ``reverse`` sums from the end (row and everything after it).
    """
    keys = list(keys)
    b = F.floor(F.col(pos) / F.lit(block)).cast("bigint")
    d = df.withColumn("__b", b)
    ordering = F.col(pos).desc() if reverse else F.col(pos).asc()
    w_in = Window.partitionBy(*keys, "__b").orderBy(ordering).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"__in_{c}": F.sum(c).over(w_in) for c in cols})
    tot = d.groupBy(*keys, "__b").agg(*[F.sum(c).alias(f"__t_{c}") for c in cols])
    border = F.col("__b").desc() if reverse else F.col("__b").asc()
    w_b = Window.partitionBy(*keys).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*keys, "__b", *[F.coalesce(F.sum(f"__t_{c}").over(w_b), F.lit(0)).alias(f"__o_{c}")
                                     for c in cols])
    d = join_measured(d, tot, keys + ["__b"])
    d = d.withColumns({f"{c}{suffix}": F.col(f"__in_{c}") + F.col(f"__o_{c}") for c in cols})
    return d.drop("__b", *[f"__in_{c}" for c in cols], *[f"__o_{c}" for c in cols])
