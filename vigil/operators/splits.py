"""Train / test / validation / fold assignment as columns.

Splits are columns, not separate scans, so one plan serves all parts.
Positional splits read ``row_idx``; the random split hashes the row key so
it is repeatable whatever the partitioning (unlike ``randomSplit``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.columns import hash_unit
from vigil.session import attach_scalars


def _n(df: DataFrame, keys: list[str], name: str = "__n") -> DataFrame:
    g = df.groupBy(*keys) if keys else df
    return g.agg(F.count(F.lit(1)).alias(name))


def split_fraction(df: DataFrame, keys: list[str], f: float, pos: str = "row_idx",
                   out: str = "is_train") -> DataFrame:
    """First int(f * n) rows of each series are training rows."""
    d = attach_scalars(df, _n(df, keys), list(keys))
    cut = F.floor(F.lit(float(f)) * F.col("__n").cast("double"))
    return d.withColumn(out, (F.col(pos) < cut).cast("int")).drop("__n")


def split_at(df: DataFrame, k: int, pos: str = "row_idx", reverse: bool = False,
             out: str = "is_train") -> DataFrame:
    """Fixed cut; ``reverse`` trains on the tail (rows >= k)."""
    c = F.col(pos) >= F.lit(int(k)) if reverse else F.col(pos) < F.lit(int(k))
    return df.withColumn(out, c.cast("int"))


def split_random(df: DataFrame, rid: str, test_fraction: float = 0.2, seed: int = 42,
                 out: str = "is_test") -> DataFrame:
    """Seeded hash hold-out, independent of partitioning, row order and engine."""
    return df.withColumn(out, (hash_unit(seed, "split", F.col(rid)) < F.lit(float(test_fraction))).cast("int"))


def split_tail_validation(df: DataFrame, keys: list[str], fraction: float = 0.1, pos: str = "win_start",
                          out: str = "is_validation") -> DataFrame:
    """C4: the last ``fraction`` of (training) windows, in order, are validation."""
    d = attach_scalars(df, _n(df, keys), list(keys))
    cut = F.floor(F.col("__n").cast("double") * F.lit(1.0 - float(fraction)))
    return d.withColumn(out, (F.col(pos) >= cut).cast("int")).drop("__n")


def kfold(df: DataFrame, keys: list[str], k: int = 5, pos: str = "row_idx", out: str = "fold") -> DataFrame:
    """Contiguous folds; the first n % k folds hold one extra row (KFold without shuffle)."""
    d = attach_scalars(df, _n(df, keys), list(keys))
    n, p = F.col("__n"), F.col(pos)
    q = F.floor(n / F.lit(k)).cast("bigint")
    r = n - q * F.lit(k)
    big = r * (q + 1)
    fold = F.when(p < big, F.floor(p / (q + 1))).otherwise(r + F.floor((p - big) / q))
    return d.withColumn(out, fold.cast("int")).drop("__n")
