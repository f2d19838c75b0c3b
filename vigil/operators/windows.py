"""Sliding windows over positioned series, and mapping window scores back.

Every window function runs over (series, block) groups produced by
``with_halo``: a block of positions plus the few rows before/after it that
its windows reach.  A block holds ``block`` rows however long the series,
so one huge series is spread over many tasks and nothing runs unpartitioned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.positions import DEFAULT_BLOCK_ROWS, with_halo
from vigil.session import attach_scalars


def _vals(values: list[str]):
    """One channel -> double; several -> array<double> per time step, null unless every channel is known."""
    if len(values) == 1:
        return F.col(values[0]).cast("double")
    known = reduce(lambda a, b: a & b, [F.col(v).isNotNull() for v in values])
    return F.when(known, F.array(*[F.col(v).cast("double") for v in values]))


def sliding_windows(df: DataFrame, keys: list[str], values: list[str], window: int, horizon: int = 1,
                    pos: str = "row_idx", block: int = DEFAULT_BLOCK_ROWS, short: bool = False) -> DataFrame:
    """Window i = rows i..i+w-1, target = rows i+w..i+w+p-1; n-w-p+1 windows.

    ``short`` drops the last window (the reference variant with n-w-p).
    Output: keys, win_start, window (array), target (array; empty if p=0).
    A window touching a null value of any channel is not full and is left out
    (the reference drops null rows before windowing, B5).
    """
    keys = list(keys)
    span = window + horizon
    d = df.select(*keys, pos, _vals(list(values)).alias("__v"))
    h = with_halo(d, pos, block, 0, span - 1)
    w = (Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(0, span - 1))
    h = h.withColumn("__arr", F.collect_list("__v").over(w)).filter(F.col("_home"))
    h = h.filter(F.size("__arr") == span)
    out = h.select(*keys, F.col(pos).alias("win_start"),
                   F.slice("__arr", 1, window).alias("window"),
                   (F.slice("__arr", window + 1, horizon) if horizon > 0
                    else F.array().cast("array<double>")).alias("target"))
    if short:
        g = out.groupBy(*keys) if keys else out
        last = g.agg(F.max("win_start").alias("__last"))
        out = attach_scalars(out, last, keys).filter(F.col("win_start") < F.col("__last")).drop("__last")
    return out


def sequences_with_next(df, keys, value: str, window: int = 24, pos: str = "row_idx",
                        block: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Window of w values and the next value; n-w windows."""
    return sliding_windows(df, keys, [value], window, 1, pos, block)


def sequences(df, keys, values: list[str], window: int = 30, pos: str = "row_idx",
              block: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Multichannel windows only; the last window is dropped (n-w windows)."""
    return sliding_windows(df, keys, values, window, 1, pos, block).drop("target")


def lag_features(df: DataFrame, keys: list[str], values: list[str], window: int, pos: str = "row_idx",
                 block: int = DEFAULT_BLOCK_ROWS, out: str = "features") -> DataFrame:
    """For row i >= w, the previous w values flattened channel-major.

    Output keeps the row (so the row's own values are the forecast target).
    Rows with a missing value among their lags are left out.
    """
    keys = list(keys)
    h = with_halo(df, pos, block, window, 0)
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    feats = []
    for v in values:
        feats += [F.lag(F.col(v).cast("double"), lag).over(w) for lag in range(window, 0, -1)]
    h = h.withColumn(out, F.array(*feats)).filter(F.col("_home")).drop("_blk", "_home")
    return h.filter(F.forall(out, lambda x: x.isNotNull()))


def reverse_windowing(rows: DataFrame, window_scores: DataFrame, keys: list[str], size: int,
                      pos: str = "row_idx", score: str = "score", block: int = DEFAULT_BLOCK_ROWS,
                      out: str = "score") -> DataFrame:
    """E5: per-row mean of the scores of all windows of ``size`` rows covering it.

    ``window_scores`` has (keys, win_start, score); ``rows`` has (keys, pos).
    Row r is covered by windows starting in [r-size+1, r]; edges average fewer.
    """
    keys = list(keys)
    ws = window_scores.select(*keys, F.col("win_start").alias(pos), F.col(score).alias("__ws"))
    r = rows.select(*keys, pos).join(ws, keys + [pos], "left")
    h = with_halo(r, pos, block, size - 1, 0)
    w = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(-(size - 1), 0)
    h = h.withColumn(out, F.avg("__ws").over(w)).filter(F.col("_home"))
    return h.select(*keys, pos, out)


def align_window_score(rows: DataFrame, window_scores: DataFrame, keys: list[str], window: int,
                       pos: str = "row_idx", score: str = "score") -> DataFrame:
    """The score of window i belongs to row i + w (the first w rows get none)."""
    ws = window_scores.select(*keys, (F.col("win_start") + F.lit(int(window))).alias(pos), score)
    return rows.join(ws, list(keys) + [pos], "inner")
