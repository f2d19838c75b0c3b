"""Reconstruction-error detectors (re-aimed LSTM autoencoder).

A linear autoencoder is PCA: windows are centred, projected on the top
``rank`` principal components (``pyspark.ml.feature.PCA``, or the eigenvectors
of the windows' covariance, which needs no windows) and rebuilt as
mean + P P^T (x - mean).  The fitted model is the mean vector and P
(window x rank numbers); rebuilding runs in an Arrow pandas UDF as one
matrix product per batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators.positions import DEFAULT_BLOCK_ROWS, with_halo
from vigil.operators.splits import split_fraction
from vigil.operators.stats import scale_apply, scale_fit
from vigil.operators.windows import sliding_windows


def flatten_window(df: DataFrame, col: str = "window", out: str = "flat") -> DataFrame:
    """Multichannel windows (array<array>) -> one flat array, channel-major."""
    t = df.schema[col].dataType
    if isinstance(t.elementType, T.ArrayType):
        n_ch = F.size(F.element_at(col, 1))
        flat = F.flatten(F.transform(F.sequence(F.lit(0), n_ch - 1),
                                     lambda c: F.transform(col, lambda step: step[c])))
        return df.withColumn(out, flat)
    return df.withColumn(out, F.col(col))


def unflatten_window(df: DataFrame, channels: int, col: str = "recon", out: str = "recon_window") -> DataFrame:
    """Inverse of ``flatten_window``: channel-major numbers -> one array of channel values per time step."""
    steps = (F.size(col) / channels).cast("int")
    back = F.transform(F.sequence(F.lit(0), steps - 1), lambda t: F.transform(
        F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.element_at(col, (c * steps + t + 1).cast("int"))))
    return df.withColumn(out, back)


def reconstruct_fit(train: DataFrame, rank: int, col: str = "flat") -> dict:
    """mean and principal components of the training windows (the model)."""
    dim = len(train.select(col).head()[0])
    means = train.agg(*[F.avg(F.element_at(col, i + 1)).alias(f"m{i}") for i in range(dim)]).collect()[0]
    mean = np.array([means[f"m{i}"] for i in range(dim)], dtype=float)
    mean_lit = F.array(*[F.lit(float(m)) for m in mean])
    centred = train.select(array_to_vector(F.transform(col, lambda x, i: x - F.element_at(mean_lit, i + 1)))
                           .alias("__x"))
    model = PCA(k=rank, inputCol="__x", outputCol="__z").fit(centred)
    comps = model.pc.toArray()  # dim x rank
    return {"mean": mean, "pc": comps, "rank": rank}


def _block_moments(x: np.ndarray, use: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sum and sum of products of the windows that begin at the rows marked ``use`` (step-major; unknown numbers are 0).

    Products of the first step with the others are lagged cross products.  A window moved by one step has the same
    products except at the ends of runs of used rows, so all further steps follow from those few rows.
    """
    n, c = x.shape
    total, first = np.zeros((window, c)), np.zeros((window, c, c))
    at = np.flatnonzero(use)
    head = x[at]
    for s in range(window):
        moved = x[at + s]
        total[s], first[s] = moved.sum(axis=0), head.T @ moved
    change = np.diff(np.r_[0, use.astype(int), 0])               # +1 where a run begins, -1 behind its end
    ends = np.flatnonzero(change)
    prod = np.zeros((window, c, window, c))
    prod[0] = first.transpose(1, 0, 2)
    if window > 1:
        near = x[np.minimum(ends[:, None] + np.arange(window - 1), n - 1)].reshape(len(ends), (window - 1) * c)
        gap = ((near * -change[ends][:, None]).T @ near).reshape(window - 1, c, window - 1, c)
        for s in range(1, window):
            prod[s, :, s:] = prod[s - 1, :, s - 1:-1] + gap[s - 1, :, s - 1:]
    full = prod.reshape(window * c, window * c)
    full = np.triu(full)
    for s in range(window):                                       # the block on the diagonal is whole already
        full[s * c:(s + 1) * c, s * c:(s + 1) * c] = prod[s, :, s]
    upper = np.triu(full, 1)
    return total.ravel(), np.diag(np.diag(full)) + upper + upper.T, len(at)


def window_moments(df: DataFrame, keys: list[str], values: list[str], window: int, pos: str = "row_idx", train: str | None = None,
                   block: int = DEFAULT_BLOCK_ROWS) -> tuple[int, np.ndarray, np.ndarray]:
    """(number, mean, covariance) of all full windows (followed by a known row, as E1 with one target), channel-major.

    No window is built: every block of rows adds its lagged cross products, a task sends one matrix, and its rows are
    added up in groups.  ``train`` marks the rows a window must end on.  The covariance (window x channels)^2 reaches the driver.
    """
    keys, c = list(keys), len(values)
    d = df.select(*keys, pos, (F.col(train) == 1 if train else F.lit(True)).alias("__train"), *[F.col(v).cast("double").alias(v) for v in values])
    h = with_halo(d, pos, block, 0, window)
    h = h.repartition(*keys, "_blk").sortWithinPartitions(*keys, "_blk", pos)
    size = window * c

    def run(batches):
        number, total, prod = 0, np.zeros(size), np.zeros((size, size))
        held: list = []

        def groups(pdf):
            new = np.zeros(len(pdf), bool)
            for k in [*keys, "_blk"]:
                same = pdf[k].eq(pdf[k].shift()) | (pdf[k].isna() & pdf[k].shift().isna())
                new |= ~same.to_numpy(dtype=bool)
            new[:1] = True
            return np.flatnonzero(new)

        def add(pdf):
            nonlocal number, total, prod
            starts = groups(pdf)
            for a, b in zip(starts, np.r_[starts[1:], len(pdf)]):
                x = pdf[values].iloc[a:b].to_numpy(dtype=float)
                known = ~np.isnan(x).any(axis=1)
                run_of = np.r_[0, np.cumsum(known)]
                use = np.zeros(len(x), bool)
                m = len(x) - window                                # windows with a row behind them
                if m > 0:
                    ends = pdf["__train"].iloc[a:b].to_numpy(dtype=bool)[window - 1:window - 1 + m]
                    use[:m] = (run_of[window + 1:] - run_of[:m] == window + 1) & ends & pdf["_home"].iloc[a:b].to_numpy(dtype=bool)[:m]
                if use.any():
                    t, p, k = _block_moments(np.nan_to_num(x), use, window)
                    number, total, prod = number + k, total + t, prod + p
        for pdf in batches:
            held.append(pdf)
            whole = pd.concat(held, ignore_index=True) if len(held) > 1 else pdf
            last = int(groups(whole)[-1])                          # the last block may go on
            if last:
                add(whole.iloc[:last])
            held = [whole.iloc[last:].reset_index(drop=True)]
        if held:
            add(held[0])
        if number:
            yield pd.DataFrame({"i": range(-2, size), "row": [np.array([float(number)]), total, *prod]})
    parts = h.mapInPandas(run, "i int, row array<double>")
    summed = parts.groupBy("i").applyInPandas(lambda g: pd.DataFrame({"i": [g["i"].iloc[0]], "row": [np.sum(np.stack(g["row"].to_numpy()), axis=0)]}),
                                              "i int, row array<double>")
    rows = {r["i"]: np.array(r["row"]) for r in summed.collect()}   # (window x channels) rows
    if not rows:
        return 0, np.zeros(size), np.zeros((size, size))
    n = int(rows[-2][0])
    mean = rows[-1] / n
    cov = (np.array([rows[i] for i in range(size)]) - n * np.outer(mean, mean)) / max(n - 1, 1)
    major = np.arange(size).reshape(window, c).T.ravel()            # step-major -> channel-major
    return n, mean[major], cov[np.ix_(major, major)]


def reconstruct_fit_moments(moments: tuple[int, np.ndarray, np.ndarray], rank: int) -> dict:
    """F12 from ``window_moments``: the leading eigenvectors of the covariance."""
    _, mean, cov = moments
    _, vectors = np.linalg.eigh(cov)
    return {"mean": mean, "pc": vectors[:, ::-1][:, :rank], "rank": rank}


def reconstruct_predict(df: DataFrame, model: dict, col: str = "flat", out: str = "recon") -> DataFrame:
    """rebuilt window = mean + P P^T (x - mean), one matrix product per Arrow batch."""
    mean, pc = model["mean"], model["pc"]
    proj = pc @ pc.T

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def rebuild(x: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype=object)
        m = np.stack(x.to_numpy()).astype(float) - mean
        r = m @ proj + mean
        return pd.Series(list(r))

    return df.withColumn(out, rebuild(F.col(col)))


def window_mae(df: DataFrame, a: str = "flat", b: str = "recon", out: str = "mae") -> DataFrame:
    """mean absolute error over time (and channels) per window."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, v: acc + v)
    return df.withColumn(out, s / F.size(a))


_NESTED = T.ArrayType(T.ArrayType(T.DoubleType()))


def _by_shape(*cols: pa.Array):
    """(row places, matrices rows x steps x channels) of array<array> columns; rows of one shape come together, null rows not at all."""
    known = np.flatnonzero(np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in cols]))
    cols = [c.take(pa.array(known)) for c in cols] if len(known) < len(cols[0]) else cols
    if not len(known):
        return
    steps, inner = [pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in cols], [pc.list_value_length(c.flatten()).to_numpy(zero_copy_only=False) for c in cols]
    if all((s == s[0]).all() and s[0] == steps[0][0] for s in steps) and all(len(i) and (i == inner[0][0]).all() for i in inner):
        yield known, [c.flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(known), int(steps[0][0]), -1) for c in cols]
        return
    for n, at in enumerate(known):                                  # windows of different shapes
        yield np.array([at]), [np.array(c[n].as_py(), dtype=float)[None] for c in cols]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _mae_by_channel(a: pa.Array, b: pa.Array) -> pa.Array:
    out = [None] * len(a)
    for at, (x, y) in _by_shape(a, b):
        mae = np.abs(x - y).sum(axis=1) / x.shape[1]
        if len(at) == len(a):
            return pa.ListArray.from_arrays(pa.array(np.arange(0, mae.size + 1, mae.shape[1], dtype=np.int32)), pa.array(mae.ravel()))
        for i, m in zip(at, mae):
            out[i] = m.tolist()
    return pa.array(out, pa.list_(pa.float64()))


@F.arrow_udf(_NESTED)
def _mean_steps(a: pa.Array) -> pa.Array:
    out = [None] * len(a)
    for at, (x,) in _by_shape(a):
        n, steps, channels = x.shape
        mean = x.sum(axis=1) / steps
        if len(at) == len(a):
            flat = pa.array(np.repeat(mean, steps, axis=0).ravel())
            inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, channels, dtype=np.int32)), flat)
            return pa.ListArray.from_arrays(pa.array(np.arange(0, n * steps + 1, steps, dtype=np.int32)), inner)
        for i, m in zip(at, mean):
            out[i] = [m.tolist()] * steps
    return pa.array(out, pa.list_(pa.list_(pa.float64())))


def window_mean(df: DataFrame, col: str = "window", out: str = "recon_window") -> DataFrame:
    """Windows (array<array>) rebuilt from nothing but their channels' means."""
    return df.withColumn(out, _mean_steps(F.col(col).cast(_NESTED)))


def window_mae_channel(df: DataFrame, a: str = "window", b: str = "recon_window", out: str = "mae_channel"):
    """mean absolute error over time, one value per channel (array<array> windows); one matrix per Arrow batch."""
    return df.withColumn(out, _mae_by_channel(F.col(a).cast(_NESTED), F.col(b).cast(_NESTED)))


def reconstruct_score(df: DataFrame, keys: list[str], values: list[str], window: int, rank: int, pos: str = "row_idx",
                      train_fraction: float = 0.4) -> tuple[DataFrame, dict]:
    """F12-F15 end to end: (keys, pos, score, channel_mae) per row behind its window, and the model.

    Channels are scaled with the training rows' statistics (D3); windows inside the training rows fit the
    model through their covariance (``window_moments``, no window is built for it); every window is rebuilt, its mean absolute error (all channels, and per channel) belongs to the
    row behind it (E6).  Windows with a missing value in any channel neither train nor score: the row behind
    them is not in the result.
    """
    keys, values = list(keys), list(values)
    marked = split_fraction(df.select(*keys, pos, *values), keys, train_fraction, pos)
    scaled = scale_apply(marked, scale_fit(marked.filter("is_train = 1"), keys, values), keys, values)
    w = flatten_window(sliding_windows(scaled, keys, values, window, 1, pos))
    # a training window ends on a training row
    model = reconstruct_fit_moments(window_moments(scaled, keys, values, window, pos, "is_train"), rank)
    r = window_mae(reconstruct_predict(w, model), out="score")
    if len(values) > 1:
        r = window_mae_channel(unflatten_window(r, len(values)), "window", "recon_window", "channel_mae")
    else:
        r = r.withColumn("channel_mae", F.array("score"))
    return r.select(*keys, (F.col("win_start") + F.lit(window)).alias(pos), "score", "channel_mae"), model


def save_reconstruction(spark, model: dict, path: str) -> str:
    """The mean vector and components as one Parquet row per position."""
    rows = [(i, float(m), [float(x) for x in c]) for i, (m, c) in enumerate(zip(model["mean"], model["pc"]))]
    spark.createDataFrame(rows, "position int, mean double, components array<double>").write.mode("overwrite").parquet(path)
    return path


def load_reconstruction(spark, path: str) -> dict:
    rows = spark.read.parquet(path).orderBy("position").collect()       # window x channels numbers
    pc = np.array([r["components"] for r in rows])
    return {"mean": np.array([r["mean"] for r in rows]), "pc": pc, "rank": pc.shape[1]}
