"""Statistics, scaling and score post-processing.

Statistics are one aggregate per series; with no series keys they attach as
scalar subqueries, otherwise through a size-checked join.  Exact quantiles
come from counting passes over value ranges: no sort, no data-sized exchange,
and a series holding a third of the table never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.columns import MIN_POSITIVE_DOUBLE
from vigil.session import attach_scalars, join_measured, materialize


def _attach(df, stats, keys):
    return attach_scalars(df, stats, list(keys))


def moments(df: DataFrame, keys: list[str], cols: list[str], sample: bool = False) -> DataFrame:
    """Per-series mean and standard deviation of each column (pop by default)."""
    sd = F.stddev_samp if sample else F.stddev_pop
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), sd(c).alias(f"{c}__std")]
    g = df.groupBy(*keys) if keys else df
    return g.agg(*aggs)


def zscore_filter(df: DataFrame, keys: list[str], col: str, z: float = 3.0) -> DataFrame:
    """Keep rows with |x - mean| / pop std < z (zero std keeps the row)."""
    d = _attach(df, moments(df, keys, [col]), keys)
    s = F.col(f"{col}__std")
    zc = F.when(s > 0, (F.col(col) - F.col(f"{col}__mean")) / s).otherwise(F.lit(0.0))
    return d.filter(F.abs(zc) < F.lit(float(z))).drop(f"{col}__mean", f"{col}__std")


def scale_fit(df: DataFrame, keys: list[str], cols: list[str], sample: bool = False) -> DataFrame:
    """D2/D3 fit: the statistics DataFrame *is* the model (zero std -> 1)."""
    m = moments(df, keys, cols, sample)
    return m.withColumns({f"{c}__std": F.when(F.col(f"{c}__std") > 0, F.col(f"{c}__std")).otherwise(F.lit(1.0))
                          for c in cols})


def scale_apply(df: DataFrame, model: DataFrame, keys: list[str], cols: list[str],
                inverse: bool = False) -> DataFrame:
    """D2/D3 transform ((x-mean)/std) or D4 inverse (x*std+mean)."""
    d = _attach(df, model, keys)
    out = {}
    for c in cols:
        m, s = F.col(f"{c}__mean"), F.col(f"{c}__std")
        out[c] = F.col(c) * s + m if inverse else (F.col(c) - m) / s
    d = d.withColumns(out)
    return d.drop(*[f"{c}__mean" for c in cols], *[f"{c}__std" for c in cols])


def standard_scale(df, keys, cols):
    """Fit and transform on the same data, population std."""
    return scale_apply(df, scale_fit(df, keys, cols), keys, cols)


def zscore_sample_drop_constant(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """(x-mean)/sample std per channel; channels with zero/undefined std are dropped.

    Collects 2 numbers per channel (the model), never data.
    """
    row = moments(df, [], cols, sample=True).collect()[0]
    keep = [c for c in cols if row[f"{c}__std"] is not None and row[f"{c}__std"] > 0]
    other = [c for c in df.columns if c not in cols]
    exprs = [((F.col(c) - F.lit(row[f"{c}__mean"])) / F.lit(row[f"{c}__std"])).alias(c) for c in keep]
    return df.select(*other, *exprs), keep


def range_stats(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Min and max of a channel per series."""
    g = df.groupBy(*keys) if keys else df
    return g.agg(F.min(col).alias("min_value"), F.max(col).alias("max_value"))


def contamination(df: DataFrame, keys: list[str], label: str = "is_anomaly", cap: float | None = None) -> DataFrame:
    """Share of labelled anomalies, floored at the smallest positive double."""
    g = df.groupBy(*keys) if keys else df
    c = F.greatest(F.avg(F.col(label).cast("double")), F.lit(MIN_POSITIVE_DOUBLE))
    if cap is not None:
        c = F.least(c, F.lit(float(cap)))
    return g.agg(c.alias("contamination"))


#: Buckets of one counting pass of the selection, and rows that may be ranked directly once a range holds no more.
SELECT_BUCKETS = 1024
SELECT_ROWS = 10_000


def order_statistics(df: DataFrame, ranks: DataFrame, keys: list[str], col: str) -> DataFrame:
    """(keys, rank, value): the value at each 0-based rank (column ``rank`` of ``ranks``) among a series' known values.

    Selection by counting: each pass counts the rows of every range of interest in ``SELECT_BUCKETS`` equal
    buckets, combined on the map side, and goes on in the buckets that hold a rank.  A range of equal values
    is its answer; one of at most ``SELECT_ROWS`` rows is ranked directly.  Nothing of the data's size is sorted,
    exchanged or written; ``df`` is read once per pass (two or three, and one for the ranges' ends).
    """
    keys = list(keys)
    x = F.col(col).cast("double")
    base = df.select(*keys, x.alias("__x")).filter(F.col("__x").isNotNull() & ~F.isnan("__x"))
    ends = (base.groupBy(*keys) if keys else base).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.count(F.lit(1)).alias("__n"))
    state = attach_scalars(ranks, ends.select(*keys, "__lo", "__hi", "__n"), keys) if keys else \
        ranks.withColumns({c: ends.select(c).scalar() for c in ("__lo", "__hi", "__n")})
    state = state.select(*keys, "rank", "__lo", "__hi", F.lit(0).cast("long").alias("__before"), "__n")

    def inside(open_):
        """Rows beside each open range of their series that holds them."""
        ranges = (open_.groupBy(*keys) if keys else open_).agg(F.collect_set(F.struct("__lo", "__hi")).alias("__ranges"))   # two per quantile at most
        near = attach_scalars(base, ranges, keys)
        near = near.withColumn("__r", F.explode(F.filter("__ranges", lambda r: (F.col("__x") >= r["__lo"]) & (F.col("__x") <= r["__hi"]))))
        return near.select(*keys, "__x", "__r.__lo", "__r.__hi")
    by = [*keys, "__lo", "__hi"]
    while True:
        state = materialize(state, "select-ranges")
        most = state.filter("__lo < __hi").agg(F.max("__n")).first()[0]
        if most is None or most <= SELECT_ROWS:
            break
        width = F.col("__hi") / 2 - F.col("__lo") / 2                      # halves: the whole width may overflow
        bucket = F.least(F.floor((F.col("__x") / 2 - F.col("__lo") / 2) / width * SELECT_BUCKETS), F.lit(SELECT_BUCKETS - 1)).cast("int")
        counted = inside(state.filter("__lo < __hi")).groupBy(*by, bucket.alias("__b")).agg(
            F.count(F.lit(1)).alias("__c"), F.min("__x").alias("__min"), F.max("__x").alias("__max"))
        w = Window.partitionBy(*by).orderBy("__b")                         # SELECT_BUCKETS rows at most
        counted = counted.withColumn("__c0", F.sum("__c").over(w) - F.col("__c"))
        hit = join_measured(state, counted, by, "left")
        r = F.col("rank") - F.col("__before")
        hit = hit.filter((F.col("__lo") == F.col("__hi")) | ((r >= F.col("__c0")) & (r < F.col("__c0") + F.col("__c"))))
        state = hit.select(*keys, "rank", F.coalesce("__min", "__lo").alias("__lo"), F.coalesce("__max", "__hi").alias("__hi"),
                           (F.col("__before") + F.coalesce("__c0", F.lit(0))).alias("__before"), F.coalesce("__c", "__n").alias("__n"))
    done = state.filter("__lo = __hi").select(*keys, "rank", F.col("__lo").alias("value"))
    near = inside(state.filter("__lo < __hi")).withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy("__x")) - 1)
    found = join_measured(state.filter("__lo < __hi"), near, by).filter(F.col("rank") - F.col("__before") == F.col("__at"))
    return done.unionByName(found.select(*keys, "rank", F.col("__x").alias("value")))


def quantiles(df: DataFrame, keys: list[str], col: str, qs: list[float], rid: str | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles (q in [0,1]) per series: keys, q, value.

    The values at floor and ceiling of q * (n - 1) come from ``order_statistics``; missing values do not count.
    ``df`` is read several times: write it first if it is expensive.
    """
    keys = list(keys)
    known = df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    counts = (known.groupBy(*keys) if keys else known).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 0")
    h = F.col("q") * (F.col("__n") - 1).cast("double")
    qdf = counts.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    qdf = qdf.select(*keys, "q", F.floor(h).cast("bigint").alias("__f"), F.ceil(h).cast("bigint").alias("__g"), (h - F.floor(h)).alias("__frac"))
    qdf = materialize(qdf, "quantile-ranks")
    ranks = qdf.select(*keys, F.explode(F.array_distinct(F.array("__f", "__g"))).alias("rank")).distinct()
    picked = materialize(order_statistics(df, ranks, keys, col), "quantile-values")
    lo = picked.withColumnsRenamed({"rank": "__f", "value": "__vlo"})
    hi = picked.withColumnsRenamed({"rank": "__g", "value": "__vhi"})
    out = join_measured(join_measured(qdf, lo, keys + ["__f"]), hi, keys + ["__g"])
    val = F.col("__vlo") + F.col("__frac") * (F.col("__vhi") - F.col("__vlo"))
    return out.select(*keys, "q", F.when(F.col("__frac") > 0, val).otherwise(F.col("__vlo")).alias("value"))


def percentile_of(df, keys, col, q: float) -> DataFrame:
    """Single percentile (q in 0..100) per series as column ``threshold``."""
    return quantiles(df, keys, col, [q / 100.0]).select(*keys, F.col("value").alias("threshold"))


def max_normalise(df: DataFrame, keys: list[str], col: str, out: str | None = None) -> DataFrame:
    """Score / max(score) per series."""
    g = df.groupBy(*keys) if keys else df
    m = g.agg(F.max(col).alias("__max"))
    d = _attach(df, m, keys)
    # a zero maximum gives null (ANSI division would raise)
    return d.withColumn(out or col, F.try_divide(F.col(col), F.col("__max"))).drop("__max")


def standardised_error(df: DataFrame, keys: list[str], col: str, out: str | None = None) -> DataFrame:
    """|x - mean| / sample std per series."""
    d = _attach(df, moments(df, keys, [col], sample=True), keys)
    z = F.try_divide(F.abs(F.col(col) - F.col(f"{col}__mean")), F.col(f"{col}__std"))   # constant -> null
    return d.withColumn(out or col, z).drop(f"{col}__mean", f"{col}__std")


def row_and_label_counts(df: DataFrame, keys: list[str], label: str = "is_anomaly",
                         flag: str | None = None) -> DataFrame:
    """Rows, labelled anomalies and (optionally) flagged rows per series."""
    g = df.groupBy(*keys) if keys else df
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(label) == 1).alias("n_anomalies")]
    if flag:
        aggs.append(F.count_if(F.col(flag) == 1).alias("n_flagged"))
    return g.agg(*aggs)


def outlier_share(df: DataFrame, keys: list[str], label: str = "is_anomaly") -> DataFrame:
    """Anomalies / rows (LoOP decision level)."""
    g = df.groupBy(*keys) if keys else df
    return g.agg(F.avg(F.col(label).cast("double")).alias("outlier_share"))
