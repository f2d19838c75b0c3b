"""Confusion counts, F1, AUROC, ROC curves, threshold sweeps, boards.

Rank statistics are computed from distributed positions (no global window):
AUROC is the Mann-Whitney statistic with mid-ranks for ties, the ROC curve
uses two-level running sums, and threshold sweeps map every score to the
last grid level it passes (O(n + T) instead of one pass per level).

One rule for rows without a score or flag (short series, null values), in every
metric here: they count as *not flagged* -- a missed positive (fn) or a true
negative (tn) -- and rank below every scored row.  No row leaves a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.columns import f1_from_counts, safe_div
from vigil.operators.positions import row_index, running_sum
from vigil.session import attach_scalars


def _g(df, keys):
    return df.groupBy(*keys) if keys else df


def _is_one(col: str):
    return F.coalesce(F.col(col) == 1, F.lit(False))


def tiebreak(df: DataFrame, rid: str | None = "rid"):
    """A deterministic secondary sort key so equal scores spread over range partitions.

    A score value shared by a third of the rows would otherwise land in one
    range partition (one task).  Uses the row id when present, else a hash of
    the whole row (identical rows are interchangeable for every rank statistic).
    """
    if rid and rid in df.columns:
        return F.col(rid)
    return F.xxhash64(*[F.col(c) for c in df.columns])


def confusion(df: DataFrame, keys: list[str], label: str = "is_anomaly", flag: str = "flag") -> DataFrame:
    """G1: tp, fp, fn, tn per group (a null flag is not flagged, a null label not anomalous)."""
    l, f = _is_one(label), _is_one(flag)
    return _g(df, keys).agg(F.count_if(l & f).alias("tp"), F.count_if(~l & f).alias("fp"),
                            F.count_if(l & ~f).alias("fn"), F.count_if(~l & ~f).alias("tn"))


def prf(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1 from G1 (zero denominators give 0)."""
    return conf.withColumns({
        "precision": safe_div("tp", F.col("tp") + F.col("fp")),
        "recall": safe_div("tp", F.col("tp") + F.col("fn")),
        "f1": f1_from_counts("tp", "fp", "fn"),
    })


def auroc_of_flags(conf: DataFrame) -> DataFrame:
    """AUROC of hard 0/1 flags = (tpr + tnr) / 2; null for a single class."""
    p = F.col("tp") + F.col("fn")
    n = F.col("fp") + F.col("tn")
    v = (F.col("tp") / p + F.col("tn") / n) / F.lit(2.0)
    return conf.withColumn("auroc", F.when((p > 0) & (n > 0), v))


def auroc(df: DataFrame, keys: list[str], score: str, label: str = "is_anomaly") -> DataFrame:
    """Area under the ROC curve as a rank statistic (ties count 1/2).

    AUC = (sum of positive mid-ranks - P(P+1)/2) / (P N); null for one class.
    Rows without a score share the lowest rank.
    """
    keys = list(keys)
    y = F.col(label).cast("long")
    per = df.groupBy(*keys, score).agg(F.sum(y).alias("__npos"), F.count(F.lit(1)).alias("__cnt"))       # combined on the map side
    ranked = running_sum(row_index(per, keys, [score], "__pos"), keys, "__pos", ["__cnt"])
    # rows of one score hold the ranks cum - count + 1 to cum
    per_score = ranked.withColumn("__mid", F.col("__cnt_cum") - (F.col("__cnt") - F.lit(1)).cast("double") / F.lit(2.0))
    tot = _g(per_score, keys).agg(F.sum(F.col("__npos") * F.col("__mid")).alias("__s"),
                                  F.sum("__npos").alias("__p"),
                                  (F.sum("__cnt") - F.sum("__npos")).alias("__n"))
    p, n = F.col("__p").cast("double"), F.col("__n").cast("double")
    auc = (F.col("__s") - p * (p + F.lit(1.0)) / F.lit(2.0)) / (p * n)
    return tot.select(*keys, F.when((F.col("__p") > 0) & (F.col("__n") > 0), auc).alias("auroc"))


def roc_curve(df: DataFrame, keys: list[str], score: str, label: str = "is_anomaly") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, highest first.

    Includes the start point (threshold null, 0, 0); collinear points are kept.
    Column ``point`` is the 0-based index along the curve (start point = 0).
    """
    keys = list(keys)
    y = F.col(label).cast("long")
    per = df.groupBy(*keys, score).agg(F.sum(y).alias("__pos"), F.sum(F.lit(1) - y).alias("__neg"))
    ranked = row_index(per, keys, [F.col(score).desc()], "__i")
    cum = running_sum(ranked, keys, "__i", ["__pos", "__neg"])
    tot = _g(ranked, keys).agg(F.sum("__pos").alias("__P"), F.sum("__neg").alias("__N"))
    cum = attach_scalars(cum, tot, keys)
    pts = cum.select(*keys, F.col(score).alias("threshold"),
                     F.try_divide(F.col("__neg_cum"), F.col("__N")).alias("fpr"),   # one class -> null
                     F.try_divide(F.col("__pos_cum"), F.col("__P")).alias("tpr"),
                     (F.col("__i") + 1).alias("point"))
    start = tot.select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
                       F.lit(0.0).alias("tpr"), F.lit(0).cast("bigint").alias("point"))
    return pts.unionByName(start)


def auc_trapezoid(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Trapezoid area under a G5 curve (pairs consecutive points by an equi-join)."""
    keys = list(keys)
    prev = curve.select(*keys, (F.col("point") + 1).alias("point"),
                        F.col("fpr").alias("__f0"), F.col("tpr").alias("__t0"))
    j = curve.join(prev, keys + ["point"])
    area = (F.col("fpr") - F.col("__f0")) * (F.col("tpr") + F.col("__t0")) / F.lit(2.0)
    return _g(j, keys).agg(F.sum(area).alias("auc"))


def _grid_t(j, start, step, count, last):
    t = start + j.cast("double") * step
    return t if last is None else F.when(j == count - 1, F.lit(float(last))).otherwise(t)


def _grid_index(d: DataFrame, score: str, start, step, count, inclusive, last=None, out: str = "__j") -> DataFrame:
    """``d`` plus the last grid index j passed by each score (-1 if none); t_j = start + j*step.

    A floor estimate is corrected one step either way by comparing against
    the exact grid value, so floating rounding never misplaces a score.  Each step is a
    column of its own: nested in one expression the estimate would be computed a dozen times a row.
    """
    s = F.col(score)
    t = lambda j: _grid_t(j, start, step, count, last)
    passes = (lambda j: s >= t(j)) if inclusive else (lambda j: s > t(j))
    j0, up = F.col("__j0"), F.col("__up")
    d = d.withColumn("__j0", F.least(F.greatest(F.floor((s - start) / step).cast("bigint"), F.lit(0)), count - 1))
    d = d.withColumn("__up", F.when((j0 + 1 <= count - 1) & passes(j0 + 1), j0 + 1).otherwise(j0))
    return d.withColumn(out, F.when(passes(up), up).otherwise(up - 1)).drop("__j0", "__up")


def threshold_sweep(df: DataFrame, keys: list[str], score: str, label: str = "is_anomaly",
                    step: float = 0.01, inclusive: bool = True, bounds: DataFrame | None = None,
                    count: int | None = None, last: float | None = None, expand: bool = True) -> DataFrame:
    """F1 at every grid level t_j = start + j*step, j < count, in O(n + T).

    Default grid = numpy ``arange(min, max, step)`` of the series' scores.
    ``bounds`` gives other ranges (percentiles for G9, best +- 0.05 for G10):
    a (start, stop) pair of numbers for an unkeyed sweep, or a DataFrame
    (keys, start, stop), None for no level at all; ``count``/``last`` give ``linspace`` grids (G8).
    Flags are ``score >= t`` (``inclusive``, G7) or ``score > t``.
    Every score is mapped to the last level it passes.  Counts change only at
    levels some score ends at, so a distributed reverse running sum over those
    gives one row per run of levels with equal counts.  Output per (keys, j):
    t, tp, fp, fn, f1 -- every level with ``expand``, else the lowest of each run
    (which holds every best level, however many levels the range has).
    """
    keys = list(keys)
    y = F.col(label).cast("long")
    stats = (df.groupBy(*keys) if keys else df).agg(F.min(score).alias("start"), F.max(score).alias("stop"),
                                                     F.sum(y).alias("__P"))
    if isinstance(bounds, (tuple, list)):
        stats = stats.withColumns({"start": F.lit(bounds[0]).cast("double"), "stop": F.lit(bounds[1]).cast("double")})
    elif bounds is not None:
        stats = stats.drop("start", "stop")
        stats = stats.join(bounds.select(*keys, "start", "stop"), keys) if keys else \
            stats.withColumns({c: bounds.select(c).scalar() for c in ("start", "stop")})
    cnt = (F.ceil((F.col("stop") - F.col("start")) / F.lit(float(step))).cast("bigint")
           if count is None else F.lit(int(count)).cast("bigint"))
    rng = stats.select(*keys, F.col("start").cast("double").alias("__start"), cnt.alias("__T"), "__P")
    d = attach_scalars(df.select(*keys, score, y.alias("__y")), rng.select(*keys, "__start", "__T"), keys)
    d = d.filter(F.col("__T") > 0)
    d = _grid_index(d, score, F.col("__start"), F.lit(float(step)), F.col("__T"), inclusive, last)
    # rows below every level go after the aggregation: a filter on the key would put the whole index expression into the scan again
    per = d.groupBy(*keys, "__j").agg(F.sum("__y").alias("__tp"), F.count(F.lit(1)).alias("__pp"), F.max("__j").alias("__passed"))
    per = per.filter(F.col("__passed") >= 0).drop("__passed")
    ranked = row_index(per, keys, ["__j"], "__i")
    cum = running_sum(ranked, keys, "__i", ["__tp", "__pp"], reverse=True)
    before = ranked.select(*keys, (F.col("__i") + 1).alias("__i"), (F.col("__j") + 1).alias("__lo"))
    none = F.lit(0).cast("bigint")
    runs = cum.join(before, keys + ["__i"], "left").select(*keys, F.coalesce("__lo", none).alias("__lo"), F.col("__j").alias("__hi"),
                                                           F.col("__tp_cum").alias("tp"), F.col("__pp_cum").alias("pp"))
    rng = rng.filter(F.col("__T") > 0)
    highest = _g(ranked, keys).agg(F.max("__j").alias("__top"))
    above = attach_scalars(rng.select(*keys, "__T"), highest, keys, "left")        # levels no score passes
    above = above.select(*keys, F.coalesce(F.col("__top") + 1, none).alias("__lo"), (F.col("__T") - 1).alias("__hi"), none.alias("tp"), none.alias("pp"))
    g = attach_scalars(runs.unionByName(above.filter(F.col("__lo") <= F.col("__hi"))), rng, keys)
    g = g.withColumn("__j", F.explode(F.sequence("__lo", "__hi")) if expand else F.col("__lo"))
    g = g.withColumns({"fp": F.col("pp") - F.col("tp"), "fn": F.col("__P") - F.col("tp")})
    t = _grid_t(F.col("__j"), F.col("__start"), F.lit(float(step)), F.col("__T"), last)
    return g.select(*keys, F.col("__j").alias("j"), t.alias("t"),
                    "tp", "fp", "fn", f1_from_counts("tp", "fp", "fn").alias("f1"))


def best_threshold(sweep: DataFrame, keys: list[str], level: str = "t", metric: str = "f1") -> DataFrame:
    """Argmax of the metric; the lowest level wins ties (a distributed max_by)."""
    g = _g(sweep, keys)
    order = F.struct(F.col(metric), -F.col(level))
    return g.agg(F.max_by(level, order).alias(f"best_{level}"), F.max(metric).alias(f"best_{metric}"))


def combined_metric(df: DataFrame, f1: str = "f1", auc: str = "auroc") -> DataFrame:
    """0.5 * (f1 + auc)."""
    return df.withColumn("combined", F.lit(0.5) * (F.col(f1) + F.col(auc)))


def label_agreement(df: DataFrame, rid: str = "rid", label: str = "is_anomaly", flag: str = "flag",
                    keys: list[str] = ()) -> DataFrame:
    """Rows where flags and labels disagree, with which side flagged them."""
    bad = df.filter(_is_one(label) != _is_one(flag))
    kind = F.when(_is_one(flag), F.lit("flagged_not_labelled")).otherwise(F.lit("labelled_not_flagged"))
    return bad.select(*keys, rid, kind.alias("disagreement"))


def accuracy(df: DataFrame, keys: list[str], pred: str, label: str) -> DataFrame:
    """Share of correct class predictions (no prediction is a wrong one)."""
    right = F.coalesce(F.col(pred) == F.col(label), F.lit(False))
    return _g(df, keys).agg(F.avg(right.cast("double")).alias("accuracy"))


def point_categories(df: DataFrame, label: str = "is_anomaly", flag: str = "flag", out: str = "category"):
    """The data behind each scatter: tp / fp / fn / tn per point."""
    l, f = _is_one(label), _is_one(flag)
    cat = (F.when(l & f, "true_positive").when(~l & f, "false_positive")
            .when(l & ~f, "false_negative").otherwise("true_negative"))
    return df.withColumn(out, cat)


def score_histogram(df: DataFrame, keys: list[str], col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between min and max (last bin closed); empty bins kept."""
    keys = list(keys)
    rng = _g(df, keys).agg(F.min(col).alias("__mn"), F.max(col).alias("__mx"))
    d = attach_scalars(df.select(*keys, col), rng, keys)
    width = F.col("__mx") - F.col("__mn")
    b = F.when(width > 0, F.least(F.lit(bins - 1).cast("bigint"),
                                  F.floor((F.col(col) - F.col("__mn")) * (F.lit(float(bins)) / width))
                                  .cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    counts = d.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = rng.select(*keys, "__mn", "__mx",
                          F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    h = all_bins.join(counts, keys + ["bin"], "left").fillna(0, subset=["n"])
    lo = F.col("__mn") + (F.col("__mx") - F.col("__mn")) * F.col("bin").cast("double") / F.lit(float(bins))
    return h.select(*keys, "bin", lo.alias("bin_start"), F.col("n").cast("bigint").alias("n"))


def leaderboard_long(board: DataFrame) -> DataFrame:
    """(dataset, detector, f1, auroc) -> (dataset, detector, metric, value)."""
    return board.unpivot(["dataset", "detector"], ["f1", "auroc"], "metric", "value")


def leaderboard_rank(board: DataFrame, metric: str = "f1") -> DataFrame:
    """Rank detectors per dataset by a metric (best = 1)."""
    w = Window.partitionBy("dataset").orderBy(F.col(metric).desc_nulls_last())
    return board.withColumn("rank", F.rank().over(w))
