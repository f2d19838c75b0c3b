"""H1-H5: parameter grids and model selection as data.

A grid is a DataFrame of parameter rows (built by exploding literal value
lists — parameters, not data), so evaluating a grid is one plan over
(grid x folds) instead of a driver loop.  For kNN one neighbour list at the
largest k serves every k of the grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.columns import f1_from_counts


def param_grid(spark: SparkSession, params: dict[str, list]) -> DataFrame:
    """H1: cartesian product of value lists (one row per combination)."""
    df = spark.range(1).select()
    for name, values in params.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def param_sample(grid: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """H2: n combinations chosen by a seeded hash order (a sampling operator, so a limit)."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in grid.columns]))
    return grid.withColumn("__h", h).orderBy("__h").limit(int(n)).drop("__h")


def knn_grid_f1(cands: DataFrame, labels: DataFrame, keys: list[str], rid: str, ks: list[int],
                qs: list[float], label: str = "is_anomaly") -> DataFrame:
    """H4 for the kNN detector: F1 for every (k, percentile) pair.

    ``cands`` holds per row the sorted neighbour array ``nbrs`` (at max k);
    the k-th distance of each grid k is read off it, so one neighbour pass
    serves the whole grid.  Percentiles are exact (per k, across the series).
    """
    keys = list(keys)
    named = cands if label in cands.columns else cands.join(labels.select(*keys, rid, label), keys + [rid])
    sc = named.select(*keys, rid, label, F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "nbrs")
    sc = sc.withColumn("score", F.when(F.size("nbrs") >= F.col("k"), F.element_at("nbrs", F.col("k"))["d"])).drop("nbrs")
    from vigil.session import materialize
    return _percentile_counts(materialize(sc, "grid-scores"), keys, "k", qs, label)


def _percentile_counts(sc: DataFrame, keys: list[str], param: str, qs: list[float], label: str) -> DataFrame:
    """F1 per (param, percentile) of scored rows (keys, param, score, label), thresholds exact per (keys, param)."""
    from vigil.operators.stats import quantiles
    th = quantiles(sc, keys + [param], "score", [q / 100.0 for q in qs])
    # one wide threshold row per (series, param); each scored row is counted once for all percentiles
    wide = th.groupBy(*keys, param).agg(*[F.max(F.when(F.abs(F.col("q") - q / 100.0) < 1e-12, F.col("value"))).alias(f"__t{i}") for i, q in enumerate(qs)])
    fl = sc.join(wide, keys + [param], "left")
    y = F.coalesce(F.col(label) == 1, F.lit(False))
    counts = []
    for i in range(len(qs)):
        f = F.coalesce(F.col("score") > F.col(f"__t{i}"), F.lit(False))       # a missing score is not flagged
        counts.append(F.struct(F.lit(float(qs[i])).alias("q"), F.count_if(y & f).alias("tp"), F.count_if(~y & f).alias("fp"), F.count_if(y & ~f).alias("fn")))
    conf = fl.groupBy(param).agg(F.array(*counts).alias("__c")).select(param, F.inline("__c"))
    return conf.withColumn("f1", f1_from_counts("tp", "fp", "fn"))


def forest_grid_f1(df: DataFrame, nodes: DataFrame, psi: int, features: list[str], tree_counts: list[int],
                   contaminations: list[float], label: str = "is_anomaly") -> DataFrame:
    """H4 for the isolation forest: F1 for every (n_trees, contamination).

    The largest forest is fitted once; a smaller one is its first trees, and one pass gives the path sums of all
    of them.  A contamination c flags the rows above the (1 - c) score quantile.
    """
    from vigil.operators import forest as FR
    from vigil.session import materialize
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in features], label)
    if nodes.count() <= FR.CHUNK_NODES:
        sums = FR.shared_paths(rows, nodes, features, list(tree_counts), "sums").select(label, "sums")
    else:
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "forest-grid-rows")
        sums = FR.score_blocks(rows.select(F.lit(0).alias("forest"), "row", *features), nodes.select(F.lit(0).alias("forest"), *FR.NODE_COLUMNS),
                               features, list(tree_counts))
        sums = rows.select("row", label).join(sums, "row")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("n_trees"), FR.path_score(F.col("sums")[i], k, psi).alias("score")) for i, k in enumerate(tree_counts)]))
    out = sums.select(label, each.alias("g"))
    # equal paths must tie at the threshold whatever the order their lengths were added in
    out = out.select("g.n_trees", label, F.round("g.score", 9).alias("score"))
    qs = [100.0 * (1.0 - c) for c in contaminations]
    g = _percentile_counts(materialize(out, "forest-grid"), [], "n_trees", qs, label)
    return g.withColumn("contamination", F.round(1.0 - F.col("q") / 100.0, 9)).drop("q")


def forest_cv(rows: DataFrame, rid: list[str], features: list[str], combos: list[dict], fold: str = "fold",
              label: str = "is_anomaly", seed: int = 42) -> DataFrame:
    """H2/H3 for the isolation forest: mean AUROC over the folds of every combination.

    ``combos`` are dicts of n_trees, max_samples, max_features and contamination; ``rows`` have a fold.  A fold's
    forests are fitted on the other folds' rows and score its own.  All forests (fold x sample size x features
    per tree) are drawn, grown and scored together; a forest of fewer trees is the first trees of a larger one.
    A tree's sample is held by one task, which grows the tree for all forests and scores the rows that stream by
    (``forest.fold_paths``); samples above ``forest.TREE_ROWS`` grow level by level.
    AUROC ranks scores, so combinations that differ in their contamination only share it.  A fold of one
    class has no AUROC and is left out of the mean.
    """
    from vigil.operators import forest as FR
    from vigil.operators.evaluate import auroc
    from vigil.session import materialize
    spark, width = rows.sparkSession, len(features)
    rows = rows.na.drop(subset=features).select(
        F.col(fold).cast("int").alias("fold"), F.concat_ws("|", *[F.col(c).cast("string") for c in rid]).alias("__key"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(label).alias("label"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "cv-rows")
    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}            # one row per fold
    total, counts = sum(sizes.values()), sorted({c["n_trees"] for c in combos})
    # (fold, sample size) -> draw; (draw, features per tree) -> forest
    draws: dict = {}
    forests: dict = {}
    for f in sizes:
        for c in combos:
            psi = FR.sample_size(c["max_samples"], total - sizes[f])
            d = draws.setdefault((f, psi), [len(draws), 0])
            w = forests.setdefault((f, psi, FR._feature_subset(width, c["max_features"])), [len(forests), 0])
            d[1], w[1] = max(d[1], c["n_trees"]), max(w[1], c["n_trees"])
    if not draws:
        return spark.createDataFrame([], "n_trees int, max_samples double, max_features double, contamination double, mean_auroc double")
    limit = min(1.0, max((psi + 8.0 * psi ** 0.5 + 32.0) / (total - sizes[f]) for f, psi in draws))
    table = spark.createDataFrame([(draws[f, psi][0], f, psi, i, FR.depth_limit(psi), subset, t, FR._norm(psi))
                                   for (f, psi, subset), (i, t) in forests.items()],
                                  "draw int, fold int, psi int, forest int, limit int, subset int, trees int, norm double")
    if limit * total <= FR.TREE_ROWS:
        sums = FR.fold_paths(rows, [(i, f, psi, subset, t) for (f, psi, subset), (i, t) in forests.items()], counts[-1], limit, width, counts, seed)
    else:
        sums = _cv_paths_by_level(rows, table, draws, counts, limit, width, seed)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("n_trees"), F.lit(j).alias("at")) for j, k in enumerate(counts)])).alias("k")
    scored = sums.join(table.select("forest", "norm", "trees"), "forest").join(rows.select("row", "label"), "row").select("*", each)
    path = F.element_at("sums", F.col("k.at") + 1)
    scored = scored.filter("k.n_trees <= trees").select(
        "forest", F.col("k.n_trees").alias("n_trees"), "label", F.round(F.pow(F.lit(2.0), -path / (F.col("k.n_trees") * F.col("norm"))), 9).alias("score"))
    areas = auroc(materialize(scored, "cv-scored"), ["forest", "n_trees"], "score", "label")
    wanted = [(c["n_trees"], float(c["max_samples"]), float(c["max_features"]), float(c["contamination"]),
               forests[f, FR.sample_size(c["max_samples"], total - sizes[f]), FR._feature_subset(width, c["max_features"])][0]) for c in combos for f in sizes]
    named = spark.createDataFrame(wanted, "n_trees int, max_samples double, max_features double, contamination double, forest int")
    return (named.join(areas, ["forest", "n_trees"]).groupBy("n_trees", "max_samples", "max_features", "contamination")
            .agg(F.avg("auroc").alias("mean_auroc")))


def _cv_paths_by_level(rows: DataFrame, table: DataFrame, draws: dict, counts: list[int], limit: float, width: int, seed: int) -> DataFrame:
    """Path sums of the folds' rows where one tree's sample is too large for a task: trees grow level by level, nodes meet rows in blocks."""
    from vigil.functions.columns import hash_below, hash_hex, hex_unit
    from vigil.operators import forest as FR
    from vigil.session import materialize
    asked = F.array(*[F.struct(F.lit(i).alias("draw"), F.lit(f).alias("out"), F.lit(psi).alias("psi"), F.lit(t).alias("trees"))
                      for (f, psi), (i, t) in draws.items()])
    drawn = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(counts[-1] - 1))))
    drawn = drawn.withColumn("__hex", hash_hex(seed, F.col("tree"), F.col("__key"))).filter(hash_below(F.col("__hex"), limit))
    drawn = drawn.withColumn("d", F.explode(F.filter(asked, lambda d: (d["out"] != F.col("fold")) & (F.col("tree") < d["trees"]))))
    drawn = materialize(drawn.select("d.draw", "d.psi", "tree", hex_unit(F.col("__hex")).alias("__h"), "__key", "x"), "cv-drawn")
    least = drawn.groupBy("draw", "psi", "tree").count().agg(F.min(F.col("count") - F.col("psi"))).first()[0]
    if least < 0:                # odds below 1e-14 a tree
        raise RuntimeError("a tree drew too few candidates; choose another seed")
    sample = FR.smallest(drawn, ["draw", "tree"], "psi", limit)
    sample = sample.join(table.select("draw", "forest", "limit", "subset", "trees"), "draw").filter("tree < trees")
    nodes = materialize(FR.grow(sample, width, max(psi for _, psi in draws), seed), "cv-nodes")
    flat = rows.select("fold", "row", *[F.col("x")[i].alias(f"f{i}") for i in range(width)])
    return FR.score_blocks(flat.join(table.select("fold", "forest"), "fold").drop("fold"), nodes, [f"f{i}" for i in range(width)], counts)


def best_params(scored: DataFrame, params: list[str], metric: str) -> DataFrame:
    """H3/H4: the parameter row with the highest metric (ties: smallest parameters)."""
    order = F.struct(F.col(metric), *[-F.col(p) for p in params])
    return scored.agg(F.max_by(F.struct(*params), order).alias("best"), F.max(metric).alias(metric)) \
                 .select("best.*", metric)
