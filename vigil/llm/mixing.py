"""Mixing sources to target weights by Poisson replication.

A source with target weight w and size m (characters) gets the mean repetition
rate  epochs * total * w / m  and every document is repeated a Poisson number
of times with that mean.  The number is the inverse of the Poisson
distribution at a uniform value hashed from seed and doc_id, so it depends on
nothing but the document and its source's rate: the result is the same under
any partitioning and any retry.  Copies are then put into one global order by
a hash of (seed, doc_id, copy).

Large rates: a mean above ``PART_MEAN`` is the sum of equal parts, each
inverted with a hash of its own (Poisson variables add up), so exp(-mean)
never underflows and no count is capped.

The only tables that meet are the documents and one row per source; AQE
decides by measured size how they are joined and splits a source that holds
most rows.  The global order is a range-partitioned sort.

Defined results: a null source is a source of its own; null or empty texts
have size 0 (a source with nothing else keeps the rate ``epochs``); rows
repeating a doc_id get the same number of copies; a given weight table leaves
out sources it does not name; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.base import fresh, query, table

SEED = "mix-1"
SMOOTHING = 0.7       # default target weight of a source: its size to this power
EPOCHS = 1.0          # expected size of the result, in sizes of the input
PART_MEAN = 500.0


def mixing_rates(docs: DataFrame, weights: dict | None = None, smoothing: float = SMOOTHING, epochs: float = EPOCHS) -> DataFrame:
    """(source, size, rate): mean repetitions of each source's documents."""
    sizes = docs.groupBy("source").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("double").alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("size", F.lit(smoothing)))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,double>")
        sizes = sizes.withColumn("weight", F.coalesce(F.try_element_at(given, F.coalesce("source", F.lit(""))).cast("double"), F.lit(0.0)))
    both = sizes.agg(F.sum("size").alias("total"), F.sum("weight").alias("weights"))
    total, all_weights = both.select("total").scalar(), both.select("weights").scalar()
    rate = F.when(F.col("size") > 0, F.lit(float(epochs)) * total * (F.col("weight") / all_weights) / F.col("size")).otherwise(F.lit(float(epochs)))
    return sizes.select("source", "size", rate.alias("rate"))


def _uniform(*parts) -> F.Column:
    """52 hash bits as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _cdf(mean: F.Column) -> F.Column:
    """Poisson distribution function at 0, 1, 2, ... until it is 1 in double precision."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["cdf"])


def replicate(docs: DataFrame, weights: dict | None = None, smoothing: float = SMOOTHING, epochs: float = EPOCHS,
              seed: str = SEED) -> DataFrame:
    """All copies in shuffled order: the columns of ``docs``, rate, n_copies, copy_no (from 1), shuffle_key (fresh names)."""
    rate, n_copies, copy_no, key, own, n_parts, cdf = (
        fresh(n, docs.columns) for n in ("rate", "n_copies", "copy_no", "shuffle_key", "mix_source", "rate_parts", "rate_cdf"))
    rates = mixing_rates(docs, weights, smoothing, epochs)
    parts = F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int")
    rates = rates.select(F.col("source").alias(own), F.col("rate").alias(rate), parts.alias(n_parts), _cdf(F.col("rate") / parts).alias(cdf))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    draws = F.transform(F.sequence(F.lit(1), F.col(n_parts)), lambda k: _uniform(F.lit(seed), name, k.cast("string")))
    count = F.aggregate(draws, F.lit(0), lambda a, u: a + F.size(F.filter(cdf, lambda c: c <= u)))
    out = docs.join(rates, docs["source"].eqNullSafe(F.col(own))).withColumn(n_copies, count.cast("long")).filter(F.col(n_copies) > 0)
    out = out.withColumn(copy_no, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n_copies))))
    out = out.withColumn(key, F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), name, F.col(copy_no).cast("string"))))
    return out.select(*docs.columns, rate, n_copies, copy_no, key).orderBy(key)


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus with the columns of ``docs``, in shuffled order."""
    return replicate(docs).select(*docs.columns)


@query("op3_poisson_mixing", """
WITH RECURSIVE s AS (SELECT source, CAST(sum(length(text)) AS DOUBLE) AS size FROM documents GROUP BY 1),
r AS (SELECT source, (SELECT sum(size) FROM s) * (pow(size, 0.7) / (SELECT sum(pow(size, 0.7)) FROM s)) / size AS rate FROM s),
c(source, rate, k, p, cdf) AS (SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM c WHERE k < rate + 12 * sqrt(rate) + 30),
u AS (SELECT *, CAST(('0x' || substr(md5('mix-1:' || doc_id || ':1'), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT u.doc_id, u.source, u.text, c.rate, count(*) FILTER (c.cdf <= u.u) AS n_copies FROM u JOIN c ON u.source = c.source GROUP BY ALL),
e AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM n)
SELECT doc_id, source, text, round(rate, 9) AS rate, n_copies, copy_no, md5('mix-1:order:' || doc_id || ':' || copy_no) AS shuffle_key FROM e
""")
def poisson_mixing(spark, sf_dir):
    """The whole corpus mixed to smoothed source weights."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return replicate(docs).withColumn("rate", F.round("rate", 9))
