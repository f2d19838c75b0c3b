"""Interaction of five document filters under every order of application.

Filters (a document fails if ...; words are maximal runs of ``[^\\x20\\x09-\\x0D]``):

* A  it has under 50 words
* B  its distinct words are under 65 % of its words
* C  over 5 % of its code points are ``[A-Z]``
* D  it holds one of ``#$%&*|``
* E  its text is identical to the text of any smaller doc_id, removed or not

E is an existential self-join: a left-semi join on hash, exact text and a
smaller doc_id.  Its right side is pre-aggregated (first on the map side) to one
row per text and chunk, the smallest doc_id there, so a group of copies is never
paired with itself.  A hash that holds more than a quarter of a partition's share of all rows is dealt to
chunks by doc_id; the smallest rows of its chunks (at most 8 per partition)
meet in a second semi-join of the same form.

The failure ids of all filters are put in one table and combined to a bit mask
per (doc_id, text); counts per (part, mask) are all that the 120 orders need:
in an order, a filter removes what fails it and no earlier filter.

Defined results: a null text is empty; a null source is the part "" (like an
empty one); a row without doc_id neither is nor has a smaller id, and has no label; rows
repeating a doc_id count each, E looks at strictly smaller ids only; a document
is good (toxic) if any of its label rows says 1; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.base import partitions, query, table, write_table

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST_WORDS = 50
LEAST_DISTINCT = 65          # percent of the words
MOST_CAPITALS = 5            # percent of the code points
MARKS = "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"
#: A hash is hot if it has more rows than all rows / (HOT * partitions).
HOT = 4


def own_failures(text) -> F.Column:
    """Bits of the filters A to D for a text column."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    n = F.size(words)
    fails = {"A": n < LEAST_WORDS, "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
             "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MOST_CAPITALS * F.length(text), "D": text.rlike(MARKS)}
    return reduce(lambda a, b: a + b, [F.when(c, BIT[f]).otherwise(0) for f, c in fails.items()])


def copies_of_smaller(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256) of every row whose text a row with a smaller doc_id has too."""
    spark = docs.sparkSession
    rows = (docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .withColumn("hash", F.xxhash64("text")))
    share = F.lit(HOT * partitions(spark)) / F.lit(max(docs.count(), 1))
    counts = rows.groupBy("hash").count()
    hot = write_table(counts.select("hash", F.ceil(F.col("count") * share).cast("int").alias("chunks")).filter("chunks > 1"), "audit-hot")
    # at most HOT * partitions rows of 12 bytes: the bound of both broadcasts
    dealt = rows.join(F.broadcast(hot), "hash", "left")
    chunk = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"), F.lit(0))
    dealt = dealt.select("doc_id", "text", "hash", chunk.alias("chunk"))
    least = dealt.groupBy("hash", "chunk", "text").agg(F.min("doc_id").alias("least"))

    def semi(left, right, keys):
        b = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("least").alias("r_least"))
        same = [F.col(k) == F.col(f"r_{k}") for k in keys]
        return left.join(b, reduce(lambda x, y: x & y, same) & (F.col("r_least") < F.col("doc_id")), "left_semi")
    inside = semi(dealt, least, ["hash", "chunk", "text"])
    heads = least.join(F.broadcast(hot), "hash", "left_semi").select("hash", "text", "least")
    across = semi(heads.withColumn("doc_id", F.col("least")), heads, ["hash", "text"])
    sha = F.sha2("text", 256).alias("text_sha256")
    return inside.select("doc_id", sha).unionByName(across.select("doc_id", sha))


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): bits of all failed filters, for n equal rows each."""
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    sha = F.sha2("text", 256).alias("text_sha256")
    own = rows.select("doc_id", sha, own_failures(F.col("text")).alias("bits")).filter("bits > 0")
    failed = own.unionByName(copies_of_smaller(docs).withColumn("bits", F.lit(BIT["E"])))
    masks = failed.groupBy("doc_id", "text_sha256").agg(F.bit_or("bits").alias("mask"))
    masks = masks.withColumnsRenamed({"doc_id": "m_id", "text_sha256": "m_sha"})
    here = F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_sha256") == F.col("m_sha"))
    out = rows.groupBy("doc_id", sha, "part").agg(F.count(F.lit(1)).alias("n")).join(masks, here, "left")
    return out.select("doc_id", "part", F.coalesce("mask", F.lit(0)).alias("mask"), "n")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step with what the step's filter does there."""
    marked = labels.groupBy(F.col("doc_id").alias("l_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = failure_masks(docs).join(marked, F.col("doc_id") == F.col("l_id"), "left")
    times = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    cells = rows.groupBy("part", "mask").agg(F.sum("n").alias("all"), times("good"), times("toxic"))
    # 32 masks at most per part
    by = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("all", "good", "toxic")))).alias("cells"))
    steps = (by.withColumn("filter_order", F.explode(F.lit(ORDERS)))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))))
    before = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    here = F.substring("filter_order", F.col("step"), F.lit(1))
    bits = lambda s: reduce(lambda a, b: a + b, [F.when(F.contains(s, F.lit(f)), b).otherwise(0) for f, b in BIT.items()])
    steps = steps.withColumns({"before": bits(before), "bit": bits(here)})

    def total(measure, condition, weight=lambda m: F.lit(1)):
        def add(acc, e):
            m = e["key"]
            return acc + F.when(condition(m), e["value"][measure] * weight(m)).otherwise(F.lit(0).cast("long"))
        return F.aggregate(F.map_entries("cells"), F.lit(0).cast("long"), add).alias
    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~gone(m)
    return steps.select(
        "part", "filter_order", "step",
        total("all", lambda m: ~fails(m) & ~gone(m))("kept"), total("all", removed)("removed"),
        total("all", lambda m: fails(m) & gone(m))("redundant"), total("all", lambda m: m == F.col("bit"))("unique_fails"),
        total("good", removed)("good_lost"), total("toxic", removed)("toxic_lost"),
        # a filter comes first of a mask's k filters in 1 / k of all orders
        total("all", fails, lambda m: (F.lit(len(ORDERS)) / F.bit_count(m)).cast("long"))("shapley"))


@query("op13_filter_audit", f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
f AS (SELECT doc_id, part,
  CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
o AS (SELECT unnest({ORDERS}) AS filter_order),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
  list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS earlier FROM o, range(1, 6) AS r(step)),
x AS (SELECT part, filter_order, step, bit, n, good, toxic, mask, (mask & bit) <> 0 AS fails, (mask & coalesce(earlier, 0)::BIGINT) <> 0 AS gone FROM c, s),
y AS (SELECT part, filter_order, step, bit, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM y
""")
def audit_query(spark, sf_dir):
    """Every order of the five filters over the whole corpus, by source."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
