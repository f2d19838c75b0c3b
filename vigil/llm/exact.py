"""Exact dedup by distributed MSD radix partitioning.

Texts are compared after deleting every space-like character
(``[\\x20\\x09-\\x0D]``).  Documents are split by successive runs of bytes of
that normal form -- the digits -- most significant first: a group is the set
of rows whose digits so far agree, a group of one leaves at once, and a group
whose rows have ended at the same byte is a set of equal texts.  Digits get
wider each round (64 bytes, 512, 4 kB, ...), so the number of rounds is
logarithmic in the longest text.  Equality is always that of bytes; no digest
decides anything (the SHA-256 column is output only).

Per round the groups are found by one aggregation that combines on the map
side, so a group of copies holding a third of all rows is one row per task,
and rows join their group under AQE's skew splitting.  Only rows whose digits
still agree with another row carry their bytes into the next round.

Defined results: null text equals the empty text; rows repeating a doc_id are
separate rows (exactly one row of a group is kept); a null doc_id sorts last;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.base import drop_table, map_text, query, table, write_table
from vigil.llm.text import NOT_SPACE, count_by_row

FIRST_DIGIT = 64      # bytes of the first digit
GROWTH = 8            # each digit is so many times wider than the last


def _normalise(buf, offs):
    """Code points of each text, size and SHA-256 of its bytes without space characters, and those bytes."""
    keep = NOT_SPACE[buf]
    ends = np.zeros(len(offs), np.int64)
    np.cumsum(count_by_row(keep, offs), out=ends[1:])
    body = buf[keep].tobytes()
    sha = [hashlib.sha256(body[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    bodies = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sha), [None, pa.py_buffer(ends), pa.py_buffer(body)])
    return [count_by_row((buf & 0xC0) != 0x80, offs), np.diff(ends), pa.array(sha, pa.string()), bodies.cast(pa.binary())]


def exact_groups(docs: DataFrame, first_digit: int = FIRST_DIGIT, growth: int = GROWTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    rows = map_text(docs, _normalise, [("n_points", "long"), ("n_bytes", "long"), ("text_sha256", "string"),
                                       ("body", "binary")], ["doc_id"])
    rows = write_table(rows.withColumn("rid", F.monotonically_increasing_id()), "exact-rows")
    slim = rows.select("rid", "doc_id", "text_sha256")
    active = rows.select("rid", F.lit(0).cast("long").alias("gid"), "doc_id", "n_points", "n_bytes", "body")
    members, at, width = [], 0, first_digit
    while True:
        digit = active.withColumns({"digit": F.substring("body", at + 1, width), "ended": F.col("n_bytes") <= at + width})
        best = F.min(F.struct((-F.col("n_points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
        groups = (digit.groupBy("gid", "digit", "ended").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
                  .filter("n > 1"))
        groups = write_table(groups.withColumn("new_gid", F.monotonically_increasing_id()), "exact-groups")
        # always by sorted merge: with a broadcast at small sizes only, the plan would change as the input grows
        split = digit.join(groups.hint("merge"), ["gid", "digit", "ended"]).select(
            "rid", F.col("new_gid").alias("gid"), "doc_id", "n_points", "n_bytes", "ended", "n",
            F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"),
            F.when(~F.col("ended"), F.col("body")).alias("body"))
        split = write_table(split, "exact-split")
        drop_table(groups)
        members.append(split.filter("ended").select("rid", "keep_id", "keep_rid", F.col("n").alias("group_size")))
        active = split.filter("NOT ended").select("rid", "gid", "doc_id", "n_points", "n_bytes", "body")
        at, width = at + width, width * growth
        if active.isEmpty():
            break
    found = members[0]
    for more in members[1:]:
        found = found.unionByName(more)
    out = slim.join(found, "rid", "left")
    grouped = F.col("keep_rid").isNotNull()
    return out.select(
        "doc_id", F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep_rid") == F.col("rid"), F.lit(True)).alias("kept"), "text_sha256")


@query("op4_exact_radix_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS pts, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT t, count(*) AS n, arg_min(doc_id, struct_pack(a := -pts, b := doc_id)) AS keep_id FROM d GROUP BY t)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
""")
def exact_radix_dedup(spark, sf_dir):
    """Groups of texts equal up to space characters; the longest original stays."""
    return exact_groups(table(spark, sf_dir, "documents"))
