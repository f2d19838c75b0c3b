"""Content-addressed WARC archive.

Every input row becomes one WARC/1.1 record.  The archive is two Parquet
tables in shared storage:

* ``payloads`` -- (payload_digest, payload): each distinct payload once;
* ``records``  -- (page_id, header, payload_digest, ...): the exact header bytes of every record.

``read_archive`` rebuilds full records by joining the two and checks each
payload against its digest.  The digest is SHA-256; while storing, the least
and greatest payload of every digest are compared, so two payloads sharing a
digest stop the job instead of being merged.

Duplicates: among equal payloads of at least ``min_bytes`` bytes the smallest
page_id is the ``response`` and all others are ``revisit`` records naming it;
smaller payloads are always ``response``.  A null payload is the empty one.
Rows repeating the smallest page_id itself are all responses (they are the
same page).  Null page_ids sort last and are responses only if no row of the
group has an id.  Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.base import query, table, write_table

MIN_REVISIT_BYTES = 100
WARC_DATE = "2024-01-01T00:00:00Z"


def _header(revisit: F.Column) -> F.Column:
    """Header block of one record; the last line ends with an empty one."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "%0A")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(WARC_DATE)),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", urn(F.col("first_id"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit("\r\n"))


def write_archive(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Write (records, payloads) for ``pages`` (page_id, url, html) and return both as read back."""
    src = (pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
           .withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")}))
    # one shuffle of payloads, combined on the map side first: a hot payload is one row per task
    store = src.groupBy("payload_digest", "payload_bytes").agg(
        F.min("payload").alias("payload"), F.max("payload").alias("other"), F.min("page_id").alias("first_id"))
    store = store.withColumn("payload", F.when(F.col("payload") == F.col("other"), F.col("payload")).otherwise(
        F.raise_error(F.lit("two payloads share one SHA-256 digest")).cast("binary"))).drop("other")
    payloads = write_table(store, "warc-payloads")
    slim = src.select("page_id", "url", "payload_digest", "payload_bytes")
    firsts = payloads.select("payload_digest", "first_id")
    joined = slim.join(firsts, "payload_digest", "left")
    # without any id in the group first_id is null and every row stays a response
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    records = write_table(joined.select("page_id", _header(revisit).alias("header"), "payload_digest"), "warc-records")
    return records, payloads.select("payload_digest", "payload")


def read_archive(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """Rebuild every record: (page_id, header, payload, record); payloads are checked against their digest."""
    named = F.regexp_extract("header", "WARC-Payload-Digest: sha256:([0-9a-f]{64})", 1)
    full = records.withColumn("named", named).join(payloads, "payload_digest", "left")
    ok = F.sha2("payload", 256) == F.col("named")
    payload = F.when(ok, F.col("payload")).otherwise(F.raise_error(F.lit("payload does not match its digest")).cast("binary"))
    full = full.withColumn("payload", payload)
    body = F.when(F.col("header").contains("\r\nWARC-Type: revisit\r\n"), F.lit(b"")).otherwise(F.col("payload"))
    return full.select("page_id", "header", "payload", F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("record"))


@query("op9_warc_archive", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN f USING (payload_digest)
""")
def warc_archive(spark, sf_dir):
    """Archive all pages, read the records back and report each from its own bytes."""
    back = read_archive(*write_archive(table(spark, sf_dir, "pages")))
    head = F.col("header")
    refers = F.nullif(F.regexp_extract(head, "\r\nWARC-Refers-To: <urn:page:(-?[0-9]+)>", 1), F.lit(""))
    return back.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        F.regexp_extract(head, "\r\nWARC-Type: ([a-z]+)", 1).alias("record_type"),
        refers.cast("long").alias("refers_to"))
