"""Streaming: models fitted in batch score a file stream exactly like batch scoring."""

import uuid

from pyspark.sql import functions as F

from testdata_paths import SF_SMALL
from vigil.operators import stats as D
from vigil.session import checkpoint_dir
from vigil.streaming import scoring as ST


def test_stream_scaling_matches_batch(spark):
    batch = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    m = D.moments(batch, [], ["value"]).head()
    stats = {"mean": m["value__mean"], "std": m["value__std"]}
    stream = ST.read_table_stream(spark, SF_SMALL, "events", batch.schema)
    scored = ST.scale_and_flag(stream.select("event_id", "value"), stats, "value", 2.0)
    out = f"{checkpoint_dir(spark)}/stream-test-{uuid.uuid4().hex}"
    q = ST.write_parquet_stream(scored, out, f"t-{uuid.uuid4().hex}")
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    want = ST.scale_and_flag(batch.select("event_id", "value"), stats, "value", 2.0)
    assert got.count() == batch.count()
    assert got.select("event_id", "flag").exceptAll(want.select("event_id", "flag")).count() == 0
    assert got.filter(F.col("flag") == 1).count() > 0
