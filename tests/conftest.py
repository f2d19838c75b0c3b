import os
import sys
import tempfile

import pytest

from testdata_paths import ROOT, SF_SMALL

sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from vigil.session import configure
    b = (SparkSession.builder.master("local[*]").appName("vigil-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    if not os.environ.get("SPARK_CHECKPOINT_DIR_SET"):
        b = b.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="vigil-test-ckpt-"))
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in ("events embeddings lineitem labels documents").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con
