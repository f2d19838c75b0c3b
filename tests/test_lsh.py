"""Hashed neighbours: the k best of all probed buckets, whatever the blocks; a query travels once per cell, not once per probe."""

import numpy as np
from pyspark.sql import functions as F

from vigil.operators import lsh as LSH


def _rows(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(1500, 3)), np.tile([[0.5, -0.5, 0.25]], (300, 1)), rng.normal(size=(10, 3)) * 1e3,
                        np.round(rng.normal(size=(400, 3)))])
    return x, spark.createDataFrame([(i, [float(v) for v in y]) for i, y in enumerate(x)], "id long, v array<double>").repartition(3)


def _brute(x, t, k):
    slab = [np.floor(sum(x[:, c, None] * np.array(a)[None, :, c] for c in range(x.shape[1])) / t.width + np.array(b)).astype(int)
            for a, b in zip(t.directions, t.shifts)]
    out = {}
    for q in range(0, len(x), 3):
        near = np.zeros(len(x), bool)
        for s in slab:
            gap = np.abs(s - s[q])
            near |= gap.sum(axis=1) <= 1
        near[q] = False
        c = np.flatnonzero(near)
        d = np.sqrt(((x[c] - x[q]) ** 2).sum(axis=1))
        if len(c):
            out[q] = sorted(zip(np.round(d, 9), c))[:k]
    return out


def test_best_of_all_probes(spark, monkeypatch):
    x, df = _rows(spark)
    df = df.unionByName(spark.createDataFrame([(9999, [0.0, None, 1.0]), (9998, [0.0, float("nan"), 1.0]), (9996, None)], df.schema))   # no neighbours
    t = LSH.fit(df.filter("id < 9000").select(F.col("v").alias("vec")), "vec", 3, per_bucket=25.0)
    want = _brute(x, t, 5)
    for values, pack in ((LSH.BLOCK_VALUES, LSH.PACK), (0, 16)):                 # whole cells; cells dealt to blocks of 64
        monkeypatch.setattr(LSH, "BLOCK_VALUES", values)
        monkeypatch.setattr(LSH, "PACK", pack)
        got: dict = {}
        for r in LSH.knn_lsh(df.filter(F.col("id") % 3 == 0), df, "id", "v", 5, t, block_rows=64).orderBy("id", "rank").collect():
            assert r["rank"] == len(got.setdefault(r["id"], [])) + 1
            got[r["id"]].append((round(r["d"], 9), r["nid"]))
        assert got == want


def test_queries_travel_by_cell(spark):
    x, df = _rows(spark)
    named = df.select(F.col("id").alias("rid"), F.col("v").alias("vec"))
    t = LSH.fit(named, "vec", 3, per_bucket=25.0)
    sent = LSH.bucketed(named, t, probes=True)
    assert "string" not in [k for _, k in sent.dtypes]                          # slabs stay numbers
    assert sent.count() < 4 * (1 + 3) * len(x)                                  # 4 * (1 + 2 * 3) before
    assert sent.groupBy("rid", "table", "cell0", "cell1", "cell2").count().filter("count > 1").isEmpty()
    refs = LSH.bucketed(named, t)
    assert refs.select(F.explode("rid")).count() == 4 * len(x) > 2 * refs.count()   # rows of a batch and cell travel together
    lists = LSH._cell_lists(named, named, 5, t, True, 100_000)
    assert lists.count() <= sent.count()                                        # one list per query and cell, not one row per neighbour


def test_references_stay_together_with_many_cells(spark, monkeypatch):
    """Rows of a task are packed over its Arrow batches, so that references of a cell are few rows however small the batches."""
    x, df = _rows(spark)
    named = df.filter("id < 1500").select(F.col("id").alias("rid"), F.col("v").alias("vec")).coalesce(1)
    t = LSH.fit(named, "vec", 3, per_bucket=5.0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        cells = LSH.bucketed(named, t, only=2)
        assert cells.select("table").distinct().collect()[0][0] == 2
        assert cells.count() == cells.select("cell0", "cell1", "cell2").distinct().count()   # one row a cell, not one a batch and cell
        monkeypatch.setattr(LSH, "TASK_VALUES", 600)
        assert cells.count() <= LSH.bucketed(named, t, only=2).count()
        assert LSH.bucketed(named, t, only=2).select(F.explode("rid")).count() == 1500
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = np.arange(21.0).reshape(7, 3)
    packs = LSH.pa.array([LSH._packed(rows[:5]), LSH._packed(rows[5:])], LSH.pa.binary())
    assert (LSH._unpacked(packs, np.array([5, 2]), 3) == rows).all()


def test_shuffle_files_and_tables_go(spark):
    """A written table replaces the shuffle that made it; discarded tables go, those still read stay."""
    import os
    from vigil.session import discard, materialize, written_tables
    a = materialize(spark.range(1000).repartition(5), "test-a")
    b = materialize(a.filter("id < 10"), "test-b")
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") in (None, "false")
    folder = lambda df: [f.split(":")[-1].replace("///", "/") for f in written_tables(df)]
    here = folder(a)
    assert here and all(map(os.path.isdir, here))
    discard(written_tables(a), a.unionAll(b))
    assert all(map(os.path.isdir, here))
    discard(written_tables(a), b)
    assert not any(map(os.path.isdir, here)) and b.count() == 10
