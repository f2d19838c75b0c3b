"""Box neighbours: one list per query, finished queries stay where they are, copies and far rows included."""

import numpy as np

from vigil.operators import boxes as BX
from vigil.operators import neighbors as NB


def test_queries_travel_as_lists(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.uniform(size=(900, 2)), np.tile([[0.5, 0.5]], (120, 1)), rng.normal(size=(20, 2)) * 1e4, np.stack([np.full(160, 7.0), np.arange(160) % 3], axis=1)])
    df = spark.createDataFrame([(i, [float(v) for v in y]) for i, y in enumerate(x)], "rid long, vec array<double>").repartition(3)
    tables, keep = {}, BX.materialize

    def record(d, name):
        tables[name] = keep(d, name)
        return tables[name]
    monkeypatch.setattr(BX, "materialize", record)
    got = {r["rid"]: r["score"] for r in NB.knn_score(df, [], "rid", "vec", 4, block_rows=64).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert len(got) == len(x) and np.allclose([got[i] for i in range(len(x))], np.sort(d, axis=1)[:, 3])
    own = tables["knn-own-cell"]                                          # one row per neighbour before
    assert own.filter("done").count() > 300 and own.filter("done").select("rid").distinct().count() == own.filter("done").count()
    assert own.select("rid").distinct().count() == len(x)
