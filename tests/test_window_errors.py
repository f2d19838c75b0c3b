"""Channel errors of windows: each window is read once, as a matrix."""

import numpy as np
from pyspark.sql import functions as F

from vigil.operators import reconstruct as RC


def test_channel_errors_of_mean_windows(spark):
    rng = np.random.default_rng(1)
    shapes = [(4, 2)] * 30 + [(3, 2), None, (4, 5)]
    data = [(i, None if s is None else [[float(v) for v in r] for r in rng.normal(size=s)]) for i, s in enumerate(shapes)]
    df = spark.createDataFrame(data, "i int, window array<array<double>>")
    for part in (df.filter("i < 30"), df.repartition(1)):
        r = RC.window_mae_channel(RC.window_mean(part)).select("i", "window", "mae_channel", "recon_window")
        # the rebuilt window is not computed again for every channel and step
        assert "lambdafunction" not in r._jdf.queryExecution().optimizedPlan().toString()
        for i, w, mae, recon in r.collect():
            if w is None:
                assert mae is None and recon is None
                continue
            x = np.array(w)
            assert np.allclose(recon, np.tile(x.mean(axis=0), (len(x), 1))) and np.allclose(mae, np.abs(x - x.mean(axis=0)).mean(axis=0))
    assert RC.window_mae_channel(RC.window_mean(df.limit(0))).agg(F.count("mae_channel")).first()[0] == 0
