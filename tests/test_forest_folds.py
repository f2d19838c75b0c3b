"""Cross-validated forests: every (tree, row) pair moves once, whatever the number of folds and sample sizes."""

import random

import vigil.session as session
from vigil.operators import forest as FR
from vigil.operators import search as H

COMBOS = [{"n_trees": t, "max_samples": m, "max_features": f, "contamination": 0.1} for t in (3, 7) for m in (0.2, 0.5) for f in (0.5, 1.0)]


def test_folds_share_one_draw_and_both_ways_agree(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i % 150, i % 3, int(i % 11 == 0), rng.gauss(3 * (i % 11 == 0), 1), round(rng.gauss(0, 1), 1), 5.0) for i in range(450)]
    df = spark.createDataFrame(rows, "rid long, fold int, is_anomaly int, a double, b double, c double").repartition(4)
    written, keep = [], session.materialize
    monkeypatch.setattr(session, "materialize", lambda d, name: written.append(name) or keep(d, name))

    def ask():
        return sorted((r["n_trees"], r["max_samples"], r["max_features"], round(r["mean_auroc"], 9))
                      for r in H.forest_cv(df, ["rid"], ["a", "b", "c"], COMBOS).collect())
    got = ask()
    assert "cv-drawn" not in written and "cv-nodes" not in written      # once per fold and sample size before
    monkeypatch.setattr(FR, "TREE_ROWS", 0)
    assert ask() == got and len(got) == len(COMBOS) and "cv-nodes" in written
