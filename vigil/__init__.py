"""vigil — labelled time-series anomaly detection and evaluation on Spark.

Entry points:
  build_session / configure      session settings the engine relies on
  dataset                        logical dataset name -> (DataFrame, SeriesSpec)
  run_job                        config dict -> (flagged rows, leaderboard row)
Operators live in ``vigil.operators`` (DataFrame -> DataFrame functions).
"""

from vigil.plans.jobs import run_job
from vigil.session import build_session, configure
from vigil.sources.catalog import dataset

__all__ = ["build_session", "configure", "dataset", "run_job"]
