"""Registered queries (one per SURVEY §2 operator) and their DuckDB oracles.

Every query reads the driver tables (or what Spark derives from them) in
full; doubles are rounded to 6 digits on both sides for the comparison.
The query modules register themselves on import, in this order.
"""

from vigil.plans import q_core, q_prep, q_detect, q_eval  # noqa: F401
from vigil.plans.base import ORACLES, QUERIES, finish, query, r6  # noqa: F401
