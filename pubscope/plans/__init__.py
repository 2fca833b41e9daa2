"""Query plans: the registered queries and their SQL."""

from pubscope.plans import landed, problems, register, register_sql

QUERIES = {**problems.QUERIES, **register.QUERIES, **landed.QUERIES}
ORACLES = {**problems.ORACLES, **register_sql.ORACLES, **landed.ORACLES}
