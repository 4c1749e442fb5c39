"""All queries of the core and the SQL of those that SQL can express."""

from __future__ import annotations

from graphloom.plans import graph_oracles, graph_queries, layout_queries, level_oracles, problem_oracles, problems

QUERIES = {**graph_queries.QUERIES, **layout_queries.QUERIES, **problems.QUERIES}
ORACLES = {**graph_oracles.ORACLES, **level_oracles.ORACLES, **problem_oracles.ORACLES}
