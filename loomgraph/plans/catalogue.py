"""Every query of the reference's own operators, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans import evaluation, graph, ledger, relational, retrieval, rules, sites, streams, text, tracking

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _m in (retrieval, graph, text, rules, sites, relational, ledger, evaluation, streams, tracking):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
