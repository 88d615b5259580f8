"""Procedures that SQL calls as table functions over a user's own views: vector query, neighbourhood, merge of nodes.

Each is a function whose body is SQL, so a call is inlined into the caller's
plan and optimised with it; no Python runs. Names of views and columns are
quoted, and arguments are values, never text.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def quoted(name: str) -> str:
    """A name of up to three parts, quoted."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def _types(spark: SparkSession, view: str, *columns: str) -> list[str]:
    fields = spark.table(view).schema
    return [fields[c].dataType.simpleString() for c in columns]


def register_vector_query(spark: SparkSession, name: str, view: str, row_id: str, vector: str) -> None:
    """``SELECT row_id, score, rank FROM name(query, k)``: the ``k`` nearest rows by cosine, as ``retrieval.nearest`` scores them, ties to the smaller id.

    Null vectors and those of another length take no part; each task keeps its
    ``k`` best before they meet.
    """
    (kind,) = _types(spark, view, row_id)
    me, table, i, v = map(quoted, (name, view, row_id, vector))
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (p, q) -> CAST(p AS DOUBLE) * CAST(q AS DOUBLE)), 0D, (s, p) -> s + p)"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {me}(query ARRAY<DOUBLE>, k INT) RETURNS TABLE({i} {kind}, score DOUBLE, rank INT)
RETURN SELECT id, score, rank FROM (
  SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
    SELECT {i} AS id, CASE WHEN size = 0 THEN 0D ELSE round(greatest(0D, least(1D, product / size)), 6) END AS score FROM (
      SELECT t.{i}, {dot(f"t.{v}", f"{me}.query")} AS product, sqrt({dot(f"t.{v}", f"t.{v}")} * {dot(f"{me}.query", f"{me}.query")}) AS size
      FROM {table} t WHERE size(t.{v}) = size({me}.query)))) WHERE rank <= {me}.k""")


def register_neighbours(spark: SparkSession, name: str, view: str, src: str, dst: str, most_hops: int = 4) -> None:
    """``SELECT node, hops FROM name(start, hops)``: nodes that ``start`` reaches in up to ``hops`` steps, no more than ``most_hops``, with the fewest steps; each level holds a node once, so dense graphs don't multiply."""
    (kind,) = _types(spark, view, src)
    me, table, a, b = map(quoted, (name, view, src, dst))
    levels = [f"l0 AS (SELECT {me}.start AS node, 0 AS hops)"]
    levels += [f"l{n} AS (SELECT DISTINCT e.{b} AS node, {n} AS hops FROM l{n - 1} JOIN {table} e ON e.{a} = l{n - 1}.node WHERE {n} <= {me}.hops AND e.{b} IS NOT NULL)" for n in range(1, most_hops + 1)]
    every = " UNION ALL ".join(f"SELECT node, hops FROM l{n}" for n in range(most_hops + 1))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {me}(start {kind}, hops INT) RETURNS TABLE(node {kind}, hops INT) RETURN WITH {', '.join(levels)} SELECT node, min(hops) FROM ({every}) GROUP BY node")


def register_merge(spark: SparkSession, name: str, view: str, src: str, dst: str) -> None:
    """``SELECT src, dst FROM name(keep, gone)``: the edges after the nodes ``gone`` have become ``keep``: re-pointed, without self loops that this makes, each once."""
    (kind,) = _types(spark, view, src)
    me, table, a, b = map(quoted, (name, view, src, dst))
    to = lambda c: f"CASE WHEN array_contains({me}.gone, e.{c}) THEN {me}.keep ELSE e.{c} END"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {me}(keep {kind}, gone ARRAY<{kind}>) RETURNS TABLE({a} {kind}, {b} {kind})
RETURN SELECT DISTINCT a, b FROM (SELECT {to(a)} AS a, {to(b)} AS b, e.{a} = e.{b} AS own FROM {table} e) WHERE own OR a <> b""")
