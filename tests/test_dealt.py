"""Tasks grow in number, not in size: plans over large tables deal their rows to as many tasks as the rows ask for."""

import re

import pytest

from loomgraph import session
from loomgraph.operators import changes, network, statute
from loomgraph.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tasks(df):
    return max(map(int, re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", plan(df))), default=0)


@pytest.mark.parametrize("name", ["unit_next_edges", "community_projection", "statute_units", "statute_contents", "statute_unit_edges"])
def test_tasks_follow_the_rows(spark, monkeypatch, name):
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    assert tasks(catalogue.QUERIES[name](spark, SF)) > 40


def test_components_deal_their_edges(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(network, "dealt", lambda df, rows, *keys: seen.append((rows, keys)) or df)
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    assert {tuple(r) for r in network.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)}
    assert (6, ("a", "b")) in seen and (6, ("b",)) in seen


def test_unit_edges_read_the_units_once(spark):
    units = spark.createDataFrame([("d", "JO", "d::1", "d", 1), ("d", "JO", "d::2", "d", 2), ("d", "HO", "d::1::a", "d::1", 1)], "doc string, unit_type string, full_id string, parent_id string, ord int")
    df = statute.unit_edges(units)
    assert plan(df).count("Scan ExistingRDD") == 1
    assert {tuple(r) for r in df.collect()} == {("d", "d::1", "CONTAINS", 1), ("d", "d::2", "CONTAINS", 2), ("d::1", "d::1::a", "CONTAINS", 1), ("d::1", "d::2", "NEXT", 1)}


def test_decisions_are_joined_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(changes, "written", lambda df, name: names.append(name) or session.written(df, name), raising=False)
    catalogue.QUERIES["provenance_graph"](spark, SF)
    assert names == ["made", "brought"]
