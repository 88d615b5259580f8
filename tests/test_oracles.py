"""Every query with an oracle gives DuckDB's rows on the same tables."""

import math

import duckdb
import pytest

from loomgraph.plans import catalogue
from loomgraph.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}" if float(v) != int(v) else str(int(v))
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([plain(r[i]) for i in order] for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows(got.columns, map(tuple, got.collect())), rows(names, want.fetchall())
    assert len(a) == len(b) and a == b


def test_the_rest_has_a_brute_force_test():
    from tests import test_brute, test_pareto, test_sites, test_timers, test_tracking, test_vector_index

    tested = {name for m in (test_brute, test_pareto, test_sites, test_timers, test_tracking, test_vector_index) for name in m.QUERIES}
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == tested
