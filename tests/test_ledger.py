"""Credits that add up to the amount, against DuckDB's running sum."""

import random

import duckdb

from loomgraph.plans import catalogue


def test_consume_where_credits_reach_the_amount(spark, tmp_path):
    r, rows = random.Random(1), []
    for user in range(1500):
        left, cents = 50000, []
        while left:
            cents.append(min(left, r.randint(1, 20000)))
            left -= cents[-1]
        for c in (*cents, r.randint(2000, 20000), 1234):
            rows.append(f"({len(rows)}, {user}, {c} / 100.0)")
    con = duckdb.connect()
    values = ", ".join([*rows, f"({len(rows)}, 0, NULL)"])
    con.execute(f"CREATE TABLE events AS SELECT e::BIGINT AS event_id, u::BIGINT AS user_id, v::DOUBLE AS value, 'view' AS event_type, TIMESTAMP '2024-01-01' + to_seconds(e) AS ts FROM (VALUES {values}) AS t(e, u, v)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = con.execute(catalogue.ORACLES["ledger_consume"]).fetchall()
    assert sorted(map(tuple, catalogue.QUERIES["ledger_consume"](spark, str(tmp_path)).collect())) == sorted(want)
    assert any(used == 0 for _, _, used in want)  # a remainder in the last bit still counts, as in the SQL
