import hashlib

from loomgraph.llm.exact_dedup import drop_duplicates, exact_dedup
from tests.llm.docs import SCHEMA, awkward, prose

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    dig = [hashlib.sha256((r[1] or "").translate(TABLE).encode()).hexdigest() for r in rows]
    groups = {}
    for r, d in zip(rows, dig):
        groups.setdefault(d, []).append(r[0])
    out = []
    for r, d in zip(rows, dig):
        ids = [i for i in groups[d] if i is not None]
        keep = max(ids) if ids else None
        out.append((r[0], keep, len(groups[d]), r[0] == keep, d))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    hot = [(10_000 + i, "Same TEXT" if i % 2 else "same text", "en", "hot", 9) for i in range(200)]
    rows = awkward() + prose() + hot
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as keep_id", "'x' as text_sha256", "2 as group_size")
    for least in (2, 1000):
        got = exact_dedup(df, least=least).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_drop_and_empty(spark):
    df = spark.createDataFrame(prose(), SCHEMA)
    assert drop_duplicates(df).select("text").distinct().count() == drop_duplicates(df).count() == df.select("text").distinct().count()
    assert exact_dedup(df.limit(0)).count() == 0


def test_drop_tells_rows_apart_by_id_and_text(spark):
    rows = [(5, "A"), (9, "a"), (5, "B"), (5, "B"), (None, "B"), (None, None), (None, ""), (None, "c"), (None, "C")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as SHA", "3 as gone_id", "true as kept")
    got = drop_duplicates(df)
    assert got.columns == df.columns
    out = got.collect()
    assert len(out) == 4 and {(r.doc_id, (r.text or "").lower()) for r in out} == {(9, "a"), (5, "b"), (None, ""), (None, "c")}
    assert drop_duplicates(df.limit(0)).count() == 0
