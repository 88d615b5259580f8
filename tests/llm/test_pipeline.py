import corpus_pipeline as P
from loomgraph.llm.secrets import redact
from loomgraph.session import written
from loomgraph.sources.tables import table
from tests.llm.docs import SCHEMA, awkward, prose
from tests.llm.test_line_dedup import brute as lines_brute
from tests.llm.test_ngram_join import brute as join_brute
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    kept = written(P.language(spark, docs, SF), "t1")
    assert kept.columns == docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) >= 0.95 * len(before) and all(before[i] == t for i, t in rows)  # clean prose stays, unchanged

    cleaned = written(P.lines(spark, kept, SF), "t2")
    want = [(i, t) for i, t in lines_brute(rows) if t.strip() or t == dict(rows)[i]]
    assert cleaned.columns == docs.columns and sorted((r.doc_id, r.text) for r in cleaned.collect()) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in cleaned.collect())

    unique = written(P.near_duplicates(spark, cleaned, SF), "t3")
    stay = {r[0] for r in join_brute(want) if r[0] == r[2]}
    assert unique.columns == docs.columns and sorted((r.doc_id, r.text) for r in unique.collect()) == sorted(w for w in want if w[0] in stay)

    masked = written(P.credentials(spark, unique, SF), "t4")
    assert masked.columns == docs.columns and masked.count() == unique.count()
    assert sorted(masked.select("doc_id", "text").collect()) == sorted(redact(unique).select("doc_id", "text").collect())

    check(P.pack(spark, masked, SF).collect(), {r.doc_id: r.text for r in masked.collect()})


def test_run(spark):
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "secret_scans", "packing"]
    assert P.run(spark, SF).count() > 0 and P.ORACLE_SQL is None


def test_stages_on_awkward_rows(spark):
    """Null, empty and long texts, repeated rows, several texts of an id, null ids, names that clash; then empty tables."""
    key = "token = f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    more = [(9, f"other text of the same id with {key}", "en", "s1", 1), (None, f"no id either but {key}", "en", "s1", 1), (None, "quite another text without any secret", "en", "s2", 1)]
    names = ["id", "tag", "cuts", "row", "group", "KEY", "doc", "gone", "n_lines", "n_dropped", "__id", "__gone", "__doc", "score", "start", "_q"]
    df = spark.createDataFrame(awkward() * 2 + more + prose(20), SCHEMA).selectExpr("*", *[f"{i} as `{n}`" for i, n in enumerate(names)]).repartition(3)
    docs = df
    for name, stage in P.STAGES[:-1]:
        for empty in (stage(spark, df.limit(0), SF),):
            assert empty.columns == df.columns and empty.count() == 0
        before = {(r.doc_id, r.text) for r in docs.collect()}
        docs = written(stage(spark, docs, SF), f"awkward-{name}")
        after = [(r.doc_id, r.text) for r in docs.collect()]
        assert docs.columns == df.columns and all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None and name in ("line_dedup", "secret_scans"))
        if name == "language_id":
            assert (5, None) not in after and (6, "") not in after and set(after) <= before
        elif name == "ngram_jaccard_join":
            assert len(after) == len(set(after)) and set(after) <= before and {r[1] for r in more} <= {t for _, t in after}
        elif name == "secret_scans":
            assert len(after) == len(before) and not any("f33e61083" in t for _, t in after) and (None, more[2][1]) in after
    last = P.STAGES[-1][1]
    assert {r.doc_id for r in last(spark, docs, SF).collect()} == {r.doc_id for r in docs.collect()} and last(spark, df.limit(0), SF).count() == 0
