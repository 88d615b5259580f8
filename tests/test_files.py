import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import registries as R
from loomgraph.sources import files


def test_text_files_in_several_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo".encode())
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbf" + "naïve".encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe" + "wide".encode("utf-16-le"))
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    got = {r.file_name: r.text for r in files.text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "héllo", "b.txt": "naïve", "c.txt": "café", "d.txt": "wide"}
    assert [r.length for r in files.objects(spark, str(tmp_path), "*.pdf").collect()] == [4]


def test_statute_xml(spark, tmp_path):
    item = "<조문단위><조문번호>{}</조문번호><조문제목>{}</조문제목><조문내용>{}</조문내용></조문단위>"
    body = item.format("1", "", "제1장 총칙") + item.format("4", "위원회", "제4조의2(위원회) 둔다.") + item.format("", "x", "none")
    (tmp_path / "law.xml").write_text(f"<법령><조문>{body}</조문></법령>", encoding="utf-8")
    got = files.statute_xml(spark, str(tmp_path / "law.xml")).orderBy("seq").collect()
    assert [(r.law, r.number, r.content) for r in got] == [("law", "1조", "제1장 총칙"), ("law", "4조의2", "제4조의2(위원회) 둔다.")]


def test_units_round_trip(spark, tmp_path):
    rows = [("A", "조", "1조", "t", "c", "제1조", "A::제1조", "A", 1, ["2020. 1. 1."]), ("A", "조", "2조", None, "d", "제2조", "A::제2조", "A", 2, [])]
    units = spark.createDataFrame(rows, "law_name string, " + files.UNITS)
    files.write_units(units, str(tmp_path / "u"))
    back = files.read_units(spark, str(tmp_path / "u"))
    assert sorted(map(str, back.select(*units.columns).collect())) == sorted(map(str, units.collect()))


def test_rules_with_defaults_and_missing_keys(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"src": "decree", "rules": [{"id": "a", "n": 2}, {"id": "b"}]}))
    (tmp_path / "bad.json").write_text(json.dumps({"rules": [{"id": "a"}]}))
    got = files.read_rules(spark, str(tmp_path / "r.json"), "src", "rules", "id string, n int", {"n": 7})
    assert sorted(map(tuple, got.collect())) == [("a", 2), ("b", 7)]
    with pytest.raises(Exception, match="missing key src"):
        files.read_rules(spark, str(tmp_path / "bad.json"), "src", "rules", "id string", {}).collect()


def test_sinks(spark, tmp_path):
    qa = spark.createDataFrame([("q", "a")], "q string, a string")
    files.write_jsonl(files.messages(qa, "s", "q", "a"), str(tmp_path / "j"))
    (line,) = [json.loads(x) for part in (tmp_path / "j").glob("part-*") for x in part.read_text().splitlines()]  # empty partitions leave empty files
    assert [(m["role"], m["content"]) for m in line["messages"]] == [("system", "s"), ("user", "q"), ("assistant", "a")]
    files.write_report(qa, str(tmp_path / "r"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "r/csv")).columns == ["q", "a"]
    assert files.append_results(qa, str(tmp_path / "t")) == 1 and files.append_results(qa, str(tmp_path / "t")) == 1
    assert files.load_corpus(spark, str(tmp_path / "t")).count() == 2
    assert files.append_results(qa.withColumn("q", F.raise_error(F.lit("no")).cast("string")), str(tmp_path / "t")) == 0
    assert files.web_pages(spark.createDataFrame([("https://x.org/a?b", "<p>hi <b>you</b></p>")], "url string, html string")).first()[1:] == ("x.org", "hi you")


def test_topic_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"topic": "t", "value": "v", "ts": "2024-01-01T00:00:00Z"}\n')
    stream = files.topic_files(spark, str(tmp_path / "in"))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("topic", "value").first()[:] == ("t", "v")


def test_registries(spark):
    df = spark.createDataFrame([(1, 0.5, None), (2, 0.0, 3.0)], "id int, setback double, corner double")
    e = R.Evaluators("basic", lambda d: d.withColumn("m", F.lit(0)))
    e.register("double", lambda d: d.withColumn("m", F.col("id") * 2))
    assert e.get("double")(df).select("m").collect()[1][0] == 4 and e.get("unknown") is e.get()
    specs = [R.Regulation("adjacent", "setback > 0", "none"), R.Regulation("corner", "true", "", "corner > 0", "no corner")]
    got = sorted(map(tuple, R.regulation_status(df, specs, "id").collect()))
    assert got == [(1, "adjacent", "applies", ""), (1, "corner", "not_found", "no corner"), (2, "adjacent", "not_applicable", "none"), (2, "corner", "applies", "")]
    assert R.mode("nope") == R.MODES[R.DEFAULT_MODE] and len(R.MODES) == 7


def test_read_only(spark):
    spark.createDataFrame([(1, "a;b"), (2, "c")], "id int, name string").createOrReplaceTempView("notes")
    assert R.read_only(spark, " select 1 AS x; ").first().x == 1
    assert R.read_only(spark, "select count(*) as n from notes where name = 'a;b'").first().n == 1
    good = "with t as (select id, upper(name) as u from notes), v as (select * from t) select u, row_number() over (order by id) as r from v where id in (select max(id) from notes) group by u, id having count(*) > 0 order by u limit 3"
    assert R.read_only(spark, good).first().u == "C"
    bad = [
        "DROP TABLE t", "select 1; drop table t", "", "selection", None, "select java_method('java.lang.System', 'getProperty', 'user.name')", "select reflect('java.lang.System', 'getProperty', 'user.name')",
        "select * from parquet.`/root/testdata/sf0.001/orders.parquet`", "select * from text.`/etc/passwd`", "with t as (select * from csv.`/etc/passwd`) select * from t", "select (select max(value) from text.`/etc/passwd`)",
        "select * from range(10)", "insert into notes select 1, 'x'", "select transform(id) using 'cat' from notes", "select * from other", "show tables", "create table x as select 1", "set a=b", "explain select 1",
        "select * from notes where exists (select java_method('java.lang.System', 'exit', 0))", "select id from notes lateral view explode(array(1)) t as x", "select * from read_files('/etc/passwd')", "select version()",
        "select * from notes, lateral (select try_reflect('java.lang.System', 'getProperty', 'user.name'))", "select * from identifier('notes')", "select call_function('java_method', 'a', 'b')",
    ]
    for sql in bad:
        with pytest.raises(ValueError):
            R.read_only(spark, sql)
    assert pytest.raises(ValueError, R.read_only, spark, "select * from notes", ("orders",))


def test_pages_of_any_length(spark):
    page = "<html><style>p { x: 1 }</style><SCRIPT type='a'>" + "if(a<b)x;" * 20_000 + "</script ><p>kept &amp; <b>bold</b></p>" + "<i>x</i>" * 20_000 + "<script>open"
    out = files.web_pages(spark.createDataFrame([("https://x.org/", page), ("https://y.org/", None)], "url string, html string")).collect()
    assert out[0].text.startswith("kept &amp; bold x x") and "if(a" not in out[0].text and out[1].text is None
