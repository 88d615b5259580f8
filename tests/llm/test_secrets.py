import hashlib
import re

from loomgraph.llm.secrets import digest_rows, redact, secret_scan
from tests.llm.docs import SCHEMA, awkward, prose

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYS = {"assign": ASSIGN, "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
LEAST = {"assign": 0, "access": 20, "hex": 24}


def base(text):
    out = []
    for i, (kind, p) in enumerate(KEYS.items()):
        for m in p.finditer(text or ""):
            if len(m.group()) >= LEAST[kind] and (kind != "assign" or len(m.group(2)) >= 6):
                out.append((m.start(), i, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def rows():
    key = "AKIA" + "Q1" * 10
    live = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    extra = [
        (500, f'é😀 token = "{live}" then {key}! password: short pass PassWord="abc.def/ghi" {key}', "en", "s1", 1),
        (501, f"bare {key} and sEcReT:'abcdefgh' secret: \"token: abcdefgh", "en", "s2", 1),
        (502, f"{key} token=token=abcdefgh api_key='' apikey=:1234567", "en", "s3", 1),
        (503, "Zm9vYmFyMTIzNDU2Nzg5MHh5eg at start, deadbeef" + "0a" * 30 + "g AKIA AKIAA", "en", "s9", 1),
        (504, "Zm9vYmFyMTIzNDU2Nzg5MHh5eg", None, None, None),
        (505, "only ours: q9Zm9vYmFyMTIzNDU2Nzg5MHh5eg.", "de", "s9", 1),
    ]
    return awkward() + prose(20) + extra


def test_base_spans_match_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "'x' as kind", "1 as start", "'y' as value", "3 as row_id")
    got = digest_rows(secret_scan(df)).collect()
    assert len(got) == len(data)
    want = sorted(
        (str(r[0]), *[sum(s.startswith(k) for s in base(r[1])) for k in KEYS], hashlib.sha256(",".join(base(r[1])).encode()).hexdigest()) for r in data
    )
    assert sorted((str(g.doc_id), g.n_assign, g.n_access, g.n_hex, g.base_sha256) for g in got) == want


def test_ownership_adds_only_owner_specific_tokens(spark):
    got = {r.doc_id: r for r in digest_rows(secret_scan(spark.createDataFrame(rows(), SCHEMA))).collect()}
    assert "live" not in got[503].spans and "live" not in got[504].spans  # two owners hold it
    assert got[505].spans == "live:11:39" and got[505].n_live == 1
    assert got[500].n_example == 2 and got[500].n_live >= 1  # the access key is widely copied


def test_redact(spark):
    out = {r.doc_id: r.text for r in redact(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert "f33e61083" not in out[500] and out[500].startswith("é😀 [REDACTED]")
    assert out[505] == "only ours: [REDACTED]." and out[5] is None and len(out) == len({r[0] for r in rows()})
    assert out[503].startswith("Zm9vYmFyMTIzNDU2Nzg5MHh5eg")


def test_empty(spark):
    assert digest_rows(secret_scan(spark.createDataFrame([], SCHEMA))).count() == 0


def test_redact_null_and_repeated_ids(spark):
    keys = ["f33e61083db5dbdf4bd2369d2f80176e57f7fda2", "0badc0de83db5dbdf4bd2369d2f80176e57f7fd9"]
    for doc_id in (None, 7):
        data = [(doc_id, f"token = {keys[0]} end", "en", "s1", 1), (doc_id, f"a longer text before token = {keys[1]} end", "en", "s1", 1), (doc_id, "clean words that nobody may cut anywhere", "en", "s1", 1)]
        df = spark.createDataFrame(data + data[:1], SCHEMA).selectExpr("*", "1 as id", "2 as Tag", "3 as cuts", "4 as __cuts")
        assert redact(df).columns == df.columns and redact(df.limit(0)).count() == 0
        out = sorted(r.text for r in redact(df).collect())
        assert out == sorted(["[REDACTED] end"] * 2 + ["a longer text before [REDACTED] end", data[2][1]])


def test_frequent_values_are_judged_alike(spark):
    many = [(1000 + i, f"token = sharedExample1 and only q9Zm9vYmFyMTIzNDU2Nzg5MHh5eg, secret: xy{i % 3}", "en", f"s{i % 4 if i % 2 else 7}", 1) for i in range(60)]
    df = spark.createDataFrame(rows() + many + [(2000, "token: mineAlone77 token: mineAlone77", "en", "s1", 1)] * 40, SCHEMA)
    found = {h: sorted(map(str, digest_rows(secret_scan(df, heavy=h)).collect())) for h in (1, 10, 1 << 40)}  # no frequent values, some, all of them
    assert found[1] == found[10] == found[1 << 40] and any("n_live=2" in r for r in found[1] if "doc_id=2000" in r)
