"""Joins of streams, and state with timers, over several micro-batches."""

from collections import defaultdict

from pyspark.sql import functions as F

from loomgraph.plans import catalogue
from loomgraph.streaming import events as S
from loomgraph.streaming import joins, timers
from tests.test_streams import stream

QUERIES = ("token_limit_waits",)
SF = "/root/testdata/sf0.001"
MINUTE, DAY = 60, 86_400  # a row at the epoch itself is behind the first watermark


def test_interval_join_with_late_and_unmatched_rows(spark, tmp_path):
    """Left and right rows of a batch share a file; the watermark runs ten minutes behind the slower side."""
    left = [[(1, 1, 0), (1, 2, 50)], [(1, 3, 100), (2, 9, 100)], [(1, 4, 10), (1, 5, 200)], [(1, 6, 400)], [(1, 7, 900)]]
    right = [[(1, 11, 20), (1, 12, 70)], [(1, 13, 115), (3, 19, 100)], [(1, 14, 12), (1, 15, 231)], [(1, 16, 430)], [(1, 17, 900)]]
    batches = [[(u, i, "l", DAY + m * MINUTE) for u, i, m in a] + [(u, i, "r", DAY + m * MINUTE) for u, i, m in b] for a, b in zip(left, right)]

    def side(kind, name, ts):
        return stream(spark, tmp_path / kind, [[r for r in b if r[2] == kind] for b in batches]).select("user_id", F.col("event_id").alias(name), F.col("ts").alias(ts))

    joined = joins.interval_join(side("l", "a", "at"), side("r", "b", "bt"), "user_id", "at", "bt", "0 SECONDS", "30 MINUTES", "10 minutes", "fullOuter")
    got = {(r.user_id, r.a, r.b) for r in S.run_to_end(joined.select("user_id", "a", "b"), "append").collect()}
    pairs = {(1, 1, 11), (1, 2, 12), (1, 3, 13), (1, 6, 16), (1, 7, 17)}  # 5 and 15 are 31 minutes apart
    alone = {(2, 9, None), (3, None, 19), (1, 5, None), (1, None, 15)}
    # 4 and 14 come behind the watermark of the batch before (90 minutes) and are dropped
    assert pairs <= got and alone <= got and not any(4 in r or 14 in r for r in got) and got - pairs - alone <= {(1, 7, None), (1, None, 17)}


def test_transcripts_over_batches_equal_the_batch_twin(spark, tmp_path):
    rows = [(u, 10 * i + u, f"w{i}", DAY + 60 * (i * 2 + (i // 4) * 30 + (i // 7) * 28)) for i in range(24) for u in (1, 2)]
    rows += [(3, 900, " ", DAY + 100), (3, 901, "x", DAY + 200), (3, 902, "y", DAY + 200 + 1800), (9, 999, "end", 10**6)]
    rows.sort(key=lambda r: r[3])
    batches = [rows[:7], rows[7:8], rows[8:30], rows[30:]]
    s = timers.transcript_stream(stream(spark, tmp_path / "in", batches), "user_id", "ts", "event_id", "event_type", 1800, "1 second")
    got = timers.run_with_timers(s, S.run_to_end)
    every = spark.createDataFrame(rows, "user_id long, event_id long, event_type string, s long").select("user_id", "event_id", "event_type", F.timestamp_seconds("s").alias("ts")).filter("trim(event_type) <> '' and user_id < 9")
    want = S.sessions(every, "user_id", "ts", "event_id", "event_type", 1800)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.groupBy("user_id").count().filter("user_id = 1").first()["count"] > 4
    assert got.filter("user_id = 3").count() == 2  # a gap of the time-out itself flushes


def waits(rows, most, window):
    """Release times by trying every millisecond."""
    out, gone = {}, []
    for at, i, n in sorted(rows):
        t = max(at, gone[-1][0] if gone else at)
        while (inside := [x for x in gone if x[0] > t - window]) and sum(x[1] for x in inside) + n > most:
            t += 1
        gone.append((t, n))
        out[i] = t
    return out


def test_token_limiter_holds_and_releases(spark, tmp_path):
    rows = [(1, 1, 0, 60), (1, 2, 1, 30), (1, 3, 2, 30), (1, 4, 3, 5), (1, 5, 30, 200), (1, 6, 31, 10), (2, 7, 3, 90), (2, 8, 12, 20), (1, 9, 90, 1), (3, 10, 400, 1), (3, 11, 900, 1)]
    rows = [(u, i, DAY + s, n) for u, i, s, n in rows]
    want = {}
    for user in {r[0] for r in rows}:
        want |= waits([(s * 1000, i, n) for u, i, s, n in rows if u == user], 100, 10_000)
    batches = [[(u, i, str(n), s) for u, i, s, n in b] for b in (rows[:3], rows[3:8], rows[8:10], rows[10:])]
    s = stream(spark, tmp_path / "in", batches).withColumn("tokens", F.col("event_type").cast("int"))
    found = timers.run_with_timers(timers.token_limit_stream(s, "user_id", "ts", "event_id", "tokens", 100, 10, "0 seconds"), S.run_to_end)
    got = {r.id: r.released for r in found.collect()}
    assert got == want and any(got[i] > s * 1000 for _, i, s, _ in rows)
    batch = spark.createDataFrame(rows, "user_id long, event_id long, s long, tokens int").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.id: r.released for r in timers.token_limited(batch, "user_id", "ts", "event_id", "tokens", 100, 10).collect()} == want


def test_query_token_limit(spark):
    by_user = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "event_id", "unix_millis(cast(ts as timestamp)) as at", "ceil(value) as n").collect():
        by_user[r.user_id].append((r.at, r.event_id, r.n))
    want, window = {}, 6 * 3600 * 1000
    for rows in by_user.values():
        gone = []
        for at, i, n in sorted(rows):
            # the first moment, of its own and those at which another leaves the window, that has room
            for t in sorted({max(at, gone[-1][0] if gone else at), *(g + window for g, _ in gone)}):
                if t >= max(at, gone[-1][0] if gone else at) and (sum(m for g, m in gone if g > t - window) + n <= 300 or not any(g > t - window for g, _ in gone)):
                    break
            gone.append((t, n))
            want[i] = t - at
    got = {r.event_id: r.waited_ms for r in catalogue.QUERIES["token_limit_waits"](spark, SF).collect()}
    assert got == want


def test_a_batch_of_gaps_asks_the_state_once(spark):
    """However many buffers a micro-batch closes, they are one table, and the state is asked as often as for one."""
    import pandas as pd

    calls = []

    class State:
        def __init__(self, value):
            self.value = value

        def __getattr__(self, name):
            calls.append(name)
            return {"get": lambda: self.value, "exists": lambda: bool(self.value)}.get(name, lambda *a: iter(()))

    t = timers.Transcripts("user_id", 10)
    t.handle, t.parts, t.about = State(None), State([("a",), ("b",)]), State((3, 5))
    rows = pd.DataFrame({"at": [6, 20, 21, 40, 60], "seq": range(5), "text": list("cdefg")})
    got = list(t.handleInputRows((1,), iter([rows]), None))
    assert [list(map(tuple, g.itertuples(index=False))) for g in got] == [[(1, 3, 3, "a b c"), (1, 4, 2, "d e"), (1, 5, 1, "f")]]
    assert len(calls) <= 8
