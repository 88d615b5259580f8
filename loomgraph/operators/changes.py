"""Changes of stored tables: partial updates, counters, clean-up of levels, reclassified edges, tracked nodes and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import written

# Pairs of unit types whose edge tells structure.
STRUCTURE = (("LAW", "JANG"), ("LAW", "JO"), ("JANG", "JEOL"), ("JANG", "JO"), ("JEOL", "JO"), ("JO", "HANG"), ("HANG", "HO"), ("HO", "MOK"))


def partial_update(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the values of ``changes`` that aren't empty: null and the empty string leave what is there, and unknown keys do nothing.

    ``changes`` holds some of the other columns, one row a key.
    """
    given = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in given])
    types = dict(rows.dtypes)

    def value(c: str) -> Column:
        fresh = F.col(f"_new_{c}")
        return F.coalesce(F.nullif(fresh, F.lit("")) if types[c] == "string" else fresh, F.col(c)).alias(c)

    return rows.join(new, key, "left").select(*[value(c) if c in given else F.col(c) for c in rows.columns])


def bump_counters(counters: DataFrame, actions: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """``counters(key, *names)`` after all of ``actions(key, action, value)``: each adds its value to the counter it names; new keys start at zero, unknown actions do nothing."""
    added = actions.select(key, *[F.when(F.col("action") == n, F.col("value")).otherwise(0).alias(n) for n in names])
    both = counters.select(key, *names).unionByName(added)
    return both.groupBy(key).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def live_communities(communities: DataFrame, members: DataFrame, parents: DataFrame, most_level: int) -> DataFrame:
    """``communities(id, level)`` without the empty ones, from the lowest level up.

    At level 0 a community needs a row of ``members(id)``, above it a living
    child in ``parents(child, id)``; levels beyond ``most_level`` stay as they
    are. One semi-join a level.
    """
    alive = communities.filter("level = 0").join(members.select("id"), "id", "left_semi")
    out = alive
    for level in range(1, most_level + 1):
        fed = parents.join(alive.select(F.col("id").alias("child")), "child", "left_semi")
        alive = communities.filter(F.col("level") == level).join(fed.select("id"), "id", "left_semi")
        out = out.unionByName(alive)
    return out.unionByName(communities.filter(F.col("level") > most_level))


def reference_kind(from_label: Column, to_label: Column, context: Column, words: Sequence[str]) -> Column:
    """``STRUCTURAL`` for an edge between a unit and one of the next level whose context has none of the words, else ``SEMANTIC``."""
    nested, said = F.lit(False), F.lit(False)
    for a, b in STRUCTURE:
        nested = nested | ((from_label == a) & (to_label == b))
    for w in words:
        said = said | F.contains(F.coalesce(context, F.lit("")), F.lit(w))
    return F.when(F.coalesce(nested, F.lit(False)) & ~said, "STRUCTURAL").otherwise("SEMANTIC")


def conversation_graph(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, label`` and edges ``src, dst, type`` of ``turns(conv_id, turn)``: conversations, turns, HAS_TURN and NEXT."""
    conv = F.concat(F.lit("c"), F.col("conv_id"))
    turn = F.concat(conv, F.lit(":"), F.col("turn"))
    each = turns.select("conv_id", "turn").distinct()
    nodes = each.select(conv.alias("id")).distinct().withColumn("label", F.lit("Conversation")).unionByName(each.select(turn.alias("id"), F.lit("Turn").alias("label")))
    has = each.select(conv.alias("src"), turn.alias("dst"), F.lit("HAS_TURN").alias("type"))
    after = each.select(turn.alias("src"), F.lead(turn).over(Window.partitionBy("conv_id").orderBy("turn")).alias("dst"), F.lit("NEXT").alias("type")).filter("dst IS NOT NULL")
    return nodes, has.unionByName(after)


def provenance_graph(turns: DataFrame, agents: DataFrame, executions: DataFrame, decisions: DataFrame, support: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, label`` and edges ``src, dst, type, weight`` of what was decided, on what grounds, and what came of it.

    ``decisions(id, turn, agent, execution)`` are made where their turn and agent
    are known, and their execution is or is null. ``support(decision, evidence,
    weight)`` brings an evidence node and, for a decision that is made, an edge;
    ``artifacts(id, turn, execution, decision)`` are made, by turn and execution,
    under the same terms as decisions. ``turns``, ``agents`` and ``executions`` are single columns of ids.
    Repeated rows give one node and one edge; null ids give none.
    """
    def known(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
        return rows.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")

    def edge(rows: DataFrame, src: str, dst: str, kind: str, weight: str | None = None) -> DataFrame:
        w = F.col(weight) if weight else F.lit(None)
        return rows.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), w.cast("double").alias("weight"))

    def placed(rows: DataFrame, *columns: str) -> DataFrame:
        rows = known(rows.filter("id IS NOT NULL"), "turn", turns).select(*columns)
        return rows.filter("execution IS NULL").unionByName(known(rows, "execution", executions).select(*columns))

    # nodes and edges of seven kinds come from these, so they are joined once
    made = written(placed(known(decisions, "agent", agents), "id", "turn", "agent", "execution"), "made")
    brought = written(placed(artifacts, "id", "turn", "execution", "decision"), "brought")
    nodes = made.select("id", F.lit("Decision").alias("label")).unionByName(support.filter("evidence IS NOT NULL").select(F.col("evidence").alias("id"), F.lit("Evidence").alias("label")))
    nodes = nodes.unionByName(brought.select("id", F.lit("Artifact").alias("label")))
    parts = [
        edge(made, "turn", "id", "HAS_DECISION"), edge(made, "id", "agent", "MADE_BY"), edge(made, "execution", "id", "MADE_DECISION"),
        edge(known(support, "decision", made.select("id")), "decision", "evidence", "SUPPORTED_BY", "weight"),
        edge(brought, "turn", "id", "PRODUCED"), edge(brought, "execution", "id", "PRODUCED"), edge(known(brought, "decision", made.select("id")), "decision", "id", "RESULTED_IN"),
    ]
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    return nodes.distinct(), edges.distinct()


def worst_by_type(violations: DataFrame, by: Sequence[str], rank: str, top: int) -> DataFrame:
    """Of the first ``top`` designs of each group the worst violation of each ``type``; of equals that of the earlier design."""
    found = violations.filter(F.col(rank) <= top)
    worst = found.groupBy(*by, "type").agg(F.max_by(F.struct(rank, "value", "severity"), F.struct("severity", -F.col(rank), "value")).alias("w"))
    return worst.select(*by, "type", "w.*")


def transcript_pages(captions: DataFrame, seconds: int = 60) -> DataFrame:
    """``video, page, text, started, ended`` (in seconds) of ``captions(video, seq, start, text)``, in order of ``start``.

    A page is closed by the first caption that starts at or after its end and
    holds that caption; the next page ends ``seconds`` later, so a gap closes
    one page a caption. What comes after the last closing caption is a page of
    its own, even if nothing does. With ``f`` the whole periods before a
    caption's start, ``min(f, closed before + 1)`` pages are closed by it: the
    running minimum of ``f - position``, so no row waits for the state of another.
    """
    w = Window.partitionBy("video").orderBy("start", "seq")
    c = captions.withColumn("nth", F.row_number().over(w))
    lag = F.min(F.floor(F.col("start") / seconds) - F.col("nth")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("closed", F.col("nth") + F.least(F.lit(0), lag))
    c = c.withColumns({"page": F.lag("closed", 1, 0).over(w), "last": F.lead("nth").over(w).isNull()})
    row = lambda page, text: F.struct(page.cast("long").alias("page"), F.struct("nth", text.alias("text")).alias("part"), F.col("start").alias("at"))
    own = row(F.col("page"), F.coalesce("text", F.lit("")))
    rows = c.select("video", F.inline(F.when(F.col("last") & (F.col("closed") > F.col("page")), F.array(own, row(F.col("closed"), F.lit("")))).otherwise(F.array(own))))
    said = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["text"]), " ")
    return rows.groupBy("video", "page").agg(F.trim(said).alias("text"), F.max("at").alias("ended")).withColumn("started", F.col("page") * seconds)


def match_sequences(intent: Column, sequences: Sequence[tuple[str, Sequence[str], Sequence[str]]], terms: Sequence[tuple[Sequence[str], Sequence[str]]], top: int = 3) -> Column:
    """``array<struct<sequence, score>>``: the best of ``sequences`` (name, aliases, verbs) for an intent in words, the earlier of equals first.

    An alias within the intent counts three, else one for each word it shares;
    each verb of the sequence that a term (names, verbs) of the intent stands
    for counts two. Sequences without a point are left out; null has none.
    """
    said = F.lower(F.trim(F.regexp_replace(intent, "\\s+", " ")))
    words = F.array_distinct(F.concat(F.regexp_extract_all(said, F.lit("([a-z0-9_]+|[가-힣]+)"), F.lit(1)), F.array(said)))
    any_of = lambda names: F.greatest(*[F.contains(said, F.lit(n.lower())) for n in names], F.lit(False))
    verbs = F.array_distinct(F.flatten(F.array(*[F.when(any_of(names), F.array(*map(F.lit, vs))).otherwise(F.array().cast("array<string>")) for names, vs in terms])))

    def score(aliases: Sequence[str], own: Sequence[str]) -> Column:
        total = 2 * F.size(F.array_intersect(verbs, F.array(*map(F.lit, sorted(set(own))))))
        for a in (x.lower() for x in aliases):
            parts = F.array_distinct(F.concat(F.regexp_extract_all(F.lit(a), F.lit("([a-z0-9_]+|[가-힣]+)"), F.lit(1)), F.array(F.lit(a))))
            total = total + F.when(F.contains(said, F.lit(a)), 3).otherwise(F.size(F.array_intersect(words, parts)))
        return total

    each = F.array(*[F.struct((-score(aliases, own)).alias("low"), F.lit(i).alias("nth"), F.lit(name).alias("sequence")) for i, (name, aliases, own) in enumerate(sequences)])
    best = F.slice(F.array_sort(F.filter(each, lambda x: x["low"] < 0)), 1, top)
    return F.when(intent.isNotNull(), F.transform(best, lambda x: F.struct(x["sequence"].alias("sequence"), (-x["low"]).alias("score"))))
