"""Stored rows that change, what is tracked about agents, and matches of intents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import h_mm_ss
from loomgraph.operators import changes, network
from loomgraph.plans.registry import registry
from loomgraph.sources.tables import Tables

QUERIES, ORACLES, query = registry()


@query("""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'new ' || c_custkey END AS nm, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal * 2 END AS bal FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey, coalesce(nullif(nm, ''), c_name) AS c_name, c_nationkey, coalesce(bal, c_acctbal) AS c_acctbal, c_mktsegment FROM customer LEFT JOIN n USING (c_custkey)""")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after changes that hold empty fields."""
    c, k = Tables(spark, sf_dir).customer, F.col("c_custkey")
    new = c.filter(k % 2 == 0).select(k, F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("new "), k)).alias("c_name"), F.when(k % 5 == 0, F.col("c_acctbal") * 2).alias("c_acctbal"))
    return changes.partial_update(c.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), new, "c_custkey")


@query("""WITH x AS (SELECT user_id, event_type AS a, event_id % 4 AS v FROM events UNION ALL SELECT c_custkey, 'click', 10 FROM customer)
SELECT user_id, coalesce(sum(v) FILTER (WHERE a = 'click'), 0)::BIGINT AS click, coalesce(sum(v) FILTER (WHERE a = 'view'), 0)::BIGINT AS view FROM x GROUP BY 1""")
def action_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that customers start with, after all events of theirs and of others."""
    t = Tables(spark, sf_dir)
    before = t.customer.select(F.col("c_custkey").alias("user_id"), F.lit(10).cast("long").alias("click"), F.lit(0).cast("long").alias("view"))
    done = t.events.select("user_id", F.col("event_type").alias("action"), (F.col("event_id") % 4).alias("value"))
    return changes.bump_counters(before, done, "user_id", ("click", "view"))


@query("""WITH c0 AS (SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 AND l_discount > 0.08)),
c1 AS (SELECT DISTINCT id % 97 AS id FROM c0 WHERE id % 3 = 0), c2 AS (SELECT DISTINCT id % 13 AS id FROM c1 WHERE id % 2 = 0)
SELECT id, 0 AS level FROM c0 UNION ALL SELECT 100000000 + id, 1 FROM c1 UNION ALL SELECT 200000000 + id, 2 FROM c2 UNION ALL SELECT 300000000, 3""")
def live_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of parts on three levels without the empty ones; a level beyond the last one cleaned stays."""
    t, k = Tables(spark, sf_dir), F.col("p_partkey")
    low = t.part.select(k.alias("id"), F.lit(0).alias("level"))
    above = spark.range(97).select((100000000 + F.col("id")).alias("id"), F.lit(1).alias("level")).unionByName(spark.range(13).select((200000000 + F.col("id")).alias("id"), F.lit(2).alias("level")))
    every = low.unionByName(above).unionByName(spark.range(1).select((300000000 + F.col("id")).alias("id"), F.lit(3).alias("level")))
    members = t.lineitem.filter("l_quantity > 45 AND l_discount > 0.08").select(F.col("l_partkey").alias("id"))
    up = t.part.filter(k % 3 == 0).select(k.alias("child"), (100000000 + k % 97).alias("id"))
    top = spark.range(97).filter("id % 2 = 0").select((100000000 + F.col("id")).alias("child"), (200000000 + F.col("id") % 13).alias("id"))
    return changes.live_communities(every, members, up.unionByName(top), 2)


_LABELS = "['LAW', 'JANG', 'JEOL', 'JO', 'HANG', 'HO', 'MOK']"


@query(f"""WITH e AS (SELECT p_partkey, {_LABELS}[p_partkey % 7 + 1] AS a, {_LABELS}[p_size % 7 + 1] AS b, CASE WHEN p_partkey % 9 > 0 THEN p_name END AS context FROM part)
SELECT p_partkey, CASE WHEN a || '>' || b IN ('LAW>JANG', 'LAW>JO', 'JANG>JEOL', 'JANG>JO', 'JEOL>JO', 'JO>HANG', 'HANG>HO', 'HO>MOK') AND NOT contains(coalesce(context, ''), 'red') AND NOT contains(coalesce(context, ''), 'o') THEN 'STRUCTURAL' ELSE 'SEMANTIC' END AS kind FROM e""")
def reference_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between units that tell structure and edges that tell a reference."""
    k = F.col("p_partkey")
    labels = F.array(*map(F.lit, ("LAW", "JANG", "JEOL", "JO", "HANG", "HO", "MOK")))
    of = lambda c: F.element_at(labels, (c % 7 + 1).cast("int"))
    return Tables(spark, sf_dir).part.select("p_partkey", changes.reference_kind(of(k), of(F.col("p_size")), F.when(k % 9 > 0, F.col("p_name")), ("red", "o")).alias("kind"))


@query("""WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), e AS (SELECT 'c' || conv_id AS src, 'c' || conv_id || ':' || turn AS dst, 'HAS_TURN' AS type FROM t
UNION ALL SELECT 'c' || conv_id || ':' || turn, 'c' || conv_id || ':' || lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), 'NEXT' FROM t),
n AS (SELECT DISTINCT 'c' || conv_id AS id, 'Conversation' AS label FROM t UNION ALL SELECT 'c' || conv_id || ':' || turn, 'Turn' FROM t)
SELECT type AS kind, src AS id, dst FROM e WHERE dst IS NOT NULL UNION ALL SELECT label, id, NULL FROM n""")
def conversation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of conversations and their turns."""
    nodes, edges = changes.conversation_graph(Tables(spark, sf_dir).conversations)
    none = F.lit(None).cast("string").alias("dst")
    return edges.select(F.col("type").alias("kind"), F.col("src").alias("id"), "dst").unionByName(nodes.select(F.col("label").alias("kind"), "id", none))


@query("""WITH l AS (SELECT l_orderkey || '-' || l_linenumber AS k, 't' || l_orderkey AS turn, 'a' || l_suppkey AS agent, 'e' || l_partkey AS evidence, l_discount AS weight, l_quantity AS q, l_returnflag AS f, l_linestatus AS s FROM lineitem),
t AS (SELECT 't' || o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P'), a AS (SELECT 'a' || s_suppkey AS id FROM supplier WHERE s_acctbal > 0), x AS (SELECT 'x' || k AS id FROM l WHERE q > 10),
d AS (SELECT DISTINCT 'd' || k AS id, turn, agent, CASE WHEN f <> 'N' THEN 'x' || k END AS execution FROM l WHERE turn IN (SELECT id FROM t) AND agent IN (SELECT id FROM a) AND (f = 'N' OR 'x' || k IN (SELECT id FROM x))),
r AS (SELECT DISTINCT 'r' || k AS id, turn, 'x' || k AS execution, 'd' || k AS decision FROM l WHERE s = 'F' AND turn IN (SELECT id FROM t) AND 'x' || k IN (SELECT id FROM x))
SELECT turn AS id, id AS dst, 'HAS_DECISION' AS kind, NULL::DOUBLE AS weight FROM d UNION SELECT id, agent, 'MADE_BY', NULL FROM d UNION SELECT execution, id, 'MADE_DECISION', NULL FROM d WHERE execution IS NOT NULL
UNION SELECT 'd' || k, evidence, 'SUPPORTED_BY', weight FROM l WHERE 'd' || k IN (SELECT id FROM d) UNION SELECT turn, id, 'PRODUCED', NULL FROM r UNION SELECT execution, id, 'PRODUCED', NULL FROM r UNION SELECT decision, id, 'RESULTED_IN', NULL FROM r WHERE decision IN (SELECT id FROM d)
UNION SELECT id, NULL, 'Decision', NULL FROM d UNION SELECT evidence, NULL, 'Evidence', NULL FROM l UNION SELECT id, NULL, 'Artifact', NULL FROM r""")
def provenance_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as decisions of their order's turn, made by suppliers, supported by parts, with artifacts of those that are done."""
    t = Tables(spark, sf_dir)
    k = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    of = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    line = t.lineitem
    decisions = line.select(of("d", k).alias("id"), of("t", F.col("l_orderkey")).alias("turn"), of("a", F.col("l_suppkey")).alias("agent"), F.when(F.col("l_returnflag") != "N", of("x", k)).alias("execution"))
    support = line.select(of("d", k).alias("decision"), of("e", F.col("l_partkey")).alias("evidence"), F.col("l_discount").alias("weight"))
    artifacts = line.filter("l_linestatus = 'F'").select(of("r", k).alias("id"), of("t", F.col("l_orderkey")).alias("turn"), of("x", k).alias("execution"), of("d", k).alias("decision"))
    turns = t.orders.filter("o_orderstatus <> 'P'").select(of("t", F.col("o_orderkey")))
    agents = t.supplier.filter("s_acctbal > 0").select(of("a", F.col("s_suppkey")))
    nodes, edges = changes.provenance_graph(turns, agents, line.filter("l_quantity > 10").select(of("x", k)), decisions, support, artifacts)
    nodes = nodes.select("id", F.lit(None).cast("string").alias("dst"), F.col("label").alias("kind"), F.lit(None).cast("double").alias("weight"))
    return edges.select(F.col("src").alias("id"), "dst", F.col("type").alias("kind"), "weight").unionByName(nodes)


@query("""WITH RECURSIVE p AS (SELECT o_orderkey AS node, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS other FROM orders),
h AS (SELECT node, other, 1 AS depth FROM p WHERE other IS NOT NULL UNION ALL SELECT h.node, p.other, depth + 1 FROM h JOIN p ON p.node = h.other WHERE p.other IS NOT NULL AND depth < 3)
SELECT o_orderkey AS execution, o_orderstatus AS status, coalesce(list(other ORDER BY depth) FILTER (WHERE other IS NOT NULL), []) AS delegated_to FROM orders LEFT JOIN h ON node = o_orderkey GROUP BY 1, 2""")
def delegation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each execution with those it was handed to, directly and further on, to depth three; none for most of the last."""
    o = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("node"), "o_orderstatus", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("parent"))
    reached = network.ancestors(o.select("node"), o.select("node", "parent").filter("parent IS NOT NULL"), 3).filter("depth > 0")
    chain = reached.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))), lambda x: x["ancestor"]).alias("chain"))
    return o.join(chain, "node", "left").select(F.col("node").alias("execution"), F.col("o_orderstatus").alias("status"), F.coalesce("chain", F.array().cast("array<bigint>")).alias("delegated_to"))


@query("""WITH c AS (SELECT DISTINCT l_partkey AS tool, l_suppkey AS agent FROM lineitem), s AS (SELECT tool, agent, round(s_acctbal + p_retailprice, 2) AS cost FROM c JOIN supplier ON s_suppkey = agent JOIN part ON p_partkey = tool)
SELECT tool, agent, cost, nth FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY cost, agent) AS nth FROM s) WHERE nth <= 3""")
def cheapest_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three agents of each tool whose own cost and the tool's are least together."""
    t = Tables(spark, sf_dir)
    can = t.lineitem.select(F.col("l_partkey").alias("tool"), F.col("l_suppkey").alias("agent")).distinct()
    priced = can.join(t.supplier.select(F.col("s_suppkey").alias("agent"), "s_acctbal"), "agent").join(t.part.select(F.col("p_partkey").alias("tool"), "p_retailprice"), "tool")
    s = priced.select("tool", "agent", F.round(F.col("s_acctbal") + F.col("p_retailprice"), 2).alias("cost"))
    return s.withColumn("nth", F.row_number().over(Window.partitionBy("tool").orderBy("cost", "agent"))).filter("nth <= 3")


@query("""WITH d AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, p_size, p_retailprice FROM part),
v AS (SELECT p_brand, rank, 'size' AS type, p_size::DOUBLE AS value, CASE WHEN p_size > 36 THEN 3 WHEN p_size > 33 THEN 2 ELSE 1 END AS severity FROM d WHERE p_size > 30
UNION ALL SELECT p_brand, rank, 'price', p_retailprice, CASE WHEN p_retailprice > 1200 THEN 3 WHEN p_retailprice > 1100 THEN 2 ELSE 1 END FROM d WHERE p_retailprice > 1000)
SELECT p_brand, type, rank, value, severity FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, type ORDER BY severity DESC, rank) AS r FROM v WHERE rank <= 3) WHERE r = 1""")
def worst_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the three dearest designs of a brand the worst violation of each type."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    d = Tables(spark, sf_dir).part.select("p_brand", F.row_number().over(w).alias("rank"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    found = lambda c, limit: F.when(F.col(c) > limit, F.struct(F.lit(c).alias("type"), F.col(c).alias("value"), F.when(F.col(c) > limit * 1.2, 3).when(F.col(c) > limit * 1.1, 2).otherwise(1).alias("severity")))
    v = d.select("p_brand", "rank", F.inline(F.array_compact(F.array(found("size", 30.0), found("price", 1000.0)))))
    return changes.worst_by_type(v, ["p_brand"], "rank", 3)


@query()
def transcript_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as captions, in pages of a day each that the first event of a later day closes."""
    e = Tables(spark, sf_dir).events.withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))
    start = F.col("at") - F.min("at").over(Window.partitionBy("user_id"))
    pages = changes.transcript_pages(e.select(F.col("user_id").alias("video"), F.col("event_id").alias("seq"), start.alias("start"), F.col("event_type").alias("text")), 86400)
    return pages.select("video", "page", "text", h_mm_ss(F.col("started")).alias("started"), h_mm_ss(F.col("ended")).alias("ended"))


#: Sequences with aliases and verbs, and terms with the verbs they stand for.
SEQUENCES = (("tower", ("Large bolt", "tall"), ("extrude", "taper")), ("court", ("blue rod", "cold"), ("cut", "offset")), ("terrace", ("step", "hot gear small"), ("offset", "taper", "shift")))
TERMS = ((("widget", "gear"), ("taper",)), (("Bolt",), ("cut", "offset")), (("rod",), ("extrude",)))


@query()
def intent_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences that fit the words of a part's name, best first."""
    found = changes.match_sequences(F.col("p_name"), SEQUENCES, TERMS)
    return Tables(spark, sf_dir).part.select("p_partkey", F.posexplode(found).alias("nth", "x")).select("p_partkey", "nth", "x.*")


@query("""SELECT DISTINCT l_partkey AS source, l_suppkey AS id, round(l_discount + 1e-9, 4) AS score FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)""")
def cited_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the sources that an answer used, with their scores at four digits, once each."""
    t = Tables(spark, sf_dir)
    used = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    found = t.lineitem.join(used, "l_partkey", "left_semi").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("id"), F.round(F.col("l_discount") + 1e-9, 4).alias("score"))
    return found.distinct()


@query("""SELECT DISTINCT event_type AS label FROM events WHERE event_type NOT IN ('error', 'signup') AND value IS NOT NULL""")
def labels_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that have rows, without those of the system."""
    return Tables(spark, sf_dir).events.filter("value IS NOT NULL AND event_type NOT IN ('error', 'signup')").select(F.col("event_type").alias("label")).distinct()
