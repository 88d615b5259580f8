"""Property-graph queries: patterns, hierarchies, lineage, communities, entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators import network
from loomgraph.operators.entities import duplicate_groups, duplicate_pairs
from loomgraph.operators.leiden import leiden
from loomgraph.plans.registry import registry
from loomgraph.session import dealt
from loomgraph.sources.tables import Tables

QUERIES, ORACLES, query = registry()



@query("""SELECT * FROM (SELECT 'Region' AS kind, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer
UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Document', count(*) FROM documents) WHERE n > 0""")
def label_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    parts = [getattr(t, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, n in (("Region", "region"), ("Nation", "nation"), ("Customer", "customer"), ("Supplier", "supplier"), ("Order", "orders"), ("Document", "documents"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("n > 0")


@query("""WITH e AS (SELECT 'PLACED' AS type, o_custkey AS src, o_orderkey AS dst FROM orders UNION ALL SELECT 'SUPPLIES', l_suppkey, l_partkey FROM lineitem UNION ALL SELECT 'IN_NATION', c_custkey, c_nationkey::BIGINT FROM customer),
d AS (SELECT type, src, count(*) AS degree FROM e GROUP BY 1, 2) SELECT type, degree, count(*) AS nodes FROM d GROUP BY 1, 2""")
def graph_schema_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge types with their degree distribution: nodes per out-degree."""
    t = Tables(spark, sf_dir)
    e = t.orders.select(F.lit("PLACED").alias("type"), F.col("o_custkey").alias("src"))
    e = e.unionByName(t.lineitem.select(F.lit("SUPPLIES").alias("type"), F.col("l_suppkey").alias("src"))).unionByName(t.customer.select(F.lit("IN_NATION").alias("type"), F.col("c_custkey").alias("src")))
    return e.groupBy("type", "src").agg(F.count(F.lit(1)).alias("degree")).groupBy("type", "degree").agg(F.count(F.lit(1)).alias("nodes"))


@query("SELECT n_nationkey, n_name, w.tag FROM nation JOIN (VALUES (1, 'a'), (3, 'b'), (3, 'c'), (99, 'd')) AS w(k, tag) ON k = n_nationkey")
def param_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter list as a source, joined to nodes by key."""
    rows = spark.createDataFrame([(1, "a"), (3, "b"), (3, "c"), (99, "d")], "n_nationkey int, tag string")
    return Tables(spark, sf_dir).nation.join(F.broadcast(rows), "n_nationkey").select("n_nationkey", "n_name", "tag")


@query("""SELECT o_orderkey AS parent, l_linenumber AS seq, lead(l_linenumber) OVER w AS next_seq, lead(l_partkey) OVER w AS next_part FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WINDOW w AS (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) QUALIFY next_seq IS NOT NULL""")
def unit_next_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NEXT edges between siblings in order, within each parent. Line numbers exist for orders only, so the parent needs no second scan."""
    t = Tables(spark, sf_dir)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    n = t.lineitem.count()
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = dealt(li, n, "l_orderkey").join(dealt(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), n, "l_orderkey"), "l_orderkey")
    out = li.select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("seq"), F.lead("l_linenumber").over(w).alias("next_seq"), F.lead("l_partkey").over(w).alias("next_part"))
    return out.filter("next_seq IS NOT NULL")


@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS p, 'n' || n_nationkey AS c FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
h AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT root, c, depth + 1 FROM h JOIN e ON e.p = h.node WHERE depth < 5)
SELECT root, depth, count(*) AS nodes FROM h GROUP BY 1, 2""")
def hierarchy_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants per depth below each root. The levels are tables, so the closure is one join per level."""
    t = Tables(spark, sf_dir)
    root = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("root"), "r_regionkey")
    n = root.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).select("root", "n_nationkey")
    c = F.broadcast(n).join(t.customer, F.col("n_nationkey") == F.col("c_nationkey")).select("root", "c_custkey")
    o = c.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).select("root")
    out = root.select("root", F.lit(0).alias("depth"))
    for d, level in enumerate((n, c, o), 1):
        out = out.unionByName(level.select("root", F.lit(d).alias("depth")))
    return out.groupBy("root", "depth").agg(F.count(F.lit(1)).alias("nodes"))


@query("""SELECT l.l_orderkey AS orderkey, l.l_linenumber AS line, 'parent' AS kind, 'o' || l.l_orderkey AS other FROM lineitem l
UNION ALL SELECT l.l_orderkey, l.l_linenumber, 'sibling', 'l' || s.l_orderkey || '-' || s.l_linenumber FROM lineitem l JOIN lineitem s ON s.l_orderkey = l.l_orderkey AND s.l_linenumber <> l.l_linenumber
UNION ALL SELECT l.l_orderkey, l.l_linenumber, 'part', 'p' || l.l_partkey FROM lineitem l""")
def star_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent, siblings and referenced node of every unit, with the kind of link."""
    li = Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), "l_partkey")
    s = li.select("orderkey", F.col("line").alias("s"))
    parent = li.select("orderkey", "line", F.lit("parent").alias("kind"), F.concat(F.lit("o"), "orderkey").alias("other"))
    sibling = li.join(s, "orderkey").filter("s <> line").select("orderkey", "line", F.lit("sibling").alias("kind"), F.concat(F.lit("l"), "orderkey", F.lit("-"), "s").alias("other"))
    part = li.select("orderkey", "line", F.lit("part").alias("kind"), F.concat(F.lit("p"), "l_partkey").alias("other"))
    return parent.unionByName(sibling).unionByName(part)


@query("""SELECT a.conv_id, a.role, a.turn AS turn_a, b.turn AS turn_b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.role = b.role AND a.turn < b.turn AND a.text <> b.text""")
def conflicting_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the same conversation and type whose descriptions differ."""
    c = Tables(spark, sf_dir).conversations
    a, b = (c.select("conv_id", "role", F.col("turn").alias(f"turn_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    return a.join(b, ["conv_id", "role"]).filter("turn_a < turn_b AND text_a <> text_b").select("conv_id", "role", "turn_a", "turn_b")


@query("""WITH c AS (SELECT l_suppkey AS agent, l_partkey AS need, count(*) AS matches, avg(l_discount) AS prof, avg(l_tax) AS cost FROM lineitem GROUP BY 1, 2),
s AS (SELECT need, agent, round(0.4 * prof + 0.3 * matches + 0.2 * s_acctbal / 10000 - 0.1 * cost, 6) AS score FROM c JOIN supplier ON s_suppkey = agent)
SELECT need, agent, score FROM (SELECT *, row_number() OVER (PARTITION BY need ORDER BY score DESC, agent) AS r FROM s) WHERE r = 1""")
def best_fit_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit of each agent to a need: proficiency, matches, performance, less cost; the best one."""
    t = Tables(spark, sf_dir)
    c = t.lineitem.groupBy(F.col("l_suppkey").alias("agent"), F.col("l_partkey").alias("need")).agg(F.count(F.lit(1)).alias("m"), F.avg("l_discount").alias("prof"), F.avg("l_tax").alias("cost"))
    s = c.join(t.supplier.select(F.col("s_suppkey").alias("agent"), "s_acctbal"), "agent")
    score = F.round(0.4 * F.col("prof") + 0.3 * F.col("m") + 0.2 * F.col("s_acctbal") / 10000 - 0.1 * F.col("cost"), 6)
    return s.groupBy("need").agg(F.max_by(F.struct("agent", score.alias("score")), F.struct(score, -F.col("agent"))).alias("b")).select("need", "b.agent", "b.score")


@query("""WITH RECURSIVE p AS (SELECT o_orderkey AS node, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders),
h AS (SELECT node, node AS ancestor, 0 AS depth FROM p UNION ALL SELECT h.node, p.parent, depth + 1 FROM h JOIN p ON p.node = h.ancestor WHERE p.parent IS NOT NULL AND depth < 4)
SELECT node, ancestor, depth FROM h""")
def lineage_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors of every artifact to depth 4; depth 0 is the artifact itself. Each step is one equi-join on the parent map."""
    o = Tables(spark, sf_dir).orders
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    parents = o.select(F.col("o_orderkey").alias("node"), F.lag("o_orderkey").over(w).alias("parent")).filter("parent IS NOT NULL")
    return network.ancestors(o.select(F.col("o_orderkey").alias("node")), parents, 4)


@query("""SELECT o_orderkey, c_name, n_name, (o_orderstatus = 'F') AS direct FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def provenance_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifact to decision to maker, with a flag for a direct result."""
    t = Tables(spark, sf_dir)
    c = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "n_name")
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "n_name", (F.col("o_orderstatus") == "F").alias("direct"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return t.customer.join(t.orders.filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("""WITH gone AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0), m AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
SELECT DISTINCT l_partkey AS part FROM m WHERE l_suppkey IN (SELECT * FROM gone) AND l_partkey NOT IN (SELECT l_partkey FROM m WHERE l_suppkey NOT IN (SELECT * FROM gone))""")
def cascade_delete_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that go with the deleted documents: those that no remaining document mentions."""
    t = Tables(spark, sf_dir)
    m = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_partkey").agg(F.bool_and(F.col("s_acctbal") < 0).alias("only_gone"))
    return m.filter("only_gone").select(F.col("l_partkey").alias("part"))


@query("""WITH p AS (SELECT p_partkey, p_brand, lower(p_name) AS name FROM part),
x AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
WHERE contains(a.name, b.name) OR contains(b.name, a.name) OR (length(a.name) > 5 AND length(b.name) > 5 AND levenshtein(a.name, b.name) < 3))
SELECT a, b FROM x""")
def entity_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likely duplicates of the same label: one name within the other, or an edit distance below three."""
    return duplicate_pairs(Tables(spark, sf_dir).part, "p_partkey", "p_brand", "p_name")


@query("""WITH p AS (SELECT p_partkey, p_brand, lower(p_name) AS name, embedding::DOUBLE[] AS e FROM part LEFT JOIN embeddings ON vec_id = p_partkey),
x AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey
WHERE contains(a.name, b.name) OR contains(b.name, a.name) OR (length(a.name) > 5 AND length(b.name) > 5 AND levenshtein(a.name, b.name) < 3) OR coalesce(round(list_cosine_similarity(a.e, b.e), 6) >= 0.3, false)),
g AS (SELECT a, list_sort(list_distinct(list_append(list(b), a))) AS m FROM x GROUP BY a)
SELECT a AS node, len(m) AS size, array_to_string(m, ',') AS members FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.a <> g.a AND list_has_all(h.m, g.m) AND (len(h.m) > len(g.m) OR h.a < g.a))""")
def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of likely duplicates by name or vector, without those that lie within a larger one."""
    t = Tables(spark, sf_dir)
    entities = t.part.join(t.embeddings.select(F.col("vec_id").alias("p_partkey"), "embedding"), "p_partkey", "left")
    groups = duplicate_groups(entities, "p_partkey", "p_brand", "p_name", "embedding", 0.3)
    return groups.select("node", "size", F.array_join("members", ",").alias("members"))


@query("""WITH m AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS canon FROM part),
e AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
SELECT canon AS part, l_suppkey AS supplier, count(*) AS merged FROM e JOIN m ON p_partkey = l_partkey WHERE canon <> l_suppkey GROUP BY 1, 2""")
def merge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges re-pointed to the canonical node of each group, without self loops, one row per edge."""
    t = Tables(spark, sf_dir)
    m = t.part.select(F.col("p_partkey").alias("l_partkey"), F.min("p_partkey").over(Window.partitionBy("p_brand", "p_type")).alias("part"))
    e = t.lineitem.select("l_partkey", F.col("l_suppkey").alias("supplier")).distinct()
    return e.join(m, "l_partkey").filter("part <> supplier").groupBy("part", "supplier").agg(F.count(F.lit(1)).alias("merged"))


@query("""SELECT d.source, count(*) AS docs, sum(coalesce(l.n, 0))::BIGINT AS labelled, sum(chunks)::BIGINT AS chunks FROM
(SELECT source, doc_id, ceil(n_chars / 200.0)::BIGINT AS chunks FROM documents) d LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l USING (doc_id) GROUP BY 1""")
def doc_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of several branches, each aggregated before the join so that none multiplies another."""
    t = Tables(spark, sf_dir)
    lab = t.labels.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    d = t.documents.select("source", "doc_id", F.ceil(F.col("n_chars") / 200).alias("chunks")).join(lab, "doc_id", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("labelled"), F.sum("chunks").alias("chunks"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey, l_suppkey AS s FROM lineitem) SELECT a.s AS a, b.s AS b, count(*) AS weight FROM e a JOIN e b ON a.l_orderkey = b.l_orderkey AND a.s < b.s GROUP BY 1, 2""")
def community_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected projection: nodes that share an order, weighted by how many. Pairs come from each order's short list."""
    li = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_suppkey")
    n = li.count()
    e = dealt(li, n, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("s"))
    tails = e.select(F.posexplode("s").alias("i", "a"), "s").select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    return dealt(tails, 2 * n, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


@query()
def community_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leiden communities of three levels on the projection, in one cycle."""
    return leiden(community_projection(spark, sf_dir), cycles=1)


@query("""WITH m AS (SELECT 'n' || c_nationkey AS community, c_custkey FROM customer UNION ALL SELECT 'r' || n_regionkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT community, count(DISTINCT o_orderkey) AS rank, count(DISTINCT c_custkey) AS weight FROM m LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def community_rank_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct documents and members that reach a community, parents included. Orders are counted per member first."""
    t = Tables(spark, sf_dir)
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))  # order keys are unique
    c = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(per, "c_custkey", "left")
    both = F.explode(F.array(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
    return c.select(both.alias("community"), F.coalesce("n", F.lit(0)).alias("n")).groupBy("community").agg(F.sum("n").alias("rank"), F.count(F.lit(1)).alias("weight"))


ROADS = """e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst, (abs(c_nationkey - s_nationkey) * 10 + 5)::DOUBLE AS cost FROM customer JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey AND abs(c_nationkey - s_nationkey) <= 3)"""


def roads(t: Tables) -> DataFrame:
    """A small road network over nations: an edge where goods went between near keys."""
    c = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("src"))
    s = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("o_orderkey"), F.col("s_nationkey").alias("dst"))
    e = c.join(s, "o_orderkey").filter((F.col("src") != F.col("dst")) & (F.abs(F.col("src") - F.col("dst")) <= 3)).select("src", "dst").distinct()
    return e.withColumn("cost", (F.abs(F.col("src") - F.col("dst")) * 10 + 5).cast("double"))


@query(f"""WITH RECURSIVE {ROADS}, r AS (SELECT n_nationkey AS origin, n_nationkey AS node, 0.0::DOUBLE AS cost FROM nation UNION SELECT origin, dst, r.cost + e.cost FROM r JOIN e ON e.src = r.node WHERE r.cost + e.cost <= 60)
SELECT origin, node, min(cost) AS cost FROM r GROUP BY 1, 2""")
def range_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes whose shortest cost from each origin is within 60."""
    t = Tables(spark, sf_dir)
    return network.range_expansion(t.nation.select(F.col("n_nationkey").alias("origin")), roads(t), 60.0)


@query(f"""WITH RECURSIVE {ROADS}, r AS (SELECT n_nationkey AS origin, n_nationkey AS node, 0.0::DOUBLE AS cost FROM nation UNION SELECT origin, dst, r.cost + e.cost FROM r JOIN e ON e.src = r.node WHERE r.cost + e.cost <= 60),
m AS (SELECT origin, node, min(cost) AS cost FROM r GROUP BY 1, 2), p AS (SELECT origin, s_suppkey AS poi, cost, row_number() OVER (PARTITION BY origin ORDER BY cost, s_suppkey) AS nth FROM m JOIN supplier ON s_nationkey = node)
SELECT origin, poi, cost, nth FROM p WHERE nth <= 3""")
def knn_poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three points of interest by network distance."""
    t = Tables(spark, sf_dir)
    reached = network.range_expansion(t.nation.select(F.col("n_nationkey").alias("origin")), roads(t), 60.0)
    poi = t.supplier.select(F.col("s_nationkey").alias("node"), F.col("s_suppkey").alias("poi"))
    return network.nearest_poi(reached, poi, 3)


@query("""WITH z(etype, vehicle, penalty, blocked) AS (VALUES ('purchase', 'truck', 0.0, true), ('click', 'any', 5.0, false), ('view', 'any', 1.0, false), ('click', 'truck', 2.5, false)),
x AS (SELECT event_id, value, CASE WHEN user_id % 2 = 0 THEN 'truck' ELSE 'car' END AS vehicle, event_type, (extract(hour FROM ts) >= 22 OR extract(hour FROM ts) < 6) AS night FROM events)
SELECT event_id, CASE WHEN coalesce(bool_or(blocked), false) OR (night AND event_type = 'error') THEN NULL ELSE round(value + coalesce(sum(penalty), 0), 4) END AS cost
FROM x LEFT JOIN z ON etype = event_type AND (z.vehicle = 'any' OR z.vehicle = x.vehicle) GROUP BY event_id, value, night, event_type""")
def edge_cost_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of an edge in context: a blocking rule closes it (null), penalties add; a ban holds from 22 to 6 across midnight."""
    rules = spark.createDataFrame([("purchase", "truck", 0.0, True), ("click", "any", 5.0, False), ("view", "any", 1.0, False), ("click", "truck", 2.5, False)], "event_type string, rule_vehicle string, penalty double, blocked boolean")
    x = Tables(spark, sf_dir).events.select("event_id", "value", "event_type", F.when(F.col("user_id") % 2 == 0, "truck").otherwise("car").alias("vehicle"), network.in_daily_window(F.hour("ts") * 3600, 22 * 3600, 6 * 3600 - 1).alias("night"))
    j = x.join(F.broadcast(rules), (x.event_type == rules.event_type) & ((F.col("rule_vehicle") == "any") | (F.col("rule_vehicle") == F.col("vehicle"))), "left").drop(rules.event_type)
    g = j.groupBy("event_id", "value", "night", "event_type").agg(F.bool_or("blocked").alias("b"), F.sum("penalty").alias("p"))
    closed = F.coalesce("b", F.lit(False)) | (F.col("night") & (F.col("event_type") == "error"))
    return g.select("event_id", F.when(~closed, F.round(F.col("value") + F.coalesce("p", F.lit(0.0)), 4)).alias("cost"))


@query(f"""WITH RECURSIVE {ROADS}, o AS (SELECT src, dst, cost + CASE src % 6 WHEN 2 THEN 7.0 WHEN 3 THEN 4.0 WHEN 5 THEN 3.0 ELSE 0.0 END AS cost FROM e WHERE NOT ((src % 6 = 0 AND dst % 2 = 0) OR src % 6 = 1)),
r AS (SELECT n_nationkey AS origin, n_nationkey AS node, 0.0::DOUBLE AS cost FROM nation UNION SELECT origin, dst, r.cost + o.cost FROM r JOIN o ON o.src = r.node WHERE r.cost + o.cost <= 60)
SELECT origin, node, min(cost) AS cost FROM r GROUP BY 1, 2""")
def contextual_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within 60 for a lorry of 12 tons an axle at 23:00: weight limits and a ban over midnight close roads, bus lanes, tolls and school zones add, permits and unknown rules do nothing."""
    t = Tables(spark, sf_dir)
    rules = spark.createDataFrame(
        [("0-0", "weightLimit", 10.0, None, None, None), ("1-0", "timeBan", None, 22 * 3600, 6 * 3600, None), ("1-1", "timeBan", None, 22 * 3600, 6 * 3600, None), ("2-0", "busOnly", None, None, None, 7.0), ("2-1", "busOnly", None, None, None, 7.0),
         ("3-0", "toll", None, None, None, 4.0), ("3-1", "toll", None, None, None, 4.0), ("4-0", "permitBased", None, None, None, None), ("4-1", "curfew", 1.0, None, None, 9.0), ("5-0", "schoolZone", None, None, None, 3.0), ("5-1", "schoolZone", None, None, None, 3.0)],
        "zone_id string, type string, limit double, start long, end long, penalty double",
    )
    edges = roads(t).select("src", "dst", F.col("cost").alias("base_cost"), F.concat_ws("-", F.col("src") % 6, F.col("dst") % 2).alias("zone_id"))
    open_ = network.edge_costs(edges, rules, "truck", 23 * 3600, axle_weight=12.0)
    return network.range_expansion(t.nation.select(F.col("n_nationkey").alias("origin")), open_, 60.0)


@query("""SELECT o_orderpriority, n_name, count(*) AS citations FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def citation_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    c = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderpriority", "n_name").agg(F.count(F.lit(1)).alias("citations"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), k AS (SELECT s, p, row_number() OVER (PARTITION BY s ORDER BY p) AS r FROM e
WHERE s IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND p IN (SELECT p_partkey FROM part WHERE p_size <= 25)) SELECT s AS src, p AS dst FROM k WHERE r <= 50""")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose ends are both in the node set, at most 50 per source node."""
    t = Tables(spark, sf_dir)
    e = t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    e = e.join(t.supplier.filter("s_acctbal > 0"), F.col("src") == F.col("s_suppkey"), "left_semi").join(t.part.filter("p_size <= 25"), F.col("dst") == F.col("p_partkey"), "left_semi")
    return e.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).filter("r <= 50").select("src", "dst")


@query()
def component_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of nodes that share an order, by rounds of least labels. An edge from an order's least node to each other one connects as much as all its pairs."""
    li = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_suppkey").filter("l_orderkey is not null and l_suppkey is not null")
    n = li.count()
    e = dealt(li, n, "l_orderkey").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"))
    return network.components(e.select(F.array_min("s").alias("a"), F.explode("s").alias("b")).filter("a <> b"))


@query()
def visit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first order of the parts of a brand along links from each to four others, some of them one-way streets out of nothing."""
    t = Tables(spark, sf_dir)
    p = t.part.select(F.col("p_brand").alias("grp"), (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).cast("long").alias("node"))
    i = F.col("node")
    near = F.when(i % 7 != 5, F.array(i * 2 + 2, i * 2 + 1, i - 3, i * 3 % 11)).otherwise(F.array().cast("array<bigint>"))
    return network.visit_order(p, p.select("grp", F.col("node").alias("src"), F.posexplode(near).alias("nth", "dst")))
