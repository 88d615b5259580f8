"""Vector, keyword and hybrid retrieval queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators import procedures
from loomgraph.operators import retrieval as R
from loomgraph.operators.keyword_index import KeywordIndex
from loomgraph.operators.semantic import expand
from loomgraph.operators.vector_index import VectorIndex
from loomgraph.plans.registry import registry
from loomgraph.session import written
from loomgraph.sources.tables import Tables

QUERIES, ORACLES, query = registry()

def asked(t: Tables) -> DataFrame:
    """The query set: ids divisible by 20, asked against all rows."""
    return t.embeddings.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), F.col("embedding").alias("qe"))


def near(t: Tables, k: int, **how) -> DataFrame:
    return R.nearest(asked(t), t.embeddings.select("vec_id", "label", "embedding"), k, **how)


SCORED = """scored AS (
  SELECT q.vec_id AS query_id, q.label AS query_label, e.vec_id, e.label,
         round(greatest(0.0, least(1.0, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS score
  FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)"""


def best_first():
    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")


@query(f"WITH {SCORED} SELECT query_id, vec_id, score, rank FROM ranked WHERE rank <= 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(Tables(spark, sf_dir), 5).select("query_id", "vec_id", "score", "rank")


@query(f"WITH {SCORED} SELECT query_id, vec_id, label, score FROM ranked WHERE rank <= 20 AND score >= 0.25 AND label <> 0")
def vector_threshold_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over-fetch, then keep what passes the threshold and the label filter."""
    return near(Tables(spark, sf_dir), 20).filter((F.col("score") >= 0.25) & (F.col("label") != 0)).select("query_id", "vec_id", "label", "score")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(e.v, q.v))), 6) AS score FROM e JOIN e q ON e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT least(query_id, vec_id) AS a, greatest(query_id, vec_id) AS b, max(score) AS score FROM r WHERE rank <= 6 AND score >= 0.2 GROUP BY 1, 2""")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected neighbour edges: each vector's six nearest, at least 0.2, one row per pair."""
    e = Tables(spark, sf_dir).embeddings
    found = R.nearest(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe")), e.select("vec_id", "embedding"), 6).filter(F.col("score") >= 0.2)
    return found.groupBy(F.least("query_id", "vec_id").alias("a"), F.greatest("query_id", "vec_id").alias("b")).agg(F.max("score").alias("score"))


@query(f"""WITH {SCORED} SELECT query_id, label AS doc, count(*) AS hits, round(sum(score), 6) AS sum_score, string_agg(vec_id::VARCHAR, ',' ORDER BY rank) AS chunks
FROM ranked WHERE rank <= 10 GROUP BY query_id, label""")
def doc_rollup_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk hits rolled up to their document: total score (over hits: the mean) and chunk ids in rank order."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"].cast("string")), ",")
    return near(Tables(spark, sf_dir), 10).groupBy("query_id", F.col("label").alias("doc")).agg(F.count(F.lit(1)).alias("hits"), F.round(F.sum("score"), 6).alias("sum_score"), ordered.alias("chunks"))


def centroids(t: Tables) -> DataFrame:
    """Mean vector per label as ``label, c array<double>``, in order of position."""
    flat = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return flat.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))


@query("""WITH f AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM f GROUP BY label, i), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label),
d AS (SELECT e.vec_id, c.label AS nearest, round(list_distance(e.embedding::DOUBLE[], c.c), 6) AS distance FROM embeddings e CROSS JOIN c)
SELECT vec_id, nearest, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest) AS r FROM d) WHERE r = 1""")
def nearest_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest label mean by Euclidean distance."""
    t = Tables(spark, sf_dir)
    each = t.embeddings.select("vec_id", F.col("embedding").alias("qe"))
    found = R.nearest(each, centroids(t), 1, query_id="vec_id", row_id="label", vector="c", metric="l2", others=False)
    return found.select("vec_id", F.col("label").alias("nearest"), F.col("score").alias("distance"))


@query(f"""WITH {SCORED}, f AS (SELECT * FROM ranked WHERE rank <= 5),
d AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY query_id, rank) AS nth FROM f)
SELECT vec_id, query_id AS first_query, rank AS first_rank, score FROM d WHERE nth = 1""")
def batched_fanout_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many queries at once, five hits each; a hit counts for the first query that brought it."""
    return R.fan_out(near(Tables(spark, sf_dir), 5)).select("vec_id", F.col("query_id").alias("first_query"), F.col("rank").alias("first_rank"), "score")


KEYWORDS = ("license", "token", "the", "und", "les")  # a fixed query
_KW = ", ".join(f"('{k}')" for k in KEYWORDS)


def matches(text: Column) -> Column:
    low = F.lower(text)
    return sum((F.contains(low, F.lit(k)).cast("int") for k in KEYWORDS[1:]), F.contains(low, F.lit(KEYWORDS[0])).cast("int"))


@query(f"""WITH k(word) AS (VALUES {_KW}) SELECT doc_id, round((sum((contains(lower(text), word))::INT) + 5 * max((lang = 'en')::INT) + 3 * max((source = 'src0')::INT)) / 10.0, 4) AS score
FROM documents CROSS JOIN k GROUP BY doc_id HAVING sum((contains(lower(text), word))::INT) > 0""")
def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words matched, plus 5 for the zone (language) and 3 for the kind (source), over 10."""
    d = Tables(spark, sf_dir).documents.withColumn("m", matches(F.col("text"))).filter("m > 0")
    score = (F.col("m") + F.when(F.col("lang") == "en", 5).otherwise(0) + F.when(F.col("source") == "src0", 3).otherwise(0)) / 10
    return d.select("doc_id", F.round(score, 4).alias("score"))


WORDS = r"[^\p{L}]+"
TFIDF = f"""tok AS (SELECT doc_id, unnest(string_split_regex(lower(text), '{WORDS}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE length(term) > 3 GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT doc_id, term, round(tf * ln((1.0 + n) / (1.0 + df)), 6) AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * ln((1.0 + n) / (1.0 + df)), 6) DESC, term) AS rank FROM tf JOIN df USING (term) CROSS JOIN n)"""


@query(f"WITH {TFIDF} SELECT doc_id, term, weight, rank FROM w WHERE rank <= 3")
def inverted_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three terms of highest tf-idf per document."""
    return R.best_terms(Tables(spark, sf_dir).documents.select("doc_id", "text"), "doc_id", "text", WORDS, 3)


@query(f"""WITH {SCORED}, k(word) AS (VALUES {_KW}),
kw AS (SELECT doc_id, sum((contains(lower(text), word))::INT)::DOUBLE AS kw FROM documents CROSS JOIN k GROUP BY doc_id),
vs AS (SELECT vec_id AS doc_id, max(score) AS vs FROM ranked WHERE rank <= 50 GROUP BY vec_id),
b AS (SELECT coalesce(kw.doc_id, vs.doc_id) AS doc_id, coalesce(kw / max(kw) OVER (), 0) AS a, coalesce(vs / max(vs) OVER (), 0) AS b FROM kw FULL JOIN vs ON kw.doc_id = vs.doc_id)
SELECT doc_id, round(greatest(a, b), 5) AS score FROM b WHERE greatest(a, b) > 0""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and vector scores, each divided by its maximum; a document takes the larger."""
    t = Tables(spark, sf_dir)
    kw = t.documents.select("doc_id", matches(F.col("text")).cast("double").alias("kw"))
    vs = near(t, 50).groupBy(F.col("vec_id").alias("doc_id")).agg(F.max("score").alias("vs"))
    peak = kw.agg(F.max("kw").alias("mk")).withColumn("k", F.lit(1)).join(vs.agg(F.max("vs").alias("mv")).withColumn("k", F.lit(1)), "k")  # one row
    both = kw.join(vs, "doc_id", "full").withColumn("k", F.lit(1)).join(F.broadcast(peak), "k")
    score = F.greatest(F.coalesce(F.col("kw") / F.col("mk"), F.lit(0.0)), F.coalesce(F.col("vs") / F.col("mv"), F.lit(0.0)))
    return both.withColumn("raw", score).filter("raw > 0").select("doc_id", F.round("raw", 5).alias("score"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations)
SELECT conv_id, count(*) AS used, string_agg(role || ': ' || text, chr(10) || '----' || chr(10) ORDER BY r) AS context, count(DISTINCT role) AS sources FROM r WHERE r <= 4 GROUP BY conv_id""")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best pieces of each conversation as one context, with its distinct sources."""
    w = Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn")
    top = Tables(spark, sf_dir).conversations.withColumn("r", F.row_number().over(w)).filter("r <= 4")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat("role", F.lit(": "), "text").alias("s")))), lambda x: x["s"]), "\n----\n")
    return top.groupBy("conv_id").agg(F.count(F.lit(1)).alias("used"), text.alias("context"), F.countDistinct("role").alias("sources"))


@query(f"""WITH {SCORED}, b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS nth FROM ranked),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS pos FROM b WHERE nth = 1 OR score >= best - 0.05)
SELECT query_id, vec_id, label, score, pos FROM k WHERE pos <= 10""")
def diverse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new label always, the same label only within 0.05 of the best; ten at most."""
    # a row within 0.05 of the best has at most nine such rows above it, so the ten nearest and the best of each label are all candidates
    s = near(Tables(spark, sf_dir), 10, best_per="label").withColumn("best", F.max("score").over(Window.partitionBy("query_id")))
    s = s.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "label").orderBy(F.desc("score"), "vec_id"))).filter((F.col("nth") == 1) | (F.col("score") >= F.col("best") - 0.05))
    return s.withColumn("pos", F.row_number().over(best_first())).filter("pos <= 10").select("query_id", "vec_id", "label", "score", "pos")


@query(f"""WITH {SCORED}, r AS (SELECT query_id, query_label, rank, (label = query_label)::INT AS rel FROM ranked WHERE rank <= 10),
tot AS (SELECT query_id, sum((label = query_label)::INT) AS total FROM scored GROUP BY query_id),
m AS (SELECT query_id, any_value(query_label) AS label, sum(rel) / 10.0 AS p, sum(rel)::DOUBLE AS found, sum(rel / log2(rank + 1)) AS dcg, min(CASE WHEN rel = 1 THEN rank END) AS hit FROM r GROUP BY query_id),
i AS (SELECT query_id, sum(1 / log2(g + 1)) AS idcg FROM tot, range(1, 11) AS x(g) WHERE g <= total GROUP BY query_id)
SELECT m.query_id, label, round(p, 5) AS precision_at_10, round(CASE WHEN total = 0 THEN 0 ELSE found / total END, 5) AS recall_at_10, round(coalesce(dcg / idcg, 0), 5) AS ndcg_at_10, round(coalesce(1.0 / hit, 0), 5) AS mrr
FROM m JOIN tot USING (query_id) LEFT JOIN i USING (query_id)""")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, NDCG at 10 and reciprocal rank; a hit is relevant if it has the query's label."""
    t = Tables(spark, sf_dir)
    sizes = t.embeddings.groupBy(F.col("label").alias("query_label")).agg((F.count(F.lit(1)) - 1).alias("total"))  # all of the label but the query itself
    top = near(t, 10).withColumn("rel", (F.col("label") == F.col("query_label")).cast("int")).join(sizes, "query_label")
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    m = top.groupBy("query_id").agg(
        F.first("query_label").alias("label"), F.first("total").alias("total"), F.sum("rel").alias("found"), F.sum(gain).alias("dcg"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("hit"),
    )
    ideal = F.when(F.col("total") > 0, F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.greatest(F.lit(1), F.col("total").cast("int")))), F.lit(0.0), lambda a, g: a + 1 / F.log2(g + 1)))
    return m.select(
        "query_id", "label", F.round(F.col("found") / 10, 5).alias("precision_at_10"), F.round(F.when(F.col("total") == 0, 0.0).otherwise(F.col("found") / F.col("total")), 5).alias("recall_at_10"),
        F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 5).alias("ndcg_at_10"), F.round(F.coalesce(1 / F.col("hit"), F.lit(0.0)), 5).alias("mrr"),
    )


_PER_QUERY = ORACLES["ir_metrics"]


@query(f"WITH q AS ({_PER_QUERY}), u AS (UNPIVOT q ON precision_at_10, recall_at_10, ndcg_at_10, mrr INTO NAME metric VALUE v) SELECT label, metric, round(avg(v), 4) AS macro FROM u GROUP BY label, metric")
def ir_macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ir_metrics(spark, sf_dir).unpivot(["query_id", "label"], ["precision_at_10", "recall_at_10", "ndcg_at_10", "mrr"], "metric", "v")
    return m.groupBy("label", "metric").agg(F.round(F.avg("v"), 4).alias("macro"))


BUDGET = 0.9000001


@query(f"""WITH {SCORED}, seeds AS (SELECT query_id, vec_id, label, 1 - score AS cost FROM ranked WHERE rank <= 10 AND score >= 0.2),
sib AS (SELECT s.query_id, e.vec_id, s.cost + 1 - round(greatest(0.0, least(1.0, list_cosine_similarity(p.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 6) AS cost
  FROM seeds s JOIN embeddings p ON p.vec_id = s.vec_id JOIN embeddings e ON e.label = s.label AND e.vec_id <> s.vec_id),
a AS (SELECT query_id, vec_id, cost FROM seeds UNION ALL SELECT * FROM sib)
SELECT query_id, vec_id, round(min(cost), 6) AS cost FROM a GROUP BY query_id, vec_id HAVING min(cost) <= 0.9000001""")
def semantic_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds at 1 - similarity, then siblings (same label) at the further cost of 1 - cosine, within a budget."""
    t = Tables(spark, sf_dir)
    seeds = near(t, 10).filter("score >= 0.2").select("query_id", F.col("vec_id").alias("seed"), F.col("label").alias("seed_label"), (1 - F.col("score")).alias("cost"))
    seeds = written(seeds, "seeds")
    # only siblings that the rest of the budget reaches leave their block
    from_seed = seeds.join(t.embeddings.select(F.col("vec_id").alias("seed"), F.col("embedding").alias("qe")), "seed").withColumn("needed", F.col("cost") + 1 - BUDGET)
    step = R.nearest(from_seed, t.embeddings.select("vec_id", "label", "embedding"), 0, query_id="seed", same=("seed_label", "label"), least="needed")
    reached = seeds.select("query_id", F.col("seed").alias("vec_id"), "cost").unionByName(step.select("query_id", "vec_id", (F.col("cost") + 1 - F.col("score")).alias("cost")))
    return reached.groupBy("query_id", "vec_id").agg(F.min("cost").alias("c")).filter(F.col("c") <= BUDGET).select("query_id", "vec_id", F.round("c", 6).alias("cost"))


@query(f"""WITH {SCORED}, h AS (SELECT query_id, vec_id, label, score, CASE WHEN score > 0.9 THEN 2 WHEN score >= 0.3 THEN 1 ELSE 0 END AS hops FROM ranked WHERE rank <= 40),
n AS (SELECT h.query_id, h.vec_id, e.vec_id AS other, row_number() OVER (PARTITION BY h.query_id, h.vec_id ORDER BY e.vec_id) AS r, hops FROM h JOIN embeddings e ON e.label = h.label AND e.vec_id <> h.vec_id AND hops > 0)
SELECT h.query_id, h.vec_id, h.hops, count(other) AS neighbours FROM h LEFT JOIN n ON n.query_id = h.query_id AND n.vec_id = h.vec_id AND n.r <= 20 * n.hops GROUP BY 1, 2, 3""")
def graph_vector_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity band of a hit sets its hop budget, and the budget the number of neighbours."""
    t = Tables(spark, sf_dir)
    hops = F.when(F.col("score") > 0.9, 2).when(F.col("score") >= 0.3, 1).otherwise(0)
    h = near(t, 40).select("query_id", "vec_id", "label", hops.alias("hops"))
    sizes = t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n"))  # neighbours are counted, not listed: label size less itself, up to the limit
    n = F.when(F.col("hops") > 0, F.least(F.col("n") - 1, 20 * F.col("hops"))).otherwise(0)
    return h.join(sizes, "label").select("query_id", "vec_id", "hops", n.cast("long").alias("neighbours"))


@query(f"""WITH {SCORED}, h AS (SELECT query_id, vec_id, label, score FROM ranked WHERE rank <= 10),
c AS (SELECT query_id, label, count(*) AS freq, max(score) AS best FROM h GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, label AS community, freq, best, row_number() OVER (PARTITION BY query_id ORDER BY freq DESC, best DESC, label) AS r FROM c) WHERE r <= 3""")
def local_community_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three communities (labels) most frequent among the ten nearest entities."""
    c = near(Tables(spark, sf_dir), 10).groupBy("query_id", F.col("label").alias("community")).agg(F.count(F.lit(1)).alias("freq"), F.max("score").alias("best"))
    w = Window.partitionBy("query_id").orderBy(F.desc("freq"), F.desc("best"), "community")
    return c.withColumn("r", F.row_number().over(w)).filter("r <= 3")


EDGE_VECTORS = """ev AS (SELECT a.vec_id AS edge_id, list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE + p[2]::DOUBLE) / 2) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
es AS (SELECT q.vec_id AS query_id, ev.edge_id, round(greatest(0.0, least(1.0, list_cosine_similarity(ev.v, q.embedding::DOUBLE[]))), 6) AS score FROM ev JOIN embeddings q ON q.vec_id % 20 = 0)"""


@query(f"WITH {EDGE_VECTORS} SELECT query_id, edge_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, edge_id) AS rank FROM es) WHERE rank <= 5")
def edge_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top edges by the cosine of their vector, the mean of their ends' vectors."""
    e = Tables(spark, sf_dir).embeddings
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    mean = F.zip_with("embedding", "other", lambda x, y: (x.cast("double") + y.cast("double")) / 2)
    edges = e.join(nxt, "vec_id").select(F.col("vec_id").alias("edge_id"), mean.alias("v"))
    q = e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"))
    return R.nearest(q, edges, 5, row_id="edge_id", vector="v", others=False).select("query_id", "edge_id", "score", "rank")


@query("SELECT vec_id, label, len(embedding) AS dims, [label::VARCHAR, 'vector'] AS labels FROM embeddings")
def project_without_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields but the vector; labels without the internal one."""
    e = Tables(spark, sf_dir).embeddings
    labels = F.array_remove(F.array(F.col("label").cast("string"), F.lit("__Entity__"), F.lit("vector")), "__Entity__")
    return e.withColumns({"dims": F.size("embedding"), "labels": F.when(F.size(labels) == 0, F.array(F.lit("*"))).otherwise(labels)}).drop("embedding")


_W = r"[^\p{L}\p{N}]+"


@query(f"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '{_W}'), lambda w: w <> '') AS words FROM documents WHERE text IS NOT NULL),
n AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM d), tf AS (SELECT doc_id, len(words) AS size, unnest(words) AS term FROM d),
t AS (SELECT doc_id, size, term, count(*) AS tf FROM tf GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(lower(text), '{_W}'), lambda w: w <> '')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM q JOIN t USING (term) JOIN df USING (term) CROSS JOIN n GROUP BY 1, 2)
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def keyword_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark passage by BM25, from stored posting lists."""
    t = Tables(spark, sf_dir)
    found = KeywordIndex.build(t.documents).search(t.benchmark, 10, "item_id", "text")
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


@query()
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows as an inverted-file index finds them that probes two thirds of its lists: these vectors hardly cluster, and a recall of 0.9 asks for as many."""
    t = Tables(spark, sf_dir)
    index = VectorIndex.build(t.embeddings)
    lists = index.spark.read.parquet(f"{index.path}/lists").count()
    return index.search(asked(t), 10, max(1, -(-lists * 2 // 3))).select("query_id", "vec_id", "score", "rank")


@query(f"WITH {SCORED} SELECT query_id, vec_id, score, rank FROM ranked WHERE score >= 0.3")
def vector_index_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a cosine of 0.3 or more, by the index: exact, as lists too far off by their angle can't hold any."""
    t = Tables(spark, sf_dir)
    return VectorIndex.build(t.embeddings).within(asked(t), 0.3).select("query_id", "vec_id", "score", "rank")


EXPANDED = f"""WITH RECURSIVE {SCORED}, n AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'chapter' ELSE 'article' END AS kind, embedding::DOUBLE[] AS v FROM embeddings),
edges AS (SELECT id AS src, id // 10 AS dst, 'parent' AS type FROM n WHERE id >= 10 UNION SELECT id // 10, id, 'child' FROM n WHERE id >= 10 UNION SELECT a.id, b.id, 'sibling' FROM n a JOIN n b ON abs(a.id - b.id) = 1),
q AS (SELECT id AS query_id, v FROM n WHERE id % 20 = 0),
s AS (SELECT q.query_id, n.id AS node, round(1 - round(greatest(0.0, least(1.0, list_cosine_similarity(q.v, n.v))), 6), 9) AS cost, row_number() OVER (PARTITION BY q.query_id ORDER BY round(greatest(0.0, least(1.0, list_cosine_similarity(q.v, n.v))), 6) DESC, n.id) AS r FROM q CROSS JOIN n WHERE kind = 'article'),
c AS (SELECT q.query_id, src, dst, CASE WHEN type = 'sibling' THEN 1 - round(greatest(0.0, least(1.0, list_cosine_similarity(q.v, n.v))), 6) ELSE 0.0 END AS step FROM q CROSS JOIN edges JOIN n ON n.id = dst),
w AS (SELECT query_id, node, cost FROM s WHERE r <= 10 AND cost <= 1 UNION SELECT w.query_id, c.dst, round(w.cost + c.step, 9) FROM w JOIN c ON c.query_id = w.query_id AND c.src = w.node WHERE w.cost + c.step <= 1.000000001),
b AS (SELECT query_id, node AS id, min(cost) AS cost FROM w JOIN n ON n.id = node AND kind = 'article' GROUP BY 1, 2)
SELECT query_id, id, round(1 - cost, 4) AS relevance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cost, id) AS rank FROM b)"""


def _law_graph(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, nodes and edges: a tree by tens over the vectors, neighbours as siblings."""
    i = F.col("vec_id")
    nodes = t.embeddings.select(i.alias("id"), F.when(i % 3 == 0, "chapter").otherwise("article").alias("kind"), "embedding")
    up = F.floor(i / 10).cast("long")
    tree = t.embeddings.filter("vec_id >= 10")
    aside = t.embeddings.select(i.alias("src"), F.explode(F.array(i - 1, i + 1)).alias("dst"), F.lit("sibling").alias("type"))
    edges = tree.select(i.alias("src"), up.alias("dst"), F.lit("parent").alias("type")).unionByName(tree.select(up.alias("src"), i.alias("dst"), F.lit("child").alias("type"))).unionByName(aside)
    return asked(t).select("query_id", "qe"), nodes, edges


@query(EXPANDED)
def semantic_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles within a cost of one over several hops from each question's ten nearest."""
    return expand(*_law_graph(Tables(spark, sf_dir)), seeds=10, least=0.0, via=False)


@query(f"SELECT * FROM ({EXPANDED}) WHERE rank <= 5")
def semantic_first_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five articles of the same expansion, in order of relevance."""
    return expand(*_law_graph(Tables(spark, sf_dir)), seeds=10, least=0.0, first=5, via=False)


@query(f"""WITH {SCORED} SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM scored WHERE query_id = 20 AND label <> 3 QUALIFY rank <= 8""")
def procedure_vector_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of vector 20 that aren't of label 3, by a table function that SQL calls over a view of the caller's own."""
    t = Tables(spark, sf_dir)
    t.embeddings.filter("label <> 3 and vec_id <> 20").createOrReplaceTempView("loom_vectors")
    procedures.register_vector_query(spark, "loom_vector_query", "loom_vectors", "vec_id", "embedding")
    t.embeddings.filter("vec_id = 20").createOrReplaceTempView("loom_asked")
    return spark.sql("SELECT vec_id, score, rank FROM loom_vector_query((SELECT CAST(embedding AS ARRAY<DOUBLE>) FROM loom_asked), 8)")


_LINKS = "WITH e AS (SELECT DISTINCT l_orderkey AS a, l_suppkey + 1000000000 AS b FROM lineitem UNION SELECT l_suppkey + 1000000000, l_orderkey FROM lineitem)"


@query(f"""{_LINKS}, s AS (SELECT min(l_suppkey) + 1000000000 AS s FROM lineitem), h0 AS (SELECT s AS node, 0 AS hops FROM s), h1 AS (SELECT DISTINCT b AS node, 1 AS hops FROM h0 JOIN e ON a = node), h2 AS (SELECT DISTINCT b AS node, 2 AS hops FROM h1 JOIN e ON a = node)
SELECT node, min(hops) AS hops FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY node""")
def procedure_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and suppliers within two steps of the first supplier, by a table function."""
    o, s = F.col("l_orderkey"), F.col("l_suppkey") + 1_000_000_000
    lines = Tables(spark, sf_dir).lineitem
    lines.select(o.alias("a"), s.alias("b")).unionByName(lines.select(s.alias("a"), o.alias("b"))).distinct().createOrReplaceTempView("loom_links")
    lines.agg(F.min(s).alias("s")).createOrReplaceTempView("loom_start")
    procedures.register_neighbours(spark, "loom_neighbours", "loom_links", "a", "b")
    return spark.sql("SELECT node, hops FROM loom_neighbours((SELECT s FROM loom_start), 2)")


@query(f"""WITH {SCORED}, h AS (SELECT query_id, vec_id AS entity, CASE WHEN score > 0.9 THEN 2 WHEN score >= 0.3 THEN 1 ELSE 0 END AS steps, CASE WHEN score > 0.9 THEN 40 ELSE 20 END AS most FROM ranked WHERE rank <= 10),
l AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM embeddings a JOIN embeddings b ON b.vec_id IN (a.vec_id + 1, a.vec_id * 2, a.vec_id // 3)),
b AS (SELECT src AS a, dst AS b FROM l UNION SELECT dst, src FROM l),
m AS (SELECT query_id, entity, most, b AS n, 1 AS hops FROM h JOIN b ON a = entity WHERE steps > 0 UNION ALL SELECT query_id, entity, most, y.b, 2 FROM h JOIN b x ON x.a = entity JOIN b y ON y.a = x.b WHERE steps > 1),
d AS (SELECT query_id, entity, most, n, min(hops) AS hops FROM m WHERE n <> entity GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, entity ORDER BY hops, n) AS nth FROM d)
SELECT query_id, entity AS entity_id, n AS neighbour, hops FROM k WHERE nth <= most""")
def graph_vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each question's ten nearest entities along a graph, as many steps and nodes as the similarity allows."""
    t = Tables(spark, sf_dir)
    i = F.col("vec_id")
    e = t.embeddings.select(i.alias("src"), F.explode(F.array(i + 1, i * 2, F.floor(i / 3).cast("long"))).alias("dst"))
    links = e.join(t.embeddings.select(i.alias("dst")), "dst", "left_semi").select("src", "dst")
    return R.neighbourhood(near(t, 10).select("query_id", F.col("vec_id").alias("entity_id"), "score"), links)


@query(f"""WITH {SCORED}, h AS (SELECT * FROM ranked WHERE rank <= 10)
SELECT query_id, count(*) AS used, round(avg(score), 6) AS mean_score, string_agg('label ' || label || ' of ' || vec_id, chr(10) || chr(10) ORDER BY rank) AS summaries FROM h GROUP BY 1""")
def global_community_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest community summaries of each question, joined in order, with their mean score."""
    h = near(Tables(spark, sf_dir), 10).withColumn("s", F.concat(F.lit("label "), "label", F.lit(" of "), "vec_id"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "s"))), lambda x: x["s"]), "\n\n")
    return h.groupBy("query_id").agg(F.count(F.lit(1)).alias("used"), F.round(F.avg("score"), 6).alias("mean_score"), text.alias("summaries"))
