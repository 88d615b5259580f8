"""Documents to chunks, pages and relations: text queries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import captions, statute
from loomgraph.plans.registry import registry
from loomgraph.session import TASK_ROWS, spread, written
from loomgraph.sources.tables import Tables

QUERIES, ORACLES, query = registry()

#: Rows of a brand that a block holds at most, blocks that a block meets in one task, and pairs that a task writes on average.
SIMILARITY_ROWS, SIMILARITY_BLOCKS, SIMILARITY_PAIRS = 2000, 32, 100_000_000

SIZE, STEP = 50, 40  # tokens of a chunk and from one chunk's start to the next
CHUNKS = f"""tok AS (SELECT doc_id, string_split_regex(trim(text), '[ \\n]+') AS t FROM documents),
ch AS (SELECT doc_id, p // {STEP} AS position, list_slice(t, p + 1, p + {SIZE}) AS words FROM tok, range(0, greatest(len(t) - {SIZE - STEP}, 1), {STEP}) AS x(p)),
c AS (SELECT doc_id, position, len(words) AS tokens, array_to_string(words, ' ') AS body FROM ch)"""


def chunks(t: Tables) -> DataFrame:
    """Windows of whitespace tokens with overlap: ``doc_id, position, tokens, body``; no shuffle."""
    d = t.documents.select("doc_id", F.split(F.trim("text"), "[ \\n]+").alias("t"))
    return X.token_windows(d, "t", SIZE, STEP)


@query(f"WITH {CHUNKS} SELECT doc_id, position, tokens, sha1(body) AS chunk_id FROM c")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping token windows; a chunk's id is the hash of its text, so equal text is one chunk with several documents."""
    return chunks(Tables(spark, sf_dir)).select("doc_id", "position", "tokens", F.sha1("body").alias("chunk_id"))


@query(f"""WITH {CHUNKS} SELECT doc_id, position, length(body) AS length, (coalesce(sum(length(body)) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS content_offset,
lag(sha1(body)) OVER (PARTITION BY doc_id ORDER BY position) AS previous, CASE WHEN position = 0 THEN 'FIRST_CHUNK' ELSE 'NEXT_CHUNK' END AS link FROM c""")
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIRST and NEXT links with running content offsets."""
    w = Window.partitionBy("doc_id").orderBy("position")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    c = chunks(Tables(spark, sf_dir)).withColumn("length", F.length("body"))
    return c.select(
        "doc_id", "position", "length", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("content_offset"), F.lag(F.sha1("body")).over(w).alias("previous"),
        F.when(F.col("position") == 0, "FIRST_CHUNK").otherwise("NEXT_CHUNK").alias("link"),
    )


@query("SELECT doc_id, source, (SELECT ceil(count(*) / 25.0) FROM documents)::BIGINT AS pages FROM documents ORDER BY doc_id LIMIT 25 OFFSET 50")
def chunk_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page three of 25 rows, with the number of pages."""
    d = Tables(spark, sf_dir).documents
    pages = d.agg(F.ceil(F.count(F.lit(1)) / 25).alias("pages")).withColumn("k", F.lit(1))
    return d.orderBy("doc_id").offset(50).limit(25).select("doc_id", "source", F.lit(1).alias("k")).join(F.broadcast(pages), "k").drop("k")


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked_in FROM conversations""")
def carry_forward_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row carries the last heading (user turn) above it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", "role", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("asked_in"))


@query("""WITH a AS (SELECT conv_id, 'article' AS level, 0::BIGINT AS pos, string_agg(text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, 'paragraph' AS level, turn + 1 AS pos, text AS content FROM conversations), u AS (SELECT * FROM a UNION ALL SELECT * FROM p)
SELECT conv_id, level, pos, sha1(content) AS content_sha1, 'chunk_' || lpad((row_number() OVER (PARTITION BY conv_id ORDER BY pos))::VARCHAR, 5, '0') AS chunk_id FROM u""")
def multi_level_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for the whole and one for each part, numbered depth first within the document."""
    c = Tables(spark, sf_dir).conversations
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("content"))
    u = whole.select("conv_id", F.lit("article").alias("level"), F.lit(0).cast("long").alias("pos"), "content").unionByName(c.select("conv_id", F.lit("paragraph").alias("level"), (F.col("turn") + 1).alias("pos"), F.col("text").alias("content")))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("pos"))
    return u.select("conv_id", "level", "pos", F.sha1("content").alias("content_sha1"), F.format_string("chunk_%05d", n).alias("chunk_id"))


@query("""SELECT a.conv_id, a.turn, sha1(trim(right(a.text, 100)) || ' -> ' || trim(left(b.text, 100))) AS context_sha1,
CASE WHEN regexp_matches(lower(b.text), 'licen[cs]e|copyright') THEN 'LEGAL' WHEN regexp_matches(b.text, '[0-9]{3,}') THEN 'NUMERIC' WHEN regexp_matches(b.text, '[?]') THEN 'QUESTION' ELSE 'GENERAL' END AS semantic_type
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def relation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last 100 characters of the parent to the first 100 of the child, and the first class whose pattern matches."""
    c = Tables(spark, sf_dir).conversations
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("child"))
    j = c.join(b, ["conv_id", "turn"])
    context = F.concat(F.trim(F.right("text", F.lit(100))), F.lit(" -> "), F.trim(F.left("child", F.lit(100))))
    kind = X.first_class(F.col("child"), (("LEGAL", "(?i)licen[cs]e|copyright"), ("NUMERIC", "[0-9]{3,}"), ("QUESTION", "[?]")), "GENERAL")
    return j.select("conv_id", "turn", F.sha1(context).alias("context_sha1"), kind.alias("semantic_type"))


@query("""SELECT doc_id, m AS match, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+ [a-z]+ [a-z]+\\.')) AS m FROM documents) GROUP BY 1, 2""")
def regex_extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+ [a-z]+ [a-z]+\\."), F.lit(0))).alias("match"))
    return d.groupBy("doc_id", "match").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1) AS lang, try_cast(nullif(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2), '') AS BIGINT) AS number,
contains(url, '?') AS has_query FROM pages""")
def metadata_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed parts of a locator by pattern."""
    url = F.col("url")
    path = r"/([a-z]{2})/([0-9]+)"
    return Tables(spark, sf_dir).pages.select(
        "page_id", F.regexp_extract(url, "^https?://([^/]+)", 1).alias("host"), F.regexp_extract(url, path, 1).alias("lang"),
        F.expr(f"try_cast(nullif(regexp_extract(url, '{path}', 2), '') AS BIGINT)").alias("number"), F.contains(url, F.lit("?")).alias("has_query"),
    )


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page text: scripts and styles dropped, tags to spaces, runs of space to one."""
    return Tables(spark, sf_dir).pages.select("page_id", X.strip_tags(F.col("html")).alias("body"))


@query("""WITH b AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS page FROM conversations)
SELECT conv_id, page::BIGINT AS page, count(*) AS elements, string_agg(text, '' ORDER BY turn) AS body FROM b GROUP BY conv_id, page""")
def element_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements joined into pages, a new page at each break."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    b = Tables(spark, sf_dir).conversations.withColumn("page", F.sum((F.col("role") == "user").cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "")
    return b.groupBy("conv_id", "page").agg(F.count(F.lit(1)).alias("elements"), body.alias("body"))


@query("""WITH e AS (SELECT user_id, (floor(epoch(ts)) - min(floor(epoch(ts))) OVER (PARTITION BY user_id))::BIGINT AS s, event_id FROM events),
b AS (SELECT user_id, s // 86400 AS bucket, min(s) AS lo, max(s) AS hi, count(*) AS n FROM e GROUP BY 1, 2)
SELECT user_id, bucket, n, (lo // 3600) || ':' || lpad(((lo // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad((lo % 60)::VARCHAR, 2, '0') AS started, (hi // 3600) || ':' || lpad(((hi // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad((hi % 60)::VARCHAR, 2, '0') AS ended FROM b""")
def time_bucket_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed buckets of elapsed time with H:MM:SS stamps."""
    sec = F.unix_timestamp(F.col("ts").cast("timestamp"))
    e = Tables(spark, sf_dir).events.withColumn("s", sec - F.min(sec).over(Window.partitionBy("user_id")))
    b = e.groupBy("user_id", F.floor(F.col("s") / 86400).alias("bucket")).agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count(F.lit(1)).alias("n"))
    return b.select("user_id", "bucket", "n", X.h_mm_ss(F.col("lo")).alias("started"), X.h_mm_ss(F.col("hi")).alias("ended"))


@query("SELECT doc_id, sha1(text) AS merged_sha1, ceil(length(text) / 1000.0)::BIGINT AS parts FROM documents WHERE length(text) > 0")
def part_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into numbered parts and merged again in order; the merge equals the source."""
    d = Tables(spark, sf_dir).documents.filter(F.length("text") > 0)
    parts = d.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / 1000).cast("int") - 1), lambda i: F.substr(F.col("text"), i * 1000 + 1, F.lit(1000)))).alias("k", "part"))
    merged = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "")
    return parts.groupBy("doc_id").agg(F.sha1(merged).alias("merged_sha1"), F.count(F.lit(1)).alias("parts"))


@query(r"""SELECT doc_id, sha1(trim(regexp_replace(regexp_replace(regexp_replace(text, '[#$%&*`]+', '', 'g'), '[ \t]+', ' ', 'g'), '\n{2,}', chr(10), 'g'))) AS cleaned_sha1 FROM documents WHERE trim(text) <> ''""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks dropped, runs of blanks and of empty lines to one; blank rows go."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[#$%&*`]+", ""), "[ \\t]+", " "), "\\n{2,}", "\n")
    return Tables(spark, sf_dir).documents.filter(F.trim("text") != "").select("doc_id", F.sha1(F.trim(t)).alias("cleaned_sha1"))


@query("""SELECT doc_id, p AS found_at, trim(substring(text, greatest(1, p - 50), p + 50 - greatest(1, p - 50))) AS context, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END = text AS whole
FROM (SELECT doc_id, text, position('ion' IN text) AS p FROM documents) WHERE p > 0""")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty characters on each side of the first match, clipped; and whether an embedding text would be whole."""
    d = Tables(spark, sf_dir).documents.withColumn("p", F.locate("ion", F.col("text"))).filter("p > 0")
    lo = F.greatest(F.lit(1), F.col("p") - 50)
    return d.select("doc_id", F.col("p").alias("found_at"), F.trim(F.substr("text", lo, F.col("p") + 50 - lo)).alias("context"), (F.length("text") <= 500).alias("whole"))


@query("""WITH p AS (SELECT p_partkey, p_brand, lower(p_name) AS n, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part),
x AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.n AS na, b.n AS nb, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS la, len(b.w) AS lb FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey)
SELECT a, b, levenshtein(na, nb) AS edits, round(i / (la + lb - i), 5) AS jaccard, round(2.0 * i / (la + lb), 5) AS f1 FROM x""")
def string_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance, Jaccard and token F1 of names under the same brand. Each brand is cut by its keys into blocks whose pairs are spread over all tasks; in a pair of blocks equal names are measured once.

    Pairs are as many as the square of a brand, so their order is what a file of
    them costs: of two names one key runs over the other's list, and a task
    holds few blocks, so columns are runs and repeats of a small dictionary.
    """
    p = Tables(spark, sf_dir).part.select("p_brand", "p_partkey", F.lower("p_name").alias("n")).filter("p_brand is not null and p_partkey is not null")
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(p.count() / TASK_ROWS))
    p = p.repartitionByRange(tasks, "p_brand", "p_partkey").sortWithinPartitions("p_brand", "p_partkey")
    p = p.withColumn("block", F.floor(F.monotonically_increasing_id() / SIMILARITY_ROWS))
    named = written(p.groupBy("p_brand", "block", "n").agg(F.sort_array(F.collect_list("p_partkey")).alias("k")).withColumn("w", F.array_distinct(F.split("n", " "))), "named")
    of_brand = Window.partitionBy("p_brand")
    blocks = named.groupBy("p_brand", "block").agg(F.sum(F.size("k")).alias("rows"))
    blocks = blocks.select("p_brand", "block", (F.row_number().over(of_brand.orderBy("block")) - 1).alias("nth"), F.count(F.lit(1)).over(of_brand).cast("int").alias("blocks"), F.sum("rows").over(of_brand).alias("rows"))
    blocks = written(blocks, "blocks")
    expected = blocks.agg(F.sum(F.col("rows") * F.col("rows") / F.col("blocks") / 2)).first()[0] or 0.0
    named = named.join(blocks, ["p_brand", "block"])
    a = named.select("p_brand", F.col("nth").alias("i"), F.explode(F.sequence("nth", F.col("blocks") - 1)).alias("j"), F.col("k").alias("ka"), F.col("n").alias("na"), F.col("w").alias("wa"))
    b = named.select("p_brand", F.explode(F.sequence(F.lit(0), "nth")).alias("i"), F.col("nth").alias("j"), F.col("k").alias("kb"), F.col("n").alias("nb"), F.col("w").alias("wb"))
    near = lambda side: spread(side.withColumn("strip", F.floor(F.col("j") / SIMILARITY_BLOCKS)), "p_brand", "i", "strip", least=math.ceil(expected / SIMILARITY_PAIRS))
    met = near(b).join(near(a), ["p_brand", "i", "strip", "j"])  # in this order: a list of later keys repeats under all earlier names
    i = F.size(F.array_intersect("wa", "wb"))
    total = F.size("wa") + F.size("wb")
    met = met.select("ka", "kb", F.levenshtein("na", "nb").alias("edits"), F.round(i / (total - i), 5).alias("jaccard"), F.round(2 * i / total, 5).alias("f1"))
    # keys of an earlier block are never larger
    return met.withColumn("a", F.explode("ka")).withColumn("b", F.explode("kb")).filter("a < b").select("a", "b", "edits", "jaccard", "f1")


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, (extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts)))::BIGINT AS second_of_day, strftime(ts, '%Y-%m') AS month FROM events""")
def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).events.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long").alias("second_of_day"), F.date_format("ts", "yyyy-MM").alias("month"),
    )


@query(f"""WITH {CHUNKS}, s AS (SELECT doc_id, position, len(list_filter(string_split(lower(body), ' '), lambda w: w IN ('the', 'of', 'and', 'that'))) / tokens AS share FROM c)
SELECT doc_id, position, round(share, 5) AS share FROM s WHERE share >= 0.1""")
def resplit_and_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks again, kept where their score reaches the filter."""
    hits = F.size(F.filter(F.split(F.lower("body"), " "), lambda w: w.isin("the", "of", "and", "that")))
    c = chunks(Tables(spark, sf_dir)).withColumn("share", hits / F.col("tokens"))
    return c.filter("share >= 0.1").select("doc_id", "position", F.round("share", 5).alias("share"))


@query("""WITH done AS (SELECT doc_id FROM labels), g AS (SELECT d.source, min(d.doc_id) AS gap FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM done WHERE doc_id IS NOT NULL) GROUP BY 1)
SELECT d.source, d.doc_id FROM documents d JOIN g ON g.source = d.source AND d.doc_id >= g.gap""")
def resume_unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, everything from the first unprocessed document on."""
    t = Tables(spark, sf_dir)
    d = t.documents.select("source", "doc_id")
    gap = d.join(t.labels, "doc_id", "left_anti").groupBy("source").agg(F.min("doc_id").alias("gap"))
    return d.join(gap, "source").filter("doc_id >= gap").select("source", "doc_id")


@query()
def statute_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statute-like document per order, parsed into its units."""
    t = Tables(spark, sf_dir)
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.lit(0).alias("line_number"), F.format_string("제%d조(주문) 금액 %s <개정 2020.1.2.>", F.col("o_orderkey"), F.col("o_orderpriority")).alias("text"))
    li = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line_number"), F.format_string("%d. 품목 %d", F.col("l_linenumber"), F.col("l_partkey")).alias("text"))
    lines = o.unionByName(li.withColumn("text", F.when(F.col("line_number") == 1, F.concat(F.lit("① "), F.col("text"))).otherwise(F.col("text"))))
    return statute.units(lines.select(F.concat(F.lit("doc"), F.col("k")).alias("doc"), "line_number", "text"))


@query("""WITH k AS (SELECT o_orderkey AS k, 'doc' || o_orderkey || CASE o_orderstatus WHEN 'F' THEN '(법률)' WHEN 'O' THEN '(시행령)' ELSE '' END AS law FROM orders),
jo AS (SELECT k, law, law || '::JO:' || k || '조' AS id FROM k), hang AS (SELECT DISTINCT k, id AS up, id || '::HANG:①' AS id FROM jo JOIN lineitem ON l_orderkey = k WHERE l_linenumber = 1),
ho AS (SELECT DISTINCT k, id AS up, id || '::HO:' || l_linenumber AS id, l_linenumber AS n FROM hang JOIN lineitem ON l_orderkey = k WHERE l_linenumber > 1)
SELECT law AS src, id AS dst, 'CONTAINS' AS type FROM jo UNION ALL SELECT up, id, 'CONTAINS' FROM hang UNION ALL SELECT up, id, 'CONTAINS' FROM ho
UNION ALL SELECT * FROM (SELECT id AS src, lead(id) OVER (PARTITION BY up ORDER BY n) AS dst, 'NEXT' AS type FROM ho) WHERE dst IS NOT NULL""")
def statute_unit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CONTAINS and NEXT edges of the parsed units, by ids that name the kind of law."""
    o = Tables(spark, sf_dir).orders
    kind = F.when(F.col("o_orderstatus") == "F", "법률").when(F.col("o_orderstatus") == "O", "시행령")
    laws = o.select(F.concat(F.lit("doc"), "o_orderkey").alias("doc"), kind.alias("category"))
    return statute.unit_edges(statute.typed_ids(statute_units(spark, sf_dir), laws)).select("src", "dst", "type")


@query("""WITH c AS (SELECT DISTINCT l_partkey AS rule_id, l_orderkey + 7 AS article_id FROM lineitem WHERE l_quantity > 25)
SELECT p_partkey AS rule_id, count(article_id) AS cited, count(o_orderkey) AS resolved, string_agg(o_orderpriority || ' ' || article_id, '; ' ORDER BY article_id) AS articles
FROM part LEFT JOIN c ON rule_id = p_partkey LEFT JOIN orders ON o_orderkey = article_id GROUP BY 1""")
def rule_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles that each rule cites, by joins: how many, how many of them are known, and their titles."""
    t = Tables(spark, sf_dir)
    cited = t.lineitem.filter("l_quantity > 25").select(F.col("l_partkey").alias("rule_id"), (F.col("l_orderkey") + 7).alias("article_id"))
    found = statute.resolved_articles(t.part.select(F.col("p_partkey").alias("rule_id")), cited, t.orders.select(F.col("o_orderkey").alias("article_id"), F.col("o_orderpriority").alias("title")))
    told = F.array_sort(F.collect_list(F.when(F.col("title").isNotNull(), F.struct("article_id", F.concat("title", F.lit(" "), F.col("article_id").cast("string")).alias("s")))))
    joined = F.when(F.count("title") > 0, F.array_join(F.transform(told, lambda x: x["s"]), "; "))
    return found.groupBy("rule_id").agg(F.count("article_id").alias("cited"), F.count("title").alias("resolved"), joined.alias("articles"))


#: A unit per order that hands a matter down and cites an article.
_CLAUSE = """u AS (SELECT 'doc' || o_orderkey AS full_id, o_orderpriority || ' 필요한 사항은 ' || CASE o_orderkey % 6 WHEN 0 THEN '대통령령으로 정한다' WHEN 1 THEN '국토교통부령으로  정하는 바에 따른다' WHEN 2 THEN '총리령으로 정한다' WHEN 3 THEN '국토교통부령으로 정한다' WHEN 4 THEN '조례로 정한다' ELSE '따로 정한다' END
|| '. 이 경우 「' || CASE WHEN o_orderkey % 4 = 0 THEN '건축법' ELSE '주차장법 시행령' END || '」 ' || CASE WHEN o_orderkey % 5 > 0 THEN '제' || (o_orderkey % 90 + 1) || '조를 따르며 그 밖의 것은 이 조에서 정하는 바에 따라 처리하여야 한다' ELSE '전부를 따른다' END AS content FROM orders)"""


def _clauses(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    words = ("대통령령으로 정한다", "국토교통부령으로  정하는 바에 따른다", "총리령으로 정한다", "국토교통부령으로 정한다", "조례로 정한다", "따로 정한다")
    matter = F.element_at(F.array(*[F.lit(w) for w in words]), (k % 6 + 1).cast("int"))
    law = F.when(k % 4 == 0, "건축법").otherwise("주차장법 시행령")
    rest = F.when(k % 5 > 0, F.concat(F.lit("제"), (k % 90 + 1).cast("string"), F.lit("조를 따르며 그 밖의 것은 이 조에서 정하는 바에 따라 처리하여야 한다"))).otherwise("전부를 따른다")
    return t.orders.select(F.concat(F.lit("doc"), k).alias("full_id"), F.concat("o_orderpriority", F.lit(" 필요한 사항은 "), matter, F.lit(". 이 경우 「"), law, F.lit("」 "), rest).alias("content"))


_PHRASES = ", ".join(f"('{p}', '{to}')" for p, to in statute.DELEGATIONS)


@query(f"""WITH {_CLAUSE}, p(pattern, delegation_type) AS (VALUES {_PHRASES}), f AS (SELECT full_id, content, delegation_type, regexp_extract(content, pattern) AS found FROM u JOIN p ON regexp_matches(content, pattern))
SELECT full_id AS from_id, delegation_type, found AS pattern_found, trim(substr(content, greatest(1, strpos(content, found) - 50), least(50, strpos(content, found) - 1) + length(found) + 50)) AS context FROM f""")
def statute_delegations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that hand a matter down to a decree, rule or ordinance, with their context."""
    return statute.delegations(_clauses(Tables(spark, sf_dir)))


@query(f"""WITH {_CLAUSE}, f AS (SELECT full_id, content, regexp_extract(content, '「([^」]+)」\\s*제(\\d+)조') AS found FROM u)
SELECT full_id AS from_id, regexp_extract(found, '「([^」]+)」', 1) AS referenced_law, regexp_extract(found, '제\\d+조') AS referenced_article,
trim(substr(content, greatest(1, strpos(content, found) - 30), least(30, strpos(content, found) - 1) + length(found) + 30)) AS context FROM f WHERE found <> ''""")
def statute_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of articles of other laws, with their context."""
    return statute.references(_clauses(Tables(spark, sf_dir)))


@query(f"""WITH {_CLAUSE} SELECT full_id AS src, regexp_extract(content, '「([^」]+)」', 1) || '::' || regexp_extract(content, '」\\s*(제\\d+조)', 1) AS dst, 'CITES' AS type, count(*) AS times
FROM u WHERE regexp_matches(content, '」\\s*제\\d+조') GROUP BY 1, 2""")
def statute_citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CITES edges from units to articles of laws."""
    return statute.citation_edges(_clauses(Tables(spark, sf_dir)))


@query("""WITH c AS (SELECT c_nationkey AS base, c_mktsegment AS category, max_by(c_name, c_custkey) AS name FROM customer GROUP BY 1, 2)
SELECT a.base, a.name AS statute, b.name AS decree, 'ENFORCED_BY' AS type FROM c a JOIN c b ON a.base = b.base AND a.category = 'BUILDING' AND b.category = 'MACHINERY'
UNION ALL SELECT a.base, a.name, b.name, 'DETAILED_BY' FROM c a JOIN c b ON a.base = b.base AND a.category = 'MACHINERY' AND b.category = 'FURNITURE'""")
def law_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statute to decree and decree to rule per base name; of several in a category the last one wins."""
    def last(category: str) -> Column:
        return F.max_by(F.when(F.col("c_mktsegment") == category, F.col("c_name")), F.when(F.col("c_mktsegment") == category, F.col("c_custkey")))

    g = Tables(spark, sf_dir).customer.groupBy(F.col("c_nationkey").alias("base")).agg(last("BUILDING").alias("s"), last("MACHINERY").alias("d"), last("FURNITURE").alias("r"))
    pair = g.select("base", F.explode(F.array(F.struct(F.col("s").alias("statute"), F.col("d").alias("decree"), F.lit("ENFORCED_BY").alias("type")), F.struct(F.col("d").alias("statute"), F.col("r").alias("decree"), F.lit("DETAILED_BY").alias("type")))).alias("p"))
    return pair.select("base", "p.*").filter("statute IS NOT NULL AND decree IS NOT NULL")


@query("""WITH u AS (SELECT 'law' || o_orderkey % 7 || '::제' || o_orderkey % 30 || '조::' || o_orderkey AS full_id FROM orders), p(domain_id, prefix) AS (VALUES ('a', 'law1::제1'), ('a', 'law1::제12조'), ('a', 'law2'), ('b', 'law1::제29조'), ('b', 'law6::제3조::'), ('c', 'none'))
SELECT domain_id, count(DISTINCT full_id) AS node_count FROM u JOIN p ON starts_with(full_id, prefix) GROUP BY 1""")
def domain_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each domain by the prefixes of their ids; a unit under two prefixes of a domain counts once."""
    k = F.col("o_orderkey")
    u = Tables(spark, sf_dir).orders.select(F.concat(F.lit("law"), k % 7, F.lit("::제"), k % 30, F.lit("조::"), k).alias("full_id"))
    prefixes = (("a", "law1::제1"), ("a", "law1::제12조"), ("a", "law2"), ("b", "law1::제29조"), ("b", "law6::제3조::"), ("c", "none"))
    return statute.domain_sizes(statute.domain_members(u, spark.createDataFrame(prefixes, "domain_id string, prefix string")))


@query()
def statute_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of a statute-like document per customer, and which of them stand in its table of contents only."""
    k = F.col("c_custkey")
    line = lambda form, *c: F.format_string(form, *c)
    heads = F.array(line("제1장 총칙 %d", k % 3), line("제1절 통칙"), line("제2절 보칙"), line("제2장 벌칙"), line("제3절 부칙 %d", k % 2))
    again = F.filter(F.array(line("제1장 총칙 %d", k % 3), F.when(k % 3 > 0, "제1절 통칙"), F.when(k % 2 == 0, "제1조(목적) 이 법은"), F.when(k % 5 == 0, "제2장 벌칙"), F.when(k % 7 == 0, "제9조(벌칙) 과태료")), lambda x: x.isNotNull())
    rows = Tables(spark, sf_dir).customer.select(F.concat(F.lit("doc"), k).alias("doc"), F.posexplode(F.concat(heads, again)).alias("line_number", "text"))
    return statute.contents_flags(rows)


@query()
def caption_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four turns of a conversation at a time, set back to the turns that they start and end with."""
    t = Tables(spark, sf_dir).conversations
    said = t.select(F.col("conv_id").alias("video"), F.col("turn").alias("seq"), (F.col("turn") * 700).alias("start"), F.lit(9).alias("duration"), F.coalesce("text", F.lit("")).alias("text"))
    four = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    chunks = said.groupBy("video", F.floor(F.col("seq") / 4).alias("chunk")).agg(F.array_join(four, "\n").alias("text"))
    return captions.caption_times(chunks, said)
