"""Statute text to units: a line classifier and carried levels, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import found_in_context
from loomgraph.session import dealt

# Unit types from the highest level to the lowest, and the patterns of their lines.
LEVELS = ("PYEON", "JANG", "JEOL", "GWAN", "JO", "HANG", "HO", "MOK")
PATTERNS = {
    "PYEON": r"^제(\d+)편\s*(.*)$",
    "JANG": r"^제(\d+)장\s*(.*)$",
    "JEOL": r"^제(\d+)절\s*(.*)$",
    "GWAN": r"^제(\d+)관\s*(.*)$",
    "HANG": r"^([①-⑳])\s*(.*)$",
    "HO": r"^(\d+)\.\s*(.*)$",
    "MOK": r"^([가-하])\.\s*(.{2,})$",
    "JO": r"제(\d+조(?:의\d+)?)\s*(?:\(([^)]*)\))?(.*)$",
}
ORDER = ("PYEON", "JANG", "JEOL", "GWAN", "HANG", "HO", "MOK", "JO")  # of precedence
DATE_PART = r"^\d+\.\s*\d+\.\s*,?\s*\d{4}\."
REVISION = r"<(?:개정|신설)\s*([^>]*)>"
# Phrases that hand a matter down, with the kind of text it goes to, and the form of a citation.
DELEGATIONS = (
    (r"대통령령으로\s+정한다", "시행령"), (r"대통령령으로\s+정하는", "시행령"), (r"대통령령이\s+정하는", "시행령"), (r"국토교통부령으로\s+정한다", "시행규칙"),
    (r"국토교통부령으로\s+정하는", "시행규칙"), (r"총리령으로\s+정한다", "시행규칙"), (r"부령으로\s+정한다", "시행규칙"), (r"조례로\s+정한다", "조례"),
)
CITATION = r"「([^」]+)」\s*제(\d+)조"


def _inside(level: str, w) -> Column:
    """Whether a unit of the level has begun above this line."""
    return F.max(F.when(F.col(f"_{level}"), 1)).over(w).isNotNull()


def classified(lines: DataFrame) -> DataFrame:
    """``unit_type`` of each line by precedence; null for continuation. Paragraphs need an article above, items a paragraph.

    Patterns are tried once a line, before lines go to their document's task;
    documents are dealt to as many tasks as the lines ask for.
    """
    names = lines.columns
    hits = {f"_{x}": F.rlike("text", F.lit(PATTERNS[x])) for x in ORDER} | {"_date": F.rlike("text", F.lit(DATE_PART))}
    tried = dealt(lines.withColumn("text", F.trim("text")).filter("text <> ''").withColumns(hits), lines.count(), "doc")
    w = Window.partitionBy("doc").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    guard = {"HANG": _inside("JO", w), "HO": _inside("HANG", w) & ~F.col("_date"), "MOK": _inside("HO", w)}
    kind = None
    for level in ORDER:
        hit = F.col(f"_{level}") & guard.get(level, F.lit(True))
        kind = F.when(hit, level) if kind is None else kind.when(hit, level)
    return tried.withColumn("unit_type", kind).select(*names, "unit_type")


def units(lines: DataFrame) -> DataFrame:
    """``lines(doc, line_number, text)`` to units.

    Columns: ``doc, unit_type, unit_number, title, content, full_id, parent_id,
    ord, revision_dates, line_number``. A continuation line is appended to the
    unit above with one space; of units with the same id (a repeated table of
    contents) the first stays.
    """
    w = Window.partitionBy("doc").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    c = classified(lines).withColumn("unit", F.count("unit_type").over(w)).filter("unit > 0")
    number, title = F.lit(None).cast("string"), F.lit("")
    body = F.col("text")
    for level in ORDER:
        hit = F.col("unit_type") == level
        number = F.when(hit, F.regexp_extract("text", PATTERNS[level], 1)).otherwise(number)
        title = F.when(hit, F.regexp_extract("text", PATTERNS[level], 2) if LEVELS.index(level) < 5 else F.lit("")).otherwise(title)
        body = F.when(hit, F.regexp_extract("text", PATTERNS[level], 3 if level == "JO" else 2)).otherwise(body)
    parts = c.withColumns({"unit_number": number, "title": title, "body": body})
    rest = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "body"))), lambda x: x["body"]), " ")
    first = {x: F.min_by(x, "line_number").alias(x) for x in ("unit_type", "unit_number", "title")}
    u = parts.groupBy("doc", "unit").agg(*first.values(), F.min("line_number").alias("line_number"), F.trim(rest).alias("content"))
    # an open level is the last unit of it, unless a higher level began after
    at = {x: F.max(F.when(F.col("unit_type") == x, F.col("unit"))).over(up) for x in LEVELS for up in [Window.partitionBy("doc").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)]}
    name = {x: F.last(F.when(F.col("unit_type") == x, F.concat_ws(":", F.lit(x), "unit_number")), ignorenulls=True).over(Window.partitionBy("doc").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)) for x in LEVELS}
    u = u.withColumns({f"at_{x}": v for x, v in at.items()} | {f"name_{x}": v for x, v in name.items()})
    open_ = []
    for i, x in enumerate(LEVELS):
        higher = [F.coalesce(F.col(f"at_{y}"), F.lit(0)) for y in LEVELS[:i]]
        alive = F.col(f"at_{x}") > (F.greatest(*higher) if len(higher) > 1 else higher[0]) if higher else F.col(f"at_{x}").isNotNull()
        own_or_above = F.array_position(F.array(*[F.lit(y) for y in LEVELS]), F.col("unit_type")) >= i + 1
        open_.append(F.when(alive & own_or_above, F.col(f"name_{x}")))
    path = F.filter(F.array(F.col("doc"), *open_), lambda x: x.isNotNull())
    u = u.withColumns({"full_id": F.array_join(path, "::"), "parent_id": F.array_join(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(1))), "::")})
    u = u.withColumn("revision_dates", F.flatten(F.transform(F.regexp_extract_all("content", F.lit(REVISION), F.lit(1)), lambda x: F.split(x, ",\\s*"))))
    u = u.withColumn("content", F.trim(F.regexp_replace("content", REVISION, "")))
    u = u.withColumn("nth", F.row_number().over(Window.partitionBy("doc", "full_id").orderBy("unit"))).filter("nth = 1")
    u = u.withColumn("ord", F.row_number().over(Window.partitionBy("doc", "parent_id", "unit_type").orderBy("unit")))
    return u.select("doc", "unit_type", "unit_number", "title", "content", "full_id", "parent_id", "ord", "revision_dates", "line_number")


def unit_edges(units_: DataFrame) -> DataFrame:
    """CONTAINS edges from parent to child and NEXT edges between siblings of a type: ``src, dst, type, ord``."""
    w = Window.partitionBy("doc", "parent_id", "unit_type").orderBy("ord")
    edge = lambda src, dst, kind: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), "ord")
    contains, nxt = edge("parent_id", "full_id", "CONTAINS"), edge("full_id", "next", "NEXT")
    each = units_.select("parent_id", "full_id", "ord", F.lead("full_id").over(w).alias("next"))
    return each.select(F.inline(F.when(F.col("next").isNull(), F.array(contains)).otherwise(F.array(contains, nxt))))


def typed_ids(units_: DataFrame, laws: DataFrame) -> DataFrame:
    """Units whose ids name the kind of their law as well, ``law(category)::...``, by ``laws(doc, category)``; units of a law without a category keep their ids."""
    kind = laws.filter("category is not null").select("doc", F.concat("doc", F.lit("("), "category", F.lit(")")).alias("_named")).dropDuplicates(["doc"])
    joined = units_.join(kind, "doc", "left")
    typed = lambda c: F.when(F.col("_named").isNotNull() & F.startswith(F.col(c), F.col("doc")), F.concat("_named", F.substr(c, F.length("doc") + 1))).otherwise(F.col(c))
    return joined.withColumns({"full_id": typed("full_id"), "parent_id": typed("parent_id")}).select(*units_.columns)


def resolved_articles(rules: DataFrame, citations: DataFrame, articles: DataFrame) -> DataFrame:
    """``rule_id, article_id, title`` of the articles that rules cite: ``rules(rule_id)``, ``citations(rule_id, article_id)``, ``articles(article_id, title)``.

    A rule that cites nothing has one row with nulls; a cited article that isn't
    known keeps its id and has a null title. Repeated citations count once.
    """
    cited = citations.select("rule_id", "article_id").distinct().join(articles.select("article_id", "title").dropDuplicates(["article_id"]), "article_id", "left")
    return rules.select("rule_id").distinct().join(cited, "rule_id", "left").select("rule_id", "article_id", "title")


def delegations(units_: DataFrame) -> DataFrame:
    """``from_id, delegation_type, pattern_found, context`` for each phrase of ``units_(full_id, content)`` that hands a matter down, 50 characters around it; a phrase within another counts too."""

    def told(pattern: str, kind: str) -> Column:
        return F.transform(found_in_context(F.col("content"), pattern, 50, 50), lambda x: F.struct(F.lit(kind).alias("delegation_type"), x["found"].alias("pattern_found"), x["context"].alias("context")))

    each = [told(*d) for d in DELEGATIONS]
    return units_.select(F.col("full_id").alias("from_id"), F.inline(F.concat(*each)))


def references(units_: DataFrame) -> DataFrame:
    """``from_id, referenced_law, referenced_article, context`` for each citation of an article of a law by name, 30 characters around it."""
    hits = F.transform(
        found_in_context(F.col("content"), CITATION, 30, 30),
        lambda x: F.struct(F.regexp_extract(x["found"], CITATION, 1).alias("referenced_law"), F.concat(F.lit("제"), F.regexp_extract(x["found"], CITATION, 2), F.lit("조")).alias("referenced_article"), x["context"].alias("context")),
    )
    return units_.select(F.col("full_id").alias("from_id"), F.inline(hits))


def citation_edges(units_: DataFrame) -> DataFrame:
    """CITES edges to the cited articles, once each, with how often: ``src, dst, type, times``; whether the article is a known unit is for a join to tell."""
    dst = F.concat("referenced_law", F.lit("::"), "referenced_article")
    return references(units_).groupBy(F.col("from_id").alias("src"), dst.alias("dst")).agg(F.count(F.lit(1)).alias("times")).withColumn("type", F.lit("CITES"))


def contents_flags(lines: DataFrame) -> DataFrame:
    """Chapters and sections of ``lines(doc, line_number, text)``, and which of them only a table of contents names.

    Columns: ``doc, unit_type, number, title, chapter, line_number, is_toc``, one
    row a heading, at its first line. A section is of the text where an article
    stands under it or where number and title come again; a chapter where an
    article or such a section does. A section belongs to the chapter above its
    first line; without one it is no heading.
    """
    by_line = Window.partitionBy("doc").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda c: F.last(c, ignorenulls=True).over(by_line)
    kind = F.col("unit_type")
    h = classified(lines).filter(kind.isin("PYEON", "JANG", "JEOL", "JO"))
    part = lambda n: F.when(kind == "JANG", F.regexp_extract("text", PATTERNS["JANG"], n)).when(kind == "JEOL", F.regexp_extract("text", PATTERNS["JEOL"], n))
    h = h.withColumns({"number": part(1), "title": F.trim(part(2)), "book": latest(F.when(kind == "PYEON", F.regexp_extract("text", PATTERNS["PYEON"], 1)))})
    h = h.withColumn("own", F.when(kind == "JANG", F.concat_ws(":", "book", "number"))).withColumn("above", latest(F.col("own")))
    h = h.filter((kind != "JEOL") | F.col("above").isNotNull())
    same = Window.partitionBy("doc", "unit_type", "number", "title").orderBy("line_number")
    h = h.withColumn("chapter", F.coalesce("own", F.when(kind == "JEOL", F.first("above").over(same))))
    section = F.when(kind == "JEOL", F.struct("number", "title")).when(kind == "JANG", F.struct(F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("title")))
    h = h.withColumns({"chapter": latest(F.col("chapter")), "section": latest(section)}).filter("unit_type <> 'PYEON'")
    article, at = F.max((kind == "JO").cast("int")) == 1, F.when(kind != "JO", F.col("line_number"))
    sections = h.filter("section.number IS NOT NULL").groupBy("doc", "section").agg(F.min_by("chapter", at).alias("chapter"), F.min(at).alias("line_number"), (article | (F.count(at) > 1)).alias("of_text"))
    held = sections.groupBy("doc", "chapter").agg(F.max("of_text").alias("holds"))
    chapters = h.filter("chapter IS NOT NULL AND unit_type <> 'JEOL'").groupBy("doc", "chapter").agg(
        F.min_by("number", at).alias("number"), F.min_by("title", at).alias("title"), F.min(at).alias("line_number"), article.alias("of_text")
    )
    chapters = chapters.join(held, ["doc", "chapter"], "left").withColumn("of_text", F.col("of_text") | F.coalesce("holds", F.lit(False)))
    out = ("doc", "unit_type", "number", "title", "chapter", "line_number", "is_toc")
    flag = ~F.col("of_text")
    found = sections.select("*", "section.*").withColumns({"unit_type": F.lit("JEOL"), "is_toc": flag}).select(*out)
    return chapters.withColumns({"unit_type": F.lit("JANG"), "is_toc": flag}).select(*out).unionByName(found)


def domain_members(units_: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``domain_id, full_id`` of each unit whose id starts with a prefix of the domain, once each.

    ``prefixes(domain_id, prefix)``. Units and prefixes meet on the prefix
    itself, cut at each of the lengths that occur, so no unit is held against
    every prefix.
    """
    sizes = [r.n for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect()]  # as many as there are lengths of ids
    cut = units_.select("full_id", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("n")).filter(F.length("full_id") >= F.col("n"))
    return cut.withColumn("prefix", F.substr("full_id", F.lit(1), F.col("n"))).join(prefixes, "prefix").select("domain_id", "full_id").distinct()


def domain_sizes(members: DataFrame) -> DataFrame:
    """``domain_id, node_count`` from ``domain_members``."""
    return members.groupBy("domain_id").agg(F.count(F.lit(1)).alias("node_count"))
