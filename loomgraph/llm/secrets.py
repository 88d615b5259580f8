"""Secret scans with corpus-wide ownership frequency, in DataFrame and SQL functions only.

One scan of the texts finds candidates by pattern and keeps, per match, its
kind, position and a hash of its value; neither text nor value goes further.
Candidate hashes are then aggregated over the whole corpus by distinct
repositories and owners; verdicts on the few values that hold a notable share of
all matches go back by broadcast, so that no copied example meets a single task. A value that several owners hold is a copied example;
one that a single owner holds, in few repositories, looks live.

The base kinds (``assign``, ``access``, ``hex``) are always reported. The
method adds spans of kind ``live``: long mixed tokens that no base span
touches and whose value is specific to one owner.

Defined results: a null text equals an empty one and has no span; null owners
and repositories count as one unknown owner or repository; repeated rows are
scanned each for itself and, as frequencies count distinct owners, change no
verdict; ties in start are ordered by kind; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import free_names
from loomgraph.session import written

# The kinds in the order in which equal starts are listed, and their patterns (pattern, group of the value).
KINDS = ("assign", "access", "hex", "live")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs are greedy, so asking for the least length inside the pattern equals dropping shorter matches.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
PATTERNS = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0), "live": (TOKEN, 0)}
LEAST_VALUE = 6  # characters of an assigned value
HEAVY = 1024  # a value with more than this share (1 / HEAVY) of all matches is frequent, so fewer than HEAVY values are


def _found(text: Column, kind: str) -> Column:
    """Matches of a kind in order: code points before each since the last match, its own length, the value's length and hash."""
    pattern, group = PATTERNS[kind]
    p = F.lit(pattern)
    return F.when(
        F.rlike(text, p),
        F.zip_with(
            F.arrays_zip(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.regexp_extract_all(text, p, F.lit(group)).alias("v")),
            F.split(text, pattern, -1),
            lambda x, gap: F.when(
                x.isNotNull(),
                F.struct(
                    F.lit(KINDS.index(kind)).alias("kind"), F.length(gap).alias("gap"), F.length(x["m"]).alias("len"), F.length(x["v"]).alias("value_len"),
                    (F.rlike(x["v"], F.lit("[0-9]")) & F.rlike(x["v"], F.lit("[A-Za-z]"))).alias("mixed"), F.unhex(F.md5(x["v"])).alias("value"),
                ),
            ),
        ),
    )


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str | None, repo_cols: tuple[str, ...], tagged: bool = False) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    owner = F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("")) if owner_col else F.lit("")
    repo = F.concat_ws("/", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in repo_cols]) if repo_cols else F.lit("")
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), *([F.xxhash64(text).alias("tag")] if tagged else []), owner.alias("owner"), repo.alias("repo"),
        *[_found(text, k).alias(k) for k in KINDS],
    )


def _placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each match, with code-point offsets from running sums over the gaps and lengths of its document."""
    each = rows.withColumn("matches", F.array(*KINDS)).select("row_id", *keys, "owner", "repo", F.explode("matches").alias("of_kind"))
    each = each.select("row_id", *keys, "owner", "repo", F.posexplode("of_kind").alias("i", "m")).filter(F.col("m").isNotNull())
    w = Window.partitionBy("row_id", "m.kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(w)
    return each.select("row_id", *keys, "owner", "repo", "m.*", end.alias("end")).withColumn("start", F.col("end") - F.col("len"))


def ownership(spans: DataFrame) -> DataFrame:
    """``value, n_owners, n_repos, n_spans`` over distinct holders; partial sums first, so a value in a third of all rows meets no single task."""
    return (
        spans.groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("spans"))
        .groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("spans").alias("spans"))
        .groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("spans").alias("n_spans"))
    )


def _judged(spans: DataFrame, max_owners: int, max_repos: int, heavy: int = HEAVY) -> DataFrame:
    """``spans`` with ``live``.

    Frequent values are counted exactly and broadcast, fewer than ``heavy`` of
    them whatever the corpus holds. Their spans, and those that aren't judged,
    get a share number that no value in the shuffled join has, and so spread
    over all tasks.
    """
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    values = written(ownership(spans.filter("ok")).select("value", "n_spans", live.alias("live")), "owners")
    total = values.agg(F.sum("n_spans")).first()[0] or 0
    frequent = values.filter(F.col("n_spans") * heavy > total).select("value", F.col("live").alias("known"))
    rare = values.filter("live").select("value", F.lit(0).cast("long").alias("share"), F.lit(True).alias("single"))
    share = F.when(F.col("ok") & F.col("known").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("row_id", "kind", "start"), F.lit(1 << 20)) + 1)
    spread = spans.join(F.broadcast(frequent), "value", "left").withColumn("share", share.cast("long"))
    return spread.join(rare, ["value", "share"], "left").withColumn("live", F.coalesce("known", "single", F.lit(False))).drop("known", "single", "share")


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = 1, max_repos: int = 2, tagged: bool = False, heavy: int = HEAVY
) -> DataFrame:
    """One row per document: ``doc_id, base, added, n_live, n_example``.

    ``base`` and ``added`` are arrays of ``(start, kind, end, live)`` in order
    of start, then kind. A value is live-looking where at most ``max_owners``
    owners and ``max_repos`` repositories hold it. With ``tagged``, ``tag`` is a
    hash of the document's text.
    """
    keys = ["doc_id", "tag"] if tagged else ["doc_id"]
    rows = candidates(docs, id_col, text_col, owner_col, repo_cols, tagged).withColumn("row_id", F.monotonically_increasing_id())
    rows = written(rows, "secrets")
    any_match = F.coalesce(*[F.col(k).isNotNull() for k in KINDS[:1]])
    for k in KINDS[1:]:
        any_match = any_match | F.col(k).isNotNull()
    spans = _placed(rows.filter(any_match), keys)
    ok = F.when(F.col("kind") == 0, F.col("value_len") >= LEAST_VALUE).when(F.col("kind") == 3, F.col("mixed")).otherwise(True)
    spans = _judged(spans.withColumn("ok", F.coalesce(ok, F.lit(False))), max_owners, max_repos, heavy)
    item = F.struct(F.col("start"), F.col("kind"), F.col("end"), F.col("live"))
    base_ok = F.col("ok") & (F.col("kind") < 3)
    found = spans.groupBy("row_id", *keys).agg(
        F.array_sort(F.collect_list(F.when(base_ok, item))).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("ok") & (F.col("kind") == 3) & F.col("live"), item))).alias("more"),
    )
    free = F.filter("more", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    found = found.select(*keys, "base", free.alias("added"))
    none = rows.filter(~any_match).select(*keys, *[F.array().cast(found.schema["base"].dataType).alias(c) for c in ("base", "added")])
    return found.unionByName(none).select(
        *keys, "base", "added",
        (F.size(F.filter("base", lambda x: x["live"])) + F.size("added")).alias("n_live"), F.size(F.filter("base", lambda x: ~x["live"])).alias("n_example"),
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest_rows(found: DataFrame) -> DataFrame:
    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    return found.select(
        "doc_id", *map(count, range(3)), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.col("n_live").cast("long").alias("n_live"), F.col("n_example").cast("long").alias("n_example"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[REDACTED]", **how) -> DataFrame:
    """``docs`` with every live-looking span replaced by ``mask``; all documents and columns stay.

    Spans follow from the text and from how often values are held, so rows of
    the same id and text have the same ones; other texts of an id, and null
    ids, have their own. Null and empty texts stay as they are; columns may have
    any names.
    """
    found = secret_scan(docs, id_col, text_col, tagged=True, **how)
    id_, tag, cuts_ = free_names(docs, "id", "tag", "cuts")
    live = F.filter(F.concat("base", "added"), lambda x: x["live"])
    cuts = found.select(F.col("doc_id").alias(id_), F.col("tag").alias(tag), F.array_sort(live).alias(cuts_)).filter(F.size(cuts_) > 0).dropDuplicates([id_, tag])
    text = F.col(f"`{text_col}`")
    # kept pieces between masks; overlapping spans merge as the position only moves on
    done = F.aggregate(
        cuts_,
        F.struct(F.lit("").alias("out"), F.lit(1).cast("long").alias("at")),
        lambda s, x: F.struct(
            F.when(x["start"] + 1 >= s["at"], F.concat(s["out"], F.substr(text, s["at"].cast("int"), (x["start"] + 1 - s["at"]).cast("int")), F.lit(mask))).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], x["end"] + 1).alias("at"),
        ),
        lambda s: F.concat(s["out"], F.substr(text, s["at"].cast("int"))),
    )
    mine = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(tag))
    out = docs.join(cuts.hint("merge"), mine, "left")
    return out.withColumn(text_col, F.when(F.col(cuts_).isNotNull(), done).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])
