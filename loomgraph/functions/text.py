"""Text expressions: token windows, ordered classification, tags, time stamps, codes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_windows(df: DataFrame, tokens: str, size: int, step: int) -> DataFrame:
    """Explode a token array into windows: the other columns, ``position, tokens, body``. The last window may be short; it never holds only overlap."""
    last = F.greatest(F.size(tokens) - (size - step) - 1, F.lit(0))
    starts = F.transform(F.sequence(F.lit(0), F.floor(last / step).cast("int")), lambda i: i * step)
    cols = [c for c in df.columns if c != tokens]
    out = df.select(*cols, F.posexplode(F.transform(starts, lambda p: F.slice(tokens, p + 1, size))).alias("position", "words"))
    return out.select(*cols, F.col("position").cast("long"), F.size("words").alias("tokens"), F.array_join("words", " ").alias("body"))


def first_class(text: Column, classes: Iterable[tuple[str, str]], default: str) -> Column:
    """Name of the first pattern in order that the text matches."""
    out = None
    for name, pattern in classes:
        hit = F.rlike(text, F.lit(pattern))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def strip_tags(html: Column) -> Column:
    """Text of a page: scripts and styles dropped whole, tags to spaces, runs of space to one.

    A script or style without an end tag lasts to the end of the page, as
    browsers read it. Pages of any length take linear time: every start tag is
    met by an end, and tags are looked for only before the last ``>``.
    """
    no_code = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)", " ")
    tail = F.substring_index(no_code, ">", -1)
    head = F.substr(no_code, F.lit(1), F.length(no_code) - F.length(tail))
    return F.trim(F.regexp_replace(F.concat(F.regexp_replace(head, "<[^>]*>", " "), tail), "\\s+", " "))


def h_mm_ss(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.when(s.isNotNull(), F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def seconds_of(stamp: Column) -> Column:
    """``HH:MM:SS`` as seconds."""
    p = F.split(stamp, ":")
    return p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int")


def parcel_code(code: Column) -> Column:
    """The seven parts of a 19-digit parcel code; null where it isn't one."""
    names = (("sido", 1, 2), ("sigungu", 3, 3), ("eupmyeondong", 6, 3), ("ri", 9, 2), ("land", 11, 1), ("main", 12, 4), ("sub", 16, 4))
    return F.when(F.rlike(code, F.lit("^\\d{19}$")), F.struct(*[F.substring(code, at, n).alias(k) for k, at, n in names]))


def half_up_spaces(x: Column) -> Column:
    """Below one counts as none; otherwise halves round up."""
    return F.when(x < 1, 0).otherwise(F.floor(x + 0.5)).cast("long")


def found_in_context(text: Column, pattern: str, before: int, after: int) -> Column:
    """Array of ``found, start, context`` for the matches of a pattern: where each starts (from 1) and the text around it, trimmed."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    length = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda s, x: s + F.length(x))

    def told(hit: Column, i: Column) -> Column:
        start = length(gaps, i + 1) + length(hits, i) + 1
        lead = F.least(F.lit(before), start - 1)
        return F.struct(hit.alias("found"), start.alias("start"), F.trim(F.substr(text, start - lead, lead + F.length(hit) + after)).alias("context"))

    return F.transform(hits, told)
