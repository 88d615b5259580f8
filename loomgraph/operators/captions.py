"""Chunks of a transcript back to its captions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomgraph.functions.text import h_mm_ss

EDGE = 40  # characters of a chunk's start and end that are looked for


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks, found longest first."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def _flat(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "(?U)^\\s+|\\s+$", ""), "\n", " ")


def caption_times(chunks: DataFrame, captions: DataFrame) -> DataFrame:
    """``video, chunk, start_timestamp, end_timestamp`` of ``chunks(video, chunk, text)`` by ``captions(video, seq, start, duration, text)``.

    A chunk starts with the caption most like its first characters and ends with
    the one most like its last; the first of equals counts. Both stay null where
    no caption has anything in common; null counts as empty, and two empty texts
    are alike. Each chunk meets the captions of its own
    video, and only the best of them travel on, merged before the shuffle.
    """
    ends = chunks.select("video", "chunk", _flat(F.left("text", F.lit(EDGE))).alias("head"), _flat(F.right("text", F.lit(EDGE))).alias("tail"))
    said = captions.select("video", "seq", "start", (F.col("start") + F.col("duration")).alias("end"), F.regexp_replace("text", "\n", " ").alias("said"))
    pairs = ends.join(said, "video", "left").withColumns({"a": likeness("head", "said"), "b": likeness("tail", "said")})
    best = lambda like, at: F.max(F.when(F.col(like) > 0, F.struct(F.col(like).alias("like"), (-F.col("seq")).alias("first"), F.col(at).alias("at"))))["at"]
    g = pairs.groupBy("video", "chunk").agg(best("a", "start").alias("s"), best("b", "end").alias("e"))
    return g.select("video", "chunk", h_mm_ss(F.col("s")).alias("start_timestamp"), h_mm_ss(F.col("e")).alias("end_timestamp"))
