"""Layers that need a model: providers of spans and tokens, and the rules that hold for whatever they return.

A provider is a function from an iterator of pandas frames (line) to frames (line, start, stop, type, score), run
once for each distinct line by ``mapInPandas``; the built-in one finds runs of title-case words and needs no model.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from .detect import detections
from .segments import line_text

Provider = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
SPANS = "line string, start int, stop int, type string, score double"


def title_case_provider(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Two or more title-case words in a row as PERSON."""
    for frame in frames:
        rows = [(line, m.start(), m.end(), "PERSON", 0.85) for line in frame["line"] for m in re.finditer(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b", line)]
        yield pd.DataFrame(rows, columns=["line", "start", "stop", "type", "score"])


def safely(provider: Provider) -> Provider:
    """A provider whose failures become a row of type ERROR for each line instead of ending the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                whole = list(provider(iter([frame])))
            except Exception:  # noqa: BLE001  which line it was, the lines one by one will show
                whole = None
            if whole is not None:
                yield from whole
                continue
            for line in frame["line"]:
                try:
                    yield from provider(iter([pd.DataFrame({"line": [line]})]))
                except Exception as failure:  # noqa: BLE001
                    yield pd.DataFrame([(line, 0, 0, "ERROR: " + type(failure).__name__, 0.0)], columns=["line", "start", "stop", "type", "score"])

    return run


def spans_of(segments: DataFrame, provider: Provider) -> DataFrame:
    """doc_id, line_number, sub_index, line and each of its spans; equal lines are given to the provider once."""
    lines = segments.select("doc_id", "line_number", "sub_index", line_text().alias("line")).filter(F.trim("line") != "")
    return lines.join(lines.select("line").distinct().mapInPandas(provider, SPANS), "line")


def uncontained(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that lie in no longer one; of equal spans the type with the highest priority, then the first.

    Containment is transitive, so dropping what any other span contains is the same as taking spans greedily.
    """
    priority = F.coalesce(T.mapped("type", {k: str(v) for k, v in V.NER_PRIORITY.items()}).cast("int"), F.lit(99))
    best = Window.partitionBy(*keys, "start", "stop").orderBy("priority", F.desc("score"), "type")
    one = spans.withColumn("priority", priority).withColumn("rank", F.row_number().over(best)).filter("rank = 1").drop("rank")
    other = one.select(*keys, F.col("start").alias("o_start"), F.col("stop").alias("o_stop"))
    inside = (F.col("o_start") <= F.col("start")) & (F.col("o_stop") >= F.col("stop")) & ((F.col("o_start") < F.col("start")) | (F.col("o_stop") > F.col("stop")))
    return one.alias("s").join(other.alias("o"), [F.col(f"s.{k}") == F.col(f"o.{k}") for k in keys] + [inside], "left_anti")


def ner(segments: DataFrame, provider: Provider = title_case_provider, threshold: float = V.NER_THRESHOLD) -> DataFrame:
    """Named entities: overlap first, then thresholds, types and plausibility."""
    spans = uncontained(spans_of(segments, provider), ["doc_id", "line_number", "sub_index", "line"])
    limit = F.when(F.col("type").isin(*V.NER_LENIENT), V.NER_LENIENT_THRESHOLD).otherwise(threshold)
    found = spans.filter(F.col("score") >= limit).withColumn("term", F.substr("line", F.col("start") + 1, F.col("stop") - F.col("start")))
    found = found.withColumn("category", T.mapped("type", V.NER_TYPES)).filter("category is not null").filter(F.length("term") >= 3).filter(~F.col("term").rlike(r"(?s)^\[.*\]$"))
    found = found.withColumn("category", F.when((F.col("category") == "NAME") & T.looks_like_address("term"), "LOCATION").otherwise(F.col("category")))
    bad_name = (F.col("category") == "NAME") & F.col("term").rlike(r"(?U)[\d_]")
    bad_date = (F.col("category") == "DOB") & F.col("term").rlike(r"(?U)^\d+$") & (F.col("term").rlike(r"^\d{4}$") | ~T.plausible_numeric_date("term"))
    found = found.filter(~bad_name & ~bad_date)
    return detections(found, "ner", [F.col("sub_index"), F.col("start") - F.col("stop"), F.col("priority"), F.col("start")], F.col("term"), F.col("category"))


def group_tokens(tokens: DataFrame, keys: list[str], text: str = "line") -> DataFrame:
    """Neighbouring tokens (start, stop) with nothing but white space between become one: keys, start, stop, term."""
    order = Window.partitionBy(*keys).orderBy("start")
    gap = F.substr(text, F.lag("stop").over(order) + 1, F.col("start") - F.lag("stop").over(order))
    marked = tokens.withColumn("opens", F.coalesce((~gap.rlike(r"(?U)^\s*$")).cast("int"), F.lit(1)))
    island = marked.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first(text).alias(text))
    return whole.select(*keys, "start", "stop", F.substr(text, F.col("start") + 1, F.col("stop") - F.col("start")).alias("term"))


def proper_nouns(segments: DataFrame, tagger: Provider, common: list[str] | None = None) -> DataFrame:
    """Proper nouns in telling roles. The tagger's type is ``POS/role``, its score isn't used."""
    common = V.COMMON_WORDS if common is None else common
    spans = spans_of(segments, tagger).withColumn("word", F.substr("line", F.col("start") + 1, F.col("stop") - F.col("start")))
    good = F.col("type").isin(*[f"PROPN/{role}" for role in V.SYNTACTIC_ROLES]) & (F.length("word") >= 3) & F.col("word").rlike(r"^\p{Lu}")
    words = spans.filter(good & ~F.lower("word").isin(*V.NEVER_NAMES, *common))
    groups = group_tokens(words, ["doc_id", "line_number", "sub_index"])
    return detections(groups, "syntactic", [F.col("sub_index"), F.col("start")], F.col("term"), F.lit("NAME"))


def merge_tokens(tokens: DataFrame, keys: list[str], confidence: float = 0.5) -> DataFrame:
    """Token predictions (pos, label, score, start, stop) to spans (start, stop, category).

    Tokens of one category in a row join; B- opens a new span; O, an unmapped label, low confidence and special tokens
    (0, 0) close it.
    """
    category = F.when((F.col("score") >= confidence) & ~((F.col("start") == 0) & (F.col("stop") == 0)), T.encoder_category("label"))
    order = Window.partitionBy(*keys).orderBy("pos")
    rows = tokens.withColumn("category", category).withColumn("before", F.lag("category").over(order))
    opens = F.col("category").isNotNull() & (F.col("label").startswith("B-") | ~F.col("category").eqNullSafe(F.col("before")))
    island = rows.withColumn("island", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("category is not null")
    spans = island.groupBy(*keys, "island", "category").agg(F.min_by("start", "pos").alias("start"), F.max_by("stop", "pos").alias("stop"))
    return spans.select(*keys, "start", "stop", "category")


def span_terms(spans: DataFrame, keys: list[str], text: str = "line") -> DataFrame:
    """Distinct spans as trimmed terms; empty ones go."""
    term = F.regexp_replace(F.substr(text, F.col("start") + 1, F.col("stop") - F.col("start")), r"(?U)^\s+|\s+$", "")
    return spans.dropDuplicates([*keys, "start", "stop", "category"]).withColumn("term", term).filter("term <> ''")


def encoder(segments: DataFrame, provider: Provider, categories: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Detections of a token classifier on pristine lines, and the lines (doc_id, line_number) on which it failed.

    The provider's type is a category or a label. Nothing is masked; a term has to occur in its line.
    """
    spans = spans_of(segments, safely(provider))
    failed = spans.filter(F.col("type").startswith("ERROR")).select("doc_id", "line_number").distinct()
    known = spans.withColumn("category", F.coalesce(T.encoder_category("type"), F.when(F.col("type").isin(*V.CATEGORIES), F.col("type")))).filter("category is not null")
    terms = span_terms(known, ["doc_id", "line_number", "sub_index", "line"]).filter((F.length("term") >= 3) & F.contains("line", F.col("term")))
    if categories:
        terms = terms.filter(F.col("category").isin(*categories))
    return detections(terms, "encoder", [F.col("sub_index"), F.col("start"), F.col("stop")], F.col("term"), F.col("category")), failed


def outside_brackets_only(start: Column, stop: Column, line: Column) -> Column:
    """Whether a span lies in no [...] of its line."""
    before = F.substr(line, F.lit(1), start)
    opened = F.length(F.regexp_replace(F.regexp_replace(before, r"(?s)\[[^\]]*\]", ""), r"[^\[]", "")) > 0
    return ~(opened & F.contains(F.substr(line, stop + 1), F.lit("]")))
