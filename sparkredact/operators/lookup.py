"""The lookup: one tag for each distinct term, numbered by first sighting within scope and category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..lineage import cut


def _scoped(detections: DataFrame, mode: str) -> DataFrame:
    scope = F.col("doc_id") if mode == "per_file" else F.lit("all")
    return detections.withColumn("scope", scope).withColumn("norm_key", T.normalize_key("original"))


def _ranked(rows: DataFrame) -> DataFrame:
    """rows of one scope with n, their place by ``order`` among those of their category, counted in ranges of the order side by side.

    Ranges are checkpointed, so a task that is run again finds its rows in the same range.
    """
    ranged = cut(rows.repartitionByRange("order").withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy("category").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = ranged.groupBy("category", "range").agg(F.count("*").alias("rows")).select("category", "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("category", "range").orderBy("order"))
    return ranged.withColumn("own", own).join(bases, ["category", "range"]).withColumn("n", F.col("own") + F.col("base")).drop("own", "base", "range")


def assign_tags(detections: DataFrame, mode: str = "per_file", doc_order: str = "doc_id", counters: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """detections to lookup rows. The first sighting of a key gives its category and number, later ones nothing.

    First means by stage, document (in persist mode), line and ord. A detection with alias_of takes the tag of
    that term's key and no number of its own. ``counters`` (category, n) are numbers already given, ``known`` (norm_key) keys
    that have tags, for a lookup that is carried on. Only distinct keys are counted: per document and category by a window,
    over all documents in ranges.
    """
    order = F.struct("stage", F.col(doc_order).alias("doc"), "line_number", "ord") if mode == "per_file" else F.struct(F.col(doc_order).alias("doc"), "stage", "line_number", "ord")
    rows = _scoped(detections, mode).withColumn("order", order)
    row = F.struct("order", "original", "category", "alias_of", "doc_id", "line_number")
    firsts = rows.groupBy("scope", "norm_key").agg(F.min_by(row, "order").alias("r")).select("scope", "norm_key", "r.*")
    if known is not None:
        firsts = firsts.join(known.select("norm_key"), "norm_key", "left_anti")
    if mode != "per_file":  # read again for each use of the lookup and of its aliases, so the texts would be too
        firsts = cut(firsts)
    own = firsts.filter("alias_of is null")
    numbered = own.withColumn("n", F.row_number().over(Window.partitionBy("scope", "category").orderBy("order"))) if mode == "per_file" else _ranked(own)
    if counters is not None:
        numbered = numbered.join(counters.select("category", F.col("n").alias("given")), "category", "left").withColumn("n", F.col("n") + F.coalesce("given", F.lit(0))).drop("given")
    tagged = numbered.withColumn("tag", F.concat(F.lit("["), "category", F.lit(" "), F.col("n").cast("string"), F.lit("]")))
    aliases = firsts.filter("alias_of is not null").withColumn("target", T.normalize_key("alias_of"))
    owners = tagged.select("scope", F.col("norm_key").alias("target"), "tag", F.col("category").alias("owner_category"))
    aliased = aliases.join(owners, ["scope", "target"]).select("scope", "norm_key", "order", "original", F.col("owner_category").alias("category"), "doc_id", "line_number", "tag", F.lit(True).alias("is_alias"))
    both = tagged.select("scope", "norm_key", "order", "original", "category", "doc_id", "line_number", "tag", F.lit(False).alias("is_alias")).unionByName(aliased)
    return both.select(
        "scope", "norm_key", F.col("original").alias("original_term"), F.col("tag").alias("anonymised_term"), F.col("category").alias("pii_category"),
        F.col("doc_id").alias("first_seen_doc"), F.col("line_number").alias("first_seen_line"), "is_alias", "order",
    )


def forms(detections: DataFrame, lookup: DataFrame, mode: str = "per_file") -> DataFrame:
    """Every spelling that was detected with the tag of its key: scope, form, tag."""
    seen = _scoped(detections, mode).select("scope", "norm_key", F.col("original").alias("form")).distinct()
    return seen.join(lookup.select("scope", "norm_key", F.col("anonymised_term").alias("tag")), ["scope", "norm_key"]).select("scope", "form", "tag")


def find(lookup: DataFrame, terms: DataFrame, term_col: str) -> DataFrame:
    """terms with the tag of their key, or null."""
    keyed = terms.withColumn("norm_key", T.normalize_key(term_col))
    return keyed.join(lookup.select("norm_key", "anonymised_term"), "norm_key", "left").drop("norm_key")


def remove(lookup: DataFrame, terms: DataFrame, term_col: str) -> DataFrame:
    """The lookup without the keys of terms. Numbers that were given stay given: see counters."""
    return lookup.join(terms.select(T.normalize_key(term_col).alias("norm_key")).distinct(), "norm_key", "left_anti").select(lookup.columns)


def counters(lookup: DataFrame) -> DataFrame:
    """category and n, the highest number given in it: where assign_tags carries on. Taken before anything is removed; none after a reset."""
    number = F.regexp_extract("anonymised_term", r" (\d+)r?\]$", 1).cast("long")
    return lookup.groupBy(F.col("pii_category").alias("category")).agg(F.max(number).alias("n"))


def filter_categories(lookup: DataFrame, enabled: list[str] | tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Entries of enabled categories, and the rest; an empty list enables all. Never applied before tags are given."""
    on = F.col("pii_category").isin(*enabled) if enabled else F.lit(True)
    return lookup.filter(on), lookup.filter(~on)


def false_positive():
    """What validation removes: stop words, placeholders, bare numbers where they make no sense, single characters, roles."""
    bare = F.regexp_replace(F.col("original_term"), r"(?U)^\s+|\s+$", "")
    low = F.lower(bare)
    return (
        low.isin(*V.STOP_WORDS)
        | low.isin(*V.PLACEHOLDERS)
        | (bare.rlike(r"(?U)^\d+$") & ~F.col("pii_category").isin(*V.NUMERIC_CATEGORIES))
        | (F.length(bare) < 2)
        | ((F.col("pii_category") == "NAME") & low.isin(*V.ROLE_WORDS))
    )


def validate(lookup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries that stay, and the false positives. They go before the replay, so no text has to be restored."""
    return lookup.filter(~false_positive()), lookup.filter(false_positive())


def category_counts(lookup: DataFrame, total: bool = False) -> DataFrame:
    grouped = lookup.rollup("pii_category") if total else lookup.groupBy("pii_category")
    return grouped.agg(F.count("*").alias("n"))


def review(lookup: DataFrame, decisions: DataFrame) -> DataFrame:
    """The lookup after decisions (scope, norm_key, accept, category): rejected entries go, a category may be changed."""
    joined = lookup.join(decisions.select("scope", "norm_key", "accept", F.col("category").alias("edited")), ["scope", "norm_key"], "left")
    kept = joined.filter("coalesce(accept, true)")
    category = F.coalesce("edited", "pii_category")
    renamed = F.concat(F.lit("["), category, F.lit(" "), F.regexp_extract("anonymised_term", r"(\d+)\]$", 1), F.lit("]"))
    tag = F.when(category == F.col("pii_category"), F.col("anonymised_term")).otherwise(F.concat(F.regexp_extract(renamed, r"^(.*)\]$", 1), F.lit("r]")))
    return kept.select("scope", "norm_key", "original_term", tag.alias("anonymised_term"), category.alias("pii_category"), "first_seen_doc", "first_seen_line", "is_alias", "order")
