"""Columns of tables that a mapping gives a category, and what they tell about the other columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from .detect import STAGE

FOUND = "array<struct<ord:array<int>,original:string,category:string,alias_of:string>>"


def name_groups(mapping: dict[int, str]) -> list[list[int]]:
    """Runs of neighbouring columns mapped to NAME."""
    groups: list[list[int]] = []
    for c in sorted(c for c, category in mapping.items() if category == "NAME"):
        if groups and groups[-1][-1] == c - 1:
            groups[-1].append(c)
        else:
            groups.append([c])
    return groups


def name_groups_table(mapping: DataFrame) -> DataFrame:
    """The same for a table (doc_id, col_index, category): doc_id, first, last."""
    from pyspark.sql import Window

    names = mapping.filter("category = 'NAME'")
    island = F.col("col_index") - F.row_number().over(Window.partitionBy("doc_id").orderBy("col_index"))
    return names.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("col_index").alias("first"), F.max("col_index").alias("last")).drop("island")


def _bare(c):
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def mapped_columns(segments: DataFrame, mapping: dict[int, str]) -> DataFrame:
    """Detections of mapped columns, the header line left out. A cell that already holds a tag gives none.

    All of a row's come from one expression in which no part is evaluated twice, so rows are read and cells trimmed once.
    """
    tagged = r"(?s)\[[^\]]*\]"
    none = F.array().cast(FOUND)

    def once(value, use):
        """use(value), where value is evaluated a single time, however often use names it."""
        return F.transform(F.array(value), use)[0]

    def one(ord_, original, category, alias_of):
        return F.struct(F.array(*ord_).alias("ord"), original.alias("original"), F.lit(category).alias("category"), alias_of.alias("alias_of"))

    def names(g):
        return lambda parts: F.when(F.size(parts) > 0, once(F.array_join(parts, " "), lambda full: names_of(g, parts, full))).otherwise(none)

    def names_of(g, parts, full):
        made = once(F.filter(F.split(full, r"(?U)\s+"), lambda w: w != ""), lambda split: words_of(g, parts, full, split))
        return F.when(full.rlike(tagged), none).otherwise(made)

    def words_of(g, parts, full, split):
        several = F.size(parts) > 1
        words = F.filter(F.when(several, parts).when(F.contains(full, F.lit(" ")), split).otherwise(F.array().cast("array<string>")), lambda w: w != full)
        first = F.when(several, parts[0]).when(F.size(split) > 1, split[0]).otherwise("")
        last = F.when(several, F.element_at(parts, -1)).when(F.size(split) > 1, F.element_at(split, -1)).otherwise("")
        alias = lambda kind: lambda w, pos: one([F.lit(0), F.lit(g), F.lit(kind), pos], w, "NAME", full)
        variations = once(F.struct(first.alias("f"), last.alias("l")), lambda n: T.name_variations(n["f"], n["l"]))
        whole = F.array(one([F.lit(0), F.lit(g), F.lit(0), F.lit(0)], full, "NAME", F.lit(None).cast("string")))
        return F.concat(whole, F.transform(words, alias(1)), F.transform(variations, alias(2)))

    def single(k, category):
        own = lambda value: F.array(one([F.lit(1), F.lit(k), F.lit(0), F.lit(0)], value, category, F.lit(None).cast("string")))
        return lambda value: F.when((value != "") & ~value.rlike(tagged), own(value)).otherwise(none)

    def all_of(values):
        at = lambda i: F.coalesce(F.get(values, F.lit(i)), F.lit(""))
        found = [once(F.filter(F.array(*[at(i) for i in group]), lambda p: p != ""), names(g)) for g, group in enumerate(name_groups(mapping))]
        found += [once(at(i), single(k, category)) for k, (i, category) in enumerate(mapping.items()) if category.lower() not in V.NOT_TAGGED and category != "NAME"]
        return F.concat(*found) if found else none

    rows = segments.filter("line_number <> 1").select("doc_id", "line_number", once(F.transform("cells", lambda c: _bare(c["text"])), all_of).alias("found"))
    rows = rows.select("doc_id", "line_number", F.explode_outer("found").alias("m")).filter("m is not null").select("doc_id", "line_number", "m.*")
    return rows.select(
        "doc_id", F.lit(STAGE["column"]).alias("stage"), F.col("line_number").cast("int").alias("line_number"), "ord", "original", "category", "alias_of", F.lit("column").alias("layer"),
    )


def cross_reference(segments: DataFrame, lookup: DataFrame, mapping: dict[int, str], n_columns: int, mode: str = "per_file") -> DataFrame:
    """Segments with single-word names masked in columns that aren't mapped, where they begin with a capital.

    Terms are joined to the words of those cells, not tried on every cell; in per_file mode only those of the cell's document.
    """
    open_columns = [i for i in range(n_columns) if mapping.get(i, "skip").lower() in V.NOT_TAGGED]
    if not open_columns:
        return segments
    names = lookup.filter("pii_category = 'NAME'").filter(~F.contains("original_term", F.lit(" "))).filter(F.col("original_term").rlike(r"^\p{Lu}"))
    cells = segments.filter("line_number <> 1").select("doc_id", "line_number", "sub_index", F.posexplode("cells").alias("i", "c")).filter(F.col("c.col_index").isin(*open_columns))
    words = cells.select("doc_id", "line_number", "sub_index", "i", F.explode(F.array_distinct(F.regexp_extract_all("c.text", F.lit(r"(?U)[\w'’.-]+"), F.lit(0)))).alias("original_term"))
    stems = words.withColumn("original_term", F.explode(F.array_distinct(F.flatten(F.array(F.array(F.col("original_term")), F.split("original_term", r"[.'’-]"))))))
    scope = ["doc_id"] if mode == "per_file" else []
    names = names.select(F.col("scope").alias("doc_id"), "original_term", F.col("anonymised_term").alias("tag")).drop(*([] if scope else ["doc_id"]))
    hits = stems.join(names, [*scope, "original_term"]).select("doc_id", "line_number", "sub_index", "i", "original_term", "tag").distinct()
    one = F.struct((-F.length("original_term")).alias("size"), T.literal_pattern("original_term").alias("pattern"), F.col("tag"))
    found = hits.groupBy("doc_id", "line_number", "sub_index", "i").agg(F.array_sort(F.collect_list(one)).alias("entries"))
    by_line = found.groupBy("doc_id", "line_number", "sub_index").agg(F.map_from_entries(F.collect_list(F.struct("i", "entries"))).alias("masks"))
    none = F.array().cast("array<struct<size:int,pattern:string,tag:string>>")
    masked = F.transform("cells", lambda c, i: c.withField("text", T.replay(c["text"], F.coalesce(F.try_element_at("masks", i), none))))
    joined = segments.join(by_line, ["doc_id", "line_number", "sub_index"], "left")
    return joined.withColumn("cells", F.when(F.col("masks").isNull(), F.col("cells")).otherwise(masked)).select(segments.columns)
