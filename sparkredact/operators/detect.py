"""Detection stages as generators of detections, set-oriented: each reads segments and adds nothing to them.

Every stage gives the rows of ``schema.DETECTIONS``. Text that earlier stages claimed is hidden by ``masked``, the same
replay that writes the result, between the stages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..lineage import cut
from .segments import line_text

STAGE = {"email": 1, "org": 2, "titled": 3, "column": 4, "structured": 6, "entropy": 7, "ner": 8, "syntactic": 9, "names": 10, "custom": 11, "encoder": 12, "fuzzy": 15, "embedding": 17}
TAG = r"(?s)\[[^\]]*\]"


def detections(rows: DataFrame, stage: str, ord_columns: list[Column], original: Column, category: Column, alias_of: Column | None = None) -> DataFrame:
    return rows.select(
        "doc_id", F.lit(STAGE[stage]).alias("stage"), F.col("line_number").cast("int").alias("line_number"),
        F.array(*[c.cast("int") for c in ord_columns]).alias("ord"), original.alias("original"), category.alias("category"),
        (F.lit(None).cast("string") if alias_of is None else alias_of).alias("alias_of"), F.lit(stage).alias("layer"),
    )


def matches(segments: DataFrame, pattern: str, group: int = 0) -> DataFrame:
    """line, pos and term of each match in a segment's line, in order."""
    rows = segments.select("doc_id", "line_number", line_text().alias("line")).filter(F.col("line").rlike(pattern))
    return rows.select("doc_id", "line_number", "line", F.posexplode(F.regexp_extract_all("line", F.lit(pattern), F.lit(group))).alias("pos", "term"))


def emails(segments: DataFrame, pattern: str = V.EMAIL) -> DataFrame:
    return detections(matches(segments, pattern), "email", [F.col("pos")], F.col("term"), F.lit("EMAIL"))


def organisations(segments: DataFrame) -> DataFrame:
    """Capitalised words before a corporate suffix. The separator is optional, so a suffix may end a single word."""
    ends = segments.filter(line_text().rlike(V.ORG_END))
    return detections(matches(ends, V.ORG), "org", [F.col("pos")], F.col("term"), F.lit("ORG"))


def titled_names(segments: DataFrame) -> DataFrame:
    """The name after a title; each of several words of three letters or more becomes an alias of the whole."""
    found = matches(segments, V.TITLED_NAME, 1).withColumn("term", F.regexp_replace("term", r"(?U)^\s+|\s+$", "")).filter("term <> ''")
    whole = detections(found, "titled", [F.col("pos"), F.lit(0)], F.col("term"), F.lit("NAME"))
    words = found.select("*", F.posexplode(F.split("term", r"(?U)\s+")).alias("w", "word")).filter(F.size(F.split("term", r"(?U)\s+")) > 1).filter(F.length("word") >= 3)
    return whole.unionByName(detections(words, "titled", [F.col("pos"), F.col("w") + 1], F.col("word"), F.lit("NAME"), F.col("term")))


def _check(name: str | None, term: Column) -> Column:
    if name is None:
        return F.lit(True)
    if name == "luhn_if_digits":
        return ~term.rlike(r"(?U)^[\d\s-]{13,}$") | T.luhn(term)
    return getattr(T, name)(term)


def _passes(check: str | None):
    return lambda term: (term != "") & _check(check, term)


def _match(k: int, category: str):
    """A term of the k-th pattern and its place among that pattern's."""
    return lambda term, pos: F.struct(F.lit(k).alias("k"), pos.alias("pos"), term.alias("term"), F.lit(category).alias("category"))


def structured(segments: DataFrame, patterns: list[tuple] | None = None, claim: bool = True) -> DataFrame:
    """Patterns in order on each line. What an earlier pattern took from the line is blanked before the next one looks.

    A line's text is folded over the patterns in one expression: no pattern needs a scan of its own. Without ``claim`` every
    pattern reads the line as it stands, brackets included.
    """
    patterns = V.STRUCTURED if patterns is None else patterns
    rows = segments.select("doc_id", "line_number", line_text().alias("line"))
    rows = rows.filter(F.col("line").rlike(r"[\d:]|(?i)www\."))  # every pattern has a digit, ://, or www.
    rows = rows.withColumn("rest", F.regexp_replace("line", TAG, "\u0001") if claim else F.col("line"))
    kinds = []
    for k, (category, pattern, group, check) in enumerate(patterns):
        terms = F.filter(F.regexp_extract_all("rest", F.lit(pattern), F.lit(group)), _passes(check))
        rows = rows.withColumn(f"p{k}", terms)
        if claim:
            taken = F.aggregate(F.array_distinct(F.col(f"p{k}")), F.col("rest"), lambda done, t: F.replace(done, t, F.lit("\u0001")))
            rows = rows.withColumn("rest", F.when(F.size(f"p{k}") > 0, taken).otherwise(F.col("rest")))
        kinds.append(F.transform(f"p{k}", _match(k, category)))
    found = rows.select("doc_id", "line_number", F.explode(F.concat(*kinds)).alias("m")).select("doc_id", "line_number", "m.*")
    return detections(found, "structured", [F.col("k"), F.col("pos")], F.col("term"), F.col("category"))


def _cells(segments: DataFrame) -> DataFrame:
    """doc_id, line_number, cell and its text, with what is in brackets blanked."""
    rows = segments.select("doc_id", "line_number", F.posexplode("cells").alias("cell", "c"))
    return rows.select("doc_id", "line_number", "cell", F.regexp_replace(F.coalesce("c.text", F.lit("")), TAG, "\u0001").alias("text"))


def secrets(segments: DataFrame, min_entropy: float = 3.5, min_length: int = 8) -> DataFrame:
    """Tokens of high entropy, cell by cell."""
    tokens = F.filter(F.regexp_extract_all("text", F.lit(V.SECRET), F.lit(0)), lambda t: T.secret_like(t, min_entropy, min_length))
    rows = _cells(segments).select("doc_id", "line_number", "cell", F.posexplode(tokens).alias("pos", "term"))
    return detections(rows, "entropy", [F.col("cell"), F.col("pos")], F.col("term"), F.lit("ID"))


def title_case_tokens(segments: DataFrame) -> DataFrame:
    """Title-case tokens outside brackets with their character offsets: doc_id, line_number, pos, word, start, stop."""
    rows = segments.select("doc_id", "line_number", F.transform(F.regexp_extract_all(line_text(), F.lit(TAG + r"|[^\[]+|\["), F.lit(0)), lambda p: F.when(p.rlike(r"(?s)^\[[^\]]*\]$"), F.repeat(F.lit("\u0001"), F.length(p))).otherwise(p)).alias("p"))
    pieces = F.regexp_extract_all(F.array_join("p", ""), F.lit(r"(?s)(?U)\b[A-Z][a-z]+(?:-[A-Z][a-z]+)*\b|(?:(?!\b[A-Z][a-z]+(?:-[A-Z][a-z]+)*\b).)+"), F.lit(0))
    rows = rows.select("doc_id", "line_number", F.posexplode(pieces).alias("pos", "piece"))
    before = Window.partitionBy("doc_id", "line_number").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    return rows.filter(F.col("piece").rlike(r"^[A-Z][a-z]+(?:-[A-Z][a-z]+)*$")).select("doc_id", "line_number", "pos", F.col("piece").alias("word"), "start", (F.col("start") + F.length("piece")).alias("stop"))


def dictionary_names(segments: DataFrame, names: list[str] | DataFrame | None = None, common: list[str] | DataFrame | None = None) -> DataFrame:
    """Names of a dictionary. One that is a common word too counts only next to one that isn't.

    Dictionaries are lists, or tables (word) of any size: distinct parts of tokens are joined with them, so the text is
    not. ``next to`` means neighbours among a line's candidates, at most four characters apart.
    """
    spark = segments.sparkSession
    as_table = lambda words: words.select(F.lower("word").alias("part")).distinct() if isinstance(words, DataFrame) else spark.createDataFrame([(w,) for w in sorted({w.lower() for w in words})], "part string")
    names = as_table(V.FIRST_NAMES + V.LAST_NAMES if names is None else names)
    common = as_table(V.COMMON_WORDS if common is None else common)
    tokens = cut(title_case_tokens(segments))  # read for their words and again as candidates, so the texts would be too
    parts = tokens.select("word").distinct().select("word", F.explode(F.split(F.lower("word"), "-")).alias("part"))
    stems = parts.select("part").distinct().select("part", F.explode(T.common_stems("part")).alias("stem"))
    usual = stems.join(common.withColumnRenamed("part", "stem"), "stem", "left_semi").select("part").distinct().withColumn("usual", F.lit(True))
    known = parts.join(names.withColumn("named", F.lit(True)), "part", "left").join(usual, "part", "left")
    never = F.col("part").isin(*V.NEVER_NAMES)
    judged = known.groupBy("word").agg(F.coalesce(F.bool_or("named"), F.lit(False)).alias("named"), F.coalesce(F.bool_or("usual"), F.lit(False)).alias("usual"), F.bool_or(never).alias("never"))
    candidates = tokens.join(judged.filter("named AND NOT never").select("word", "usual"), "word")
    line = Window.partitionBy("doc_id", "line_number").orderBy("pos")
    near = lambda other, gap: F.coalesce(~other("usual") & (gap <= 4), F.lit(False))
    back = near(lambda c: F.lag(c).over(line), F.col("start") - F.lag("stop").over(line))
    ahead = near(lambda c: F.lead(c).over(line), F.lead("start").over(line) - F.col("stop"))
    tagged = candidates.withColumn("near", back | ahead).filter("NOT usual OR near")
    return detections(tagged, "names", [F.col("pos")], F.col("word"), F.lit("NAME"))


def custom_words(segments: DataFrame, lists: list[dict], mask: bool = True) -> DataFrame:
    """Words of custom lists, whatever their case, between word ends; of one category the longest first."""
    by_category: dict[str, list[str]] = {}
    for one in lists:
        words = [w.strip() for w in one.get("words", []) if w.strip()]
        if one.get("category") and words:
            by_category.setdefault(one["category"], []).extend(words)
    spark = segments.sparkSession
    if not by_category:
        return spark.createDataFrame([], "doc_id string, stage int, line_number int, ord array<int>, original string, category string, alias_of string, layer string")
    rows, found = _cells(segments), []
    for k, (category, words) in enumerate(by_category.items()):
        quoted = "|".join(r"\Q" + w.replace(r"\E", r"\E\\E\Q") + r"\E" for w in sorted(words, key=len, reverse=True))
        terms = F.regexp_extract_all("text", F.lit(rf"(?iuU)\b(?:{quoted})\b"), F.lit(0))
        found.append(F.transform(terms, _match(k, category)))
    rows = rows.select("doc_id", "line_number", "cell", F.explode(F.concat(*found)).alias("m")).select("doc_id", "line_number", "cell", "m.*")
    return detections(rows, "custom", [F.col("cell"), F.col("k"), F.col("pos")], F.col("term"), F.col("category"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
