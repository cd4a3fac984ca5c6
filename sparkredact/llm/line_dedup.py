"""Line deduplication by distinct-site spread, in DataFrame functions alone.

A line is boilerplate when it stands on many sites. For each line hash a HyperLogLog sketch of its sites is
merged by aggregation. Lines whose estimate is far from the threshold are decided by it; lines near the
threshold, within the sketch's error, get an exact distinct count. Boilerplate is then removed from every text.

Sketches aggregate map-side, and exact counts take distinct pairs of line and site, so one line on a third
of all rows is one row a task. Removal ships hashes to the documents, not lines: each document is split again
beside the hashes that it has to drop. Lines on a large share of the rows, of which there can only be few, are broadcast
for that; documents with a rarer line are found by a shuffle of hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_hot

#: Sites from which a line is boilerplate, and the sketch's size (2^LG_K registers).
MIN_SITES, LG_K = 5, 8
#: Standard errors around the threshold that count as near.
BAND = 4.0


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """A line's identity: its text without white space at the ends; null for a blank line, which always stays."""
    bare = F.btrim(line, F.lit(" \t\n\v\f\r"))
    return F.when(bare != "", F.xxhash64(bare, F.lit("line")))


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """From rows (site, line: hash), a row for each distinct line of a document, the line of each on at least min_sites sites, with sites (exact in the band, else estimated) and copies (its documents)."""
    error = 1.04 / math.sqrt(2**lg_k)
    low, high = max(1, math.floor(min_sites * (1 - BAND * error))), math.ceil(min_sites * (1 + BAND * error))
    spread = rows.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.count("*").alias("copies"))
    spread = spread.filter(F.col("sites") >= low)
    sure = spread.filter(F.col("sites") > high)
    near = spread.filter(F.col("sites") <= high).select("line", "copies")
    # A line has at most as many of these pairs as there are sites, however many rows it is on.
    pairs = rows.select("site", "line").distinct()
    exact = pairs.join(near, "line").groupBy("line").agg(F.count("*").alias("sites"), F.max("copies").alias("copies"))
    return sure.unionByName(exact.filter(F.col("sites") >= min_sites))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_removed, text (what is left).

    Lines end at a line feed and are compared without white space at their ends; blank lines always stay. A null text
    counts as empty, a null site as a site of its own. Rows with one id are treated alike, as one document's parts.
    Lines of a null id are counted, and removed as well. An empty table gives an empty result; other columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(site_col).alias("site"), F.col(text_col).alias("text"))
    space = Workspace(docs.sparkSession, "line-dedup")
    keys = F.array_compact(F.array_distinct(F.transform(_lines(F.col("text")), _key)))
    rows = space.keep(own.select("doc_id", F.coalesce(F.col("site").cast("string"), F.lit("")).alias("site"), F.explode(keys).alias("line")), "lines")
    bad = space.keep(boilerplate(rows, min_sites, lg_k).select("line", "copies"), "bad")
    hits = join_hot(rows.select("doc_id", "line"), bad, "line", "copies").groupBy("doc_id").agg(F.collect_set("line").alias("drop"))
    hits = hits.withColumnRenamed("doc_id", "hit_id")
    split = own.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").select("doc_id", _lines(F.col("text")).alias("lines"), F.coalesce("drop", F.array().cast("array<bigint>")).alias("drop"))
    left = F.filter("lines", lambda line: ~F.coalesce(F.array_contains(F.col("drop"), _key(line)), F.lit(False)))
    kept = F.when(F.size("drop") > 0, left).otherwise(F.col("lines"))
    return split.select("doc_id", "lines", kept.alias("kept")).select(
        "doc_id", F.size("lines").alias("n_lines"), (F.size("lines") - F.size("kept")).alias("n_removed"), F.array_join("kept", "\n").alias("text")
    )
