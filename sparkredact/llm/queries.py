"""The registered queries of this package and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_chats
from .common import table
from .exact_dedup import exact_dedup
from .jaccard_join import near_classes
from .line_dedup import MIN_SITES, dedup_lines
from .media import media_columns, store_media
from .mixing import mix
from .packing import pack
from .sharding import LEVEL, SHARD, compacted
from .suffix_dedup import remove_repeats
from .toxicity import held_out, learn, toxicity


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, root = store_media(table(spark, sf_dir, "documents"))
    return media_columns(rows, root)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest_only=True)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document lies after compaction, with a checksum of the text read back from there."""
    docs = table(spark, sf_dir, "documents")
    rows = compacted(docs).read()
    if rows is None:
        rows = docs.limit(0).withColumns({SHARD: F.lit(""), LEVEL: F.lit(0)})
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.col(SHARD).alias("shard"), F.col(LEVEL).alias("level"), F.octet_length(text).alias("n_bytes"), F.crc32(text.cast("binary")).alias("text_crc32"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("row_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text itself stays in the operator's result; here its digest stands for it."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM conversations),
p AS (
  SELECT conv_id, place, n_turns,
         string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix
  FROM t),
w AS (SELECT place, prefix, min(conv_id) AS conv_id, count(*) AS n_equal FROM p WHERE place = n_turns GROUP BY place, prefix),
k AS (SELECT w.* FROM w ANTI JOIN (SELECT place, prefix FROM p WHERE place < n_turns) s ON w.place = s.place AND w.prefix = s.prefix),
r AS (SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY place) AS rendered FROM t GROUP BY conv_id)
SELECT k.conv_id, k.place AS n_turns, k.n_equal, r.rendered FROM k JOIN r USING (conv_id)
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

OP10_SQL = rf"""
WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM l),
b AS (SELECT bare FROM k WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT k.*, b.bare IS NOT NULL AS bad FROM k LEFT JOIN b ON k.bare = b.bare)
SELECT doc_id, count(*)::INT AS n_lines, (count(*) FILTER (bad))::INT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad), '')) AS text_sha256
FROM m GROUP BY doc_id
"""

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_media_columns": op2_media_columns,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_source_mixing": op7_source_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_packing": op9_packing,
    "op10_line_dedup": op10_line_dedup,
}
ORACLE = {
    "op4_chat_formatting": OP4_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op10_line_dedup": OP10_SQL,
}
