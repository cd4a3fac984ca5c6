"""Aliases by likeness: misspellings, words that sound alike, and words with close vectors.

Distinct words meet distinct targets, never texts. Edit distances are found by deletion keys: words within one edit
share a form with one letter dropped (two for two edits), which is an equi-join however many words there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions import text as T
from ..functions.python import edits_udf, sound_code_udf

FUZZY_CATEGORIES, MIN_WORD, SOUND_GAP = ["NAME", "LOCATION"], 4, 3


def targets(lookup: DataFrame) -> DataFrame:
    """Words of four letters or more of names and places: target (lower case), tag, category, place (order of first sight).

    Of several entries with a word the last one's tag holds.
    """
    words = lookup.filter(F.col("pii_category").isin(*FUZZY_CATEGORIES)).select("order", "anonymised_term", "pii_category", F.posexplode(F.split("original_term", r"(?U)\s+")).alias("w", "word"))
    words = words.filter(F.length("word") >= MIN_WORD).select(F.lower("word").alias("target"), F.struct("order", "w").alias("at"), F.col("anonymised_term").alias("tag"), F.col("pii_category").alias("category"))
    return words.groupBy("target").agg(F.min("at").alias("place"), F.max_by("tag", "at").alias("tag"), F.max_by("category", "at").alias("category"))


def _dropped(word, times: int):
    """All forms of a word with up to ``times`` letters dropped."""
    forms = F.array(word)
    for _ in range(times):
        shorter = F.flatten(F.transform(forms, lambda v: F.when(F.length(v) > 0, F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(F.substr(v, F.lit(1), i - 1), F.substr(v, i + 1)))).otherwise(F.array(v))))
        forms = F.array_distinct(F.concat(forms, shorter))
    return forms


def edit_matches(words: DataFrame, known: DataFrame, max_distance: int = 2) -> DataFrame:
    """word, target, distance: the closest target of each distinct word within its limit, ties by the targets' place.

    The limit is one edit up to six letters, else two. Swapped letters are one edit.
    """
    limit = F.when(F.length("word") <= 6, 1).otherwise(min(2, max_distance))
    left = words.select("word").distinct().filter(F.length("word") >= MIN_WORD).select("word", limit.alias("most"), F.lower("word").alias("low"))
    left = left.select("word", "low", "most", F.explode(F.when(F.col("most") == 1, _dropped(F.col("low"), 1)).otherwise(_dropped(F.col("low"), 2))).alias("form"))
    right = known.select("target", "place", F.explode(_dropped(F.col("target"), 2)).alias("form"))
    pairs = left.join(right, "form").filter(F.abs(F.length("low") - F.length("target")) <= F.col("most")).select("word", "low", "most", "target", "place").distinct()
    close = pairs.filter(F.levenshtein("low", "target") <= 2 * F.col("most"))
    measured = close.withColumn("distance", edits_udf("low", "target", "most")).filter(F.col("distance") <= F.col("most"))
    best = Window.partitionBy("word").orderBy("distance", "place")
    return measured.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("word", "target", "distance")


def sound_matches(words: DataFrame, known: DataFrame) -> DataFrame:
    """word, target: the first target that sounds like each distinct word, lengths at most three apart."""
    # The count keeps the optimiser from coding every word before they are made distinct.
    left = words.groupBy("word").agg(F.count("*").alias("n")).select("word", sound_code_udf(F.when(F.col("n") > 0, F.lower("word"))).alias("code")).filter("code <> ''")
    right = known.select("target", "place").withColumn("code", sound_code_udf("target"))
    pairs = left.join(right, "code").filter(F.abs(F.length("word") - F.length("target")) <= SOUND_GAP)
    best = Window.partitionBy("word").orderBy("place")
    return pairs.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("word", "target")


def _fresh(words: DataFrame, lookup: DataFrame, common: DataFrame) -> DataFrame:
    """Distinct words of four letters or more that are neither in the lookup nor common (part)."""
    fresh = words.select("word").distinct().filter(F.length("word") >= MIN_WORD).withColumn("norm_key", T.normalize_key("word"))
    return fresh.join(lookup.select("norm_key"), "norm_key", "left_anti").withColumn("part", F.lower("word")).join(common, "part", "left_anti").select("word")


def fuzzy_aliases(words: DataFrame, lookup: DataFrame, common: DataFrame, max_distance: int = 2) -> DataFrame:
    """word, target, tag, category, by: misspellings of known names and places, else words that sound like them.

    Words already in the lookup and common words (part) are left out.
    """
    known, fresh = targets(lookup), _fresh(words, lookup, common)
    typos = edit_matches(fresh, known, max_distance).select("word", "target", F.lit("edits").alias("by"))
    alike = sound_matches(fresh.join(typos, "word", "left_anti"), known).select("word", "target", F.lit("sound").alias("by"))
    return typos.unionByName(alike).join(known.select("target", "tag", "category"), "target").select("word", "target", "tag", "category", "by")


#: Vectors of a block, bytes of blocks that are broadcast, and how far sums taken in another order may differ at most.
BLOCK, BROADCAST_BYTES, SLACK = 1024, 32 << 20, 1e-9


def _blocks(rows: DataFrame) -> DataFrame:
    """(key, place, vector) to rows of up to BLOCK vectors of one length: keys, places, vectors (doubles in a row), width. Vectors with nulls match nothing."""
    kinds = {f.name: f.dataType for f in rows.schema}

    def blocks(batches):
        for batch in batches:
            by_width: dict[int, list[int]] = {}
            vectors = batch.column(2).to_pylist()
            for i, v in enumerate(vectors):
                by_width.setdefault(len(v), []).append(i)
            for width, found in by_width.items():
                for first in range(0, len(found), BLOCK):
                    some = found[first : first + BLOCK]
                    ends = pa.array([0, len(some)], pa.int32())
                    packed = pa.array([np.array([vectors[i] for i in some], np.float64).tobytes()], pa.binary())
                    keys, places = (pa.ListArray.from_arrays(ends, batch.column(c).take(pa.array(some))) for c in (0, 1))
                    yield pa.RecordBatch.from_arrays([keys, places, packed, pa.array([width], pa.int32())], names=["keys", "places", "vectors", "width"])

    schema = StructType([StructField("keys", ArrayType(kinds["key"])), StructField("places", ArrayType(kinds["place"])), StructField("vectors", BinaryType()), StructField("width", IntegerType())])
    whole = rows.filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    return whole.select("key", "place", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(blocks, schema)


def _best(threshold: float, others: bool):
    """Pairs of blocks to the best target of each query; pairs of one block of queries come one after the other.

    Products of matrices find what comes near the best; that is measured again, with sums in the order of ``text.cosine``.
    """

    def norms(v: np.ndarray) -> np.ndarray:
        total = np.zeros(len(v))
        for d in range(v.shape[1]):
            total += v[:, d] * v[:, d]
        return np.sqrt(total)

    def best(batches):
        names, held, at = [], {}, None

        def out() -> pa.RecordBatch:
            keys = list(held)
            return pa.RecordBatch.from_arrays([names[0].take(pa.array(keys, pa.int64())), pa.array([held[i][2] for i in keys], names[1]), pa.array([held[i][0] for i in keys], pa.float64()), pa.array([-held[i][1] for i in keys], pa.int64())], names=["id", "target_id", "similarity", "place"])

        for batch in batches:
            for r in range(len(batch)):
                q_keys, q_raw, t_keys, t_places, t_raw, width = (batch.column(c)[r] for c in ("q_keys", "q_vectors", "keys", "places", "vectors", "width"))
                if at is None or not q_keys.equals(at):
                    if held:
                        yield out()
                    names, held, at = [q_keys.values, t_keys.values.type], {}, q_keys
                q, t = (np.frombuffer(x.as_py(), np.float64).reshape(-1, width.as_py()) if width.as_py() else np.zeros((len(k.values), 0)) for x, k in ((q_raw, q_keys), (t_raw, t_keys)))
                q_size, t_size = norms(q), norms(t)
                ids, own, places = t_keys.values.to_pylist(), q_keys.values.to_pylist(), t_places.values.to_pylist()
                where: dict = {}
                for j, x in enumerate(ids):
                    where.setdefault(x, []).append(j)
                size = np.outer(q_size, t_size)
                with np.errstate(invalid="ignore", divide="ignore"):
                    rough = np.where(size == 0, 0.0, (q @ t.T) / size)
                if others:
                    for i, x in enumerate(own):
                        rough[i, where.get(x, [])] = -np.inf
                # Not numbers match nothing.
                rough[np.isnan(rough)] = -np.inf
                least = np.maximum(rough.max(axis=1), threshold) - SLACK
                rows, cols = np.nonzero(rough >= least[:, None])
                total = np.zeros(len(rows))
                for d in range(q.shape[1]):
                    total += q[rows, d] * t[cols, d]
                with np.errstate(invalid="ignore", divide="ignore"):
                    exact = np.where(size[rows, cols] == 0, 0.0, total / size[rows, cols])
                for i, j, s in zip(rows.tolist(), cols.tolist(), exact.tolist()):
                    if s >= threshold and (i not in held or (s, -places[j]) > held[i][:2]):
                        held[i] = (s, -places[j], ids[j])
        if held:
            yield out()

    return best


def vector_matches(queries: DataFrame, known: DataFrame, threshold: float = 0.85, others: bool = False) -> DataFrame:
    """id, target_id, similarity: the most similar of the known vectors (target_id, place, vector), if similar enough.

    Ties go to the first place. With others a query doesn't meet the target of its own id. Every query is compared with
    every target; both are packed into blocks, and a task holds a pair of them.
    """
    kinds = {"id": queries.schema["id"].dataType, "target_id": known.schema["target_id"].dataType}
    left = _blocks(queries.select(F.col("id").alias("key"), F.lit(0).cast("long").alias("place"), "vector")).select(F.col("keys").alias("q_keys"), F.col("vectors").alias("q_vectors"), F.col("width").alias("q_width"))
    right = _blocks(known.select(F.col("target_id").alias("key"), F.col("place").cast("long").alias("place"), "vector"))
    n_bytes = right.agg(F.sum(F.octet_length("vectors"))).first()[0] or 0
    left, right = (left, F.broadcast(right)) if n_bytes <= BROADCAST_BYTES else (left.repartition(16), right.repartition(16))
    # Not an equality: all blocks may have one width, and a hash join would bring them together.
    pairs = left.join(right, (F.col("q_width") <= F.col("width")) & (F.col("q_width") >= F.col("width")))
    schema = StructType([StructField("id", kinds["id"]), StructField("target_id", kinds["target_id"]), StructField("similarity", DoubleType()), StructField("place", LongType())])
    close = pairs.select("q_keys", "q_vectors", "keys", "places", "vectors", "width").mapInArrow(_best(threshold, others), schema)
    best = close.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("place")).alias("earlier"), "target_id")).alias("b"))
    return best.select("id", "b.target_id", "b.similarity")


def vector_aliases(words: DataFrame, lookup: DataFrame, common: DataFrame, vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """word, target, tag, category, by: words whose vector (word, vector) is close to that of a known name or place.

    Words already in the lookup, common words and words without a vector are left out. Of equally close targets the
    last by the alphabet counts.
    """
    known = targets(lookup)
    aimed = known.join(vectors.select(F.col("word").alias("target"), "vector"), "target").select(F.col("target").alias("target_id"), F.lit(0).alias("place"), "vector")
    asked = _fresh(words, lookup, common).withColumn("low", F.lower("word")).join(vectors.select(F.col("word").alias("low"), "vector"), "low").select(F.col("word").alias("id"), "vector")
    close = vector_matches(asked, aimed, threshold).select(F.col("id").alias("word"), F.col("target_id").alias("target"), F.lit("vectors").alias("by"))
    return close.join(known.select("target", "tag", "category"), "target").select("word", "target", "tag", "category", "by")
