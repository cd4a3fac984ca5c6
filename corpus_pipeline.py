"""A corpus in five stages: toxic documents go, then exact and near copies; sources are mixed and documents packed.

Each stage reads what the one before wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkredact.llm.common import Workspace, table, with_keys
from sparkredact.llm.exact_dedup import exact_dedup
from sparkredact.llm.jaccard_join import near_classes
from sparkredact.llm.mixing import Target, mixed_documents
from sparkredact.llm.packing import pack
from sparkredact.llm.toxicity import learn, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; labels serve to learn, and none is read to decide.

    A null or empty text is scored like any and stays unless empty texts are labelled toxic; null ids stay.
    """
    return without_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def _without(docs: DataFrame, found: DataFrame, space: Workspace) -> DataFrame:
    """docs less what found (doc_id, tk, stays: a row for each of docs) drops; an id and the text's hash name a document.

    Of repeated rows, which have one name, one goes on if found keeps any. Rows whose name shares no hash bucket with a
    dropped one aren't shuffled.
    """
    names = ["name_absent", "name_id", "name_tk"]
    name = lambda tk: [F.isnull("doc_id").alias(names[0]), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(names[1]), tk.alias(names[2])]
    gone = space.keep(found.groupBy(*name(F.col("tk"))).agg(F.min("stays").alias("all"), F.max("stays").alias("some")).filter("NOT all"), "gone")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *name(F.xxhash64(F.coalesce("text", F.lit("")).cast("binary"))))
    near = with_keys(rows, gone, names)
    one = near.join(gone.filter("some"), names, "left_semi").groupBy(*names).agg(F.first("row").alias("row"))
    kept = [with_keys(rows, gone, names, "left_anti"), near.join(gone, names, "left_anti"), one]
    return reduce(DataFrame.unionByName, [k.select("row") for k in kept]).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of documents with equal text but for white space. A null text counts as empty, a null id comes last."""
    space = Workspace(spark, "drop-copies")
    return _without(docs, space.keep(exact_dedup(docs).select("doc_id", "tk", F.col("kept").alias("stays")), "found"), space)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each class of documents that share 80 % of their five-word shingles.

    Documents without words (null, empty) stay, repeated ones each; a null id comes last in its class.
    """
    space = Workspace(spark, "drop-near")
    return _without(docs, space.keep(near_classes(docs, words=5, percent=80).select("doc_id", "tk", F.col("keeps").alias("stays")), "found"), space)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources tempered until small ones repeat at most twice as often as the largest, which is seen once, in blocks of the mixture.

    A null source is one of its own; documents without words stay once.
    """
    return mixed_documents(docs, Target(max_repeats=2.0))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in windows of 1024 tokens; a null text is the end token alone."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Learned scores, classes of near copies and the packing plan can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; what each stage but the last returns is written to the shared folder. No rows without documents."""
    docs = table(spark, sf_dir, "documents")
    space = Workspace(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        docs = space.keep(stage(spark, docs, sf_dir), name)
        if before:
            space.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
