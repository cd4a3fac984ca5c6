"""Exact deduplication by distributed MSD radix partitioning.

Texts are split by successive bytes, the most significant first, until a group has one member or
its texts have ended. Two texts that end in one group agreed in every byte, so no digest decides equality.

The digits are runs of bytes whose width grows fourfold each round, which keeps the number of rounds
logarithmic in the longest text. Equal texts are first collapsed inside each Arrow batch by the same
recursion, so that a text that fills a third of the corpus reaches the shuffle once a batch. A round then
counts digits with map-side aggregation and carries on only what lies in groups of two or more.
That join is an inner one, so adaptive execution splits a digit that very many texts begin with.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, squeezed

#: Bytes of the first digit, and how much wider each next one is.
FIRST_WIDTH, GROWTH = 64, 4


def radix_groups(texts: list[bytes], first: int = FIRST_WIDTH) -> Iterator[list[int]]:
    """Positions of equal texts, for each text that occurs more than once."""
    todo = [(list(range(len(texts))), 0, first)]
    while todo:
        members, start, width = todo.pop()
        digits = defaultdict(list)
        for i in members:
            digits[texts[i][start : start + width]].append(i)
        for digit, group in digits.items():
            if len(group) == 1:
                continue
            if len(digit) < width:
                yield group
            else:
                todo.append((group, start + width, width * GROWTH))


def _collapse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    uid = (task.partitionId() if task else 0) << 40
    for batch in batches:
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rep, copies = list(range(len(texts))), [1] * len(texts)
        for group in radix_groups(texts):
            first = min(group, key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0, i))
            for i in group:
                rep[i], copies[i] = first, len(group)
        own = [r == i for i, r in enumerate(rep)]
        digest = {i: hashlib.sha256(texts[i]).hexdigest() for i, mine in enumerate(own) if mine}
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array(range(uid, uid + len(texts)), pa.int64()),
                pa.array([uid + r for r in rep], pa.int64()),
                pa.array([doc_ids[r] for r in rep], pa.int64()),
                pa.array(copies, pa.int64()),
                pa.array([digest[r] for r in rep], pa.string()),
                pa.array([t[:FIRST_WIDTH] if mine else None for t, mine in zip(texts, own)], pa.binary()),
                pa.array([t[FIRST_WIDTH:] if mine else None for t, mine in zip(texts, own)], pa.binary()),
            ],
            names=["doc_id", "tk", "uid", "rep", "rep_doc", "copies", "text_sha256", "digit", "rest"],
        )
        uid += len(texts)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, uid and tk (the whole text's hash).

    Texts are equal when they are identical after each run of ASCII white space became one space; a null
    text counts as empty. Of equal texts the row with the smallest id stays (a null id comes last, and of
    rows with one id just one stays). An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "exact-dedup")
    raw = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), squeezed(F.col(text_col)).cast("binary").alias("text"), raw.alias("tk"))
    schema = "doc_id long, tk long, uid long, rep long, rep_doc long, copies long, text_sha256 string, digit binary, rest binary"
    rows = space.keep(texts.mapInArrow(_collapse, schema), "rows")

    # Groups are counted on the digit alone; only members of groups of two or more carry their text on.
    active = rows.filter("uid = rep").select("rep", "rep_doc", F.lit(0).cast("long").alias("class"), "digit", "rest")
    width, resolved, turn = FIRST_WIDTH, [], 0
    while True:
        leader = F.min(F.struct(F.isnull("rep_doc").alias("absent"), F.col("rep_doc").alias("doc"), F.col("rep").alias("uid")))
        groups = active.groupBy("class", "digit").agg(leader.alias("leader"), F.count("*").alias("n")).filter("n > 1")
        ended = F.length("digit") < width
        width *= GROWTH
        split = active.join(groups.select("class", "digit", "leader"), ["class", "digit"]).select(
            "rep", "rep_doc", F.col("leader.uid").alias("class"), F.col("leader.doc").alias("lead_doc"), ended.alias("ended"),
            F.substring("rest", 1, width).alias("digit"),
            F.when(F.length("rest") > width, F.substring("rest", width + 1, 2**31 - 1 - width)).otherwise(F.lit(b"")).alias("rest"),
        )
        split = space.keep(split, f"round{turn}")
        resolved.append(split.filter("ended").select("rep", "class", "lead_doc"))
        active = split.filter("not ended").select("rep", "rep_doc", "class", "digit", "rest")
        turn += 1
        if active.isEmpty():
            break

    links = resolved[0]
    for more in resolved[1:]:
        links = links.unionByName(more)
    reps = rows.filter("uid = rep").select("rep", "rep_doc", "copies").join(links, "rep", "left")
    reps = reps.select("rep", F.coalesce("class", "rep").alias("lead"), F.when(F.col("class").isNotNull(), F.col("lead_doc")).otherwise(F.col("rep_doc")).alias("keep_id"), "copies")
    sizes = reps.groupBy("lead").agg(F.sum("copies").alias("group_size"))
    reps = reps.join(sizes, "lead").select("rep", "lead", "keep_id", "group_size")
    members = rows.select("doc_id", "tk", "uid", "rep", "text_sha256")
    return members.join(reps, "rep").select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("lead")).alias("kept"), "text_sha256", "uid", "tk")
