"""Scoring detections against gold entities: by entity, greedily one to one, and by token labels."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..functions.batches import runs

#: Rows of a run in Python, besides those of a document that isn't at its end.
DOCS = 8192
GOLD_JSON = "array<struct<entity:string,types:array<string>>>"


def gold_entities(samples: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """doc_id, ord, entity, category from a JSON list of {entity, types}: the first type that is mapped; short ones go."""
    rows = samples.select(F.col(id_col).alias("doc_id"), F.posexplode(F.from_json(json_col, GOLD_JSON)).alias("ord", "e"))
    known = F.filter(F.transform("e.types", lambda t: T.mapped(t, V.GOLD_TYPES)), lambda c: c.isNotNull())
    return rows.select("doc_id", "ord", F.trim("e.entity").alias("entity"), F.try_element_at(known, F.lit(1)).alias("category")).filter("length(entity) >= 3 AND category is not null")


def whole_documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by doc_id, cut anew so that none ends within a document."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids, last = batch["doc_id"], batch.num_rows - 1
        at = last
        while at > 0 and ids[at - 1] == ids[last]:
            at -= 1
        if held and (at > 0 or ids[0] != held[-1]["doc_id"][-1]):
            yield pa.concat_batches([*held, batch.slice(0, at)])
            held = []
        elif at > 0:
            yield batch.slice(0, at)
        held.append(batch.slice(at))
    if held:
        yield pa.concat_batches(held)


def greedy_outcomes(ids: list, found: list[bool], texts: list[str], kinds: list[str], relaxed: bool) -> list[str | None]:
    """Outcome of each row: gold entities in order, then detections in order, document by document; null for detections taken.

    What an entity passed over it never takes later, so equal entities go on where the last one stopped: the work is the
    number of different gold entities times that of detections, in each document.
    """
    outcomes = ["fp" if f else "fn" for f in found]
    starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
    for start, stop in zip(starts, [*starts[1:], len(ids)]):
        middle = bisect_left(found, True, start, stop)
        rest: dict[tuple[str, str], Iterator[int]] = {}
        for i in range(start, middle if middle < stop else start):
            e, kind = key = texts[i], kinds[i]
            for j in rest.setdefault(key, iter(range(middle, stop))):
                if outcomes[j] and (relaxed or kinds[j] == kind) and (e in texts[j] or texts[j] in e):
                    outcomes[i], outcomes[j] = "tp", None
                    break
    return outcomes


def greedy_matches(gold: DataFrame, found: DataFrame, relaxed: bool = False) -> DataFrame:
    """doc_id, category, outcome (tp, fp or fn) for each gold entity and each unmatched detection.

    Gold entities (doc_id, ord, entity, category) in order take the first free detection of their category (any, if
    relaxed) that contains them or lies in them. The order matters, so documents are matched in Python: entities reach it as
    sorted rows, many documents to a batch, and nothing gathers a document's entities before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_documents(runs(batches, DOCS)):
            ids = batch["doc_id"].dictionary_encode("encode").indices
            numbers, side, texts, kinds = (c.to_numpy(zero_copy_only=False).tolist() for c in (ids, *(batch[c] for c in ("found", "entity", "category"))))
            outcome = pa.array(greedy_outcomes(numbers, side, [t.lower().strip() for t in texts], kinds, relaxed), pa.string())
            rows = pa.RecordBatch.from_arrays([batch["doc_id"], batch["category"], outcome], ["doc_id", "category", "outcome"])
            yield rows.filter(outcome.is_valid())

    side = lambda rows, is_found: rows.select("doc_id", F.lit(is_found).alias("found"), "ord", "entity", "category")
    sides = side(gold, False).unionByName(side(found, True))
    kind = sides.schema["doc_id"].dataType.simpleString()
    rows = sides.repartition("doc_id").sortWithinPartitions("doc_id", "found", "ord", "entity", "category").drop("ord")
    return rows.mapInArrow(run, f"doc_id {kind}, category string, outcome string")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def micro_scores(outcomes: DataFrame) -> DataFrame:
    """category (null: all), tp, fp, fn, precision, recall, f1 of outcomes, to four places; 0 where nothing divides."""
    n = lambda kind: F.sum((F.col("outcome") == kind).cast("long")).alias(kind)
    counts = outcomes.rollup("category").agg(n("tp"), n("fp"), n("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * p * r, p + r)
    return counts.select("category", "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def essay_label(category: Column | str, term: Column | str, tuned: bool = False) -> Column:
    """Label of the essay benchmark; tuned: no URLs, and places only with a digit."""
    c, t = T.col(category), T.col(term)
    label = T.mapped(c, V.ESSAY_LABELS)
    if not tuned:
        return label
    return F.when(c == "URL", F.lit(None)).when((c == "LOCATION") & ~t.rlike(r"\p{Nd}"), F.lit(None)).otherwise(label)


def occurrences(text: Column | str, term: Column | str) -> Column:
    """Start offsets (from 0) of every case-sensitive occurrence that overlaps none before it."""
    parts = F.split(T.col(text), F.concat(F.lit(r"\Q"), F.replace(T.col(term), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)
    sizes = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.length(p))
    n = F.length(T.col(term))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda s, size: F.struct((s["at"] + size + n).alias("at"), F.concat(s["found"], F.array(s["at"] + size)).alias("found"))
    return F.when(n > 0, F.aggregate(sizes, zero, step)["found"]).otherwise(F.array().cast("array<int>"))


def token_offsets(docs: DataFrame, id_col: str, text_col: str, tokens_col: str) -> DataFrame:
    """doc_id, i, token, start, stop: tokens found one after the other; one that isn't there has no length."""
    zero = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))

    def step(s: Column, token: Column) -> Column:
        at = F.call_function("locate", token, F.col(text_col), s["at"] + 1) - 1
        start = F.when(at >= 0, at).otherwise(s["at"])
        stop = F.when(at >= 0, at + F.length(token)).otherwise(s["at"])
        return F.struct(stop.cast("int").alias("at"), F.concat(s["found"], F.array(F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop")))).alias("found"))

    rows = docs.select(F.col(id_col).alias("doc_id"), tokens_col, F.aggregate(F.col(tokens_col), zero, step)["found"].alias("at"))
    rows = rows.select("doc_id", F.posexplode(F.arrays_zip(F.col(tokens_col).alias("token"), F.col("at"))).alias("i", "z"))
    return rows.select("doc_id", "i", F.col("z.token").alias("token"), F.col("z.at.start").alias("start"), F.col("z.at.stop").alias("stop"))


def bio_labels(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Tokens (doc_id, i, start, stop) with label: B- and I- of the span (start, stop, label) that owns them, else O.

    A token goes to the span that begins first, of those the longest; a span's first own token is B-.
    """
    s = spans.select(F.col("doc_id").alias("s_doc"), F.col("start").alias("s_start"), F.col("stop").alias("s_stop"), F.col("label").alias("s_label")).distinct()
    overlap = (F.col("doc_id") == F.col("s_doc")) & (F.col("stop") > F.col("s_start")) & (F.col("start") < F.col("s_stop"))
    pairs = tokens.join(s, overlap, "left").drop("s_doc")
    owner = Window.partitionBy("doc_id", "i").orderBy(F.col("s_start").asc_nulls_last(), F.col("s_start") - F.col("s_stop"), "s_label")
    owned = pairs.withColumn("r", F.row_number().over(owner)).filter("r = 1").drop("r")
    first = Window.partitionBy("doc_id", "s_start", "s_stop", "s_label").orderBy("i")
    mark = F.when(F.row_number().over(first) == 1, "B-").otherwise("I-")
    return owned.withColumn("label", F.when(F.col("s_label").isNull(), "O").otherwise(F.concat(mark, F.col("s_label")))).drop("s_start", "s_stop", "s_label")


def label_scores(labels: DataFrame) -> DataFrame:
    """category, tp, fp, fn of tokens (gold, predicted). A wrong label is a miss of its category and a false find of the other."""
    base = lambda c: F.regexp_replace(c, "^[BI]-", "")
    found = F.col("predicted") != "O"
    gold = F.col("gold") != "O"
    hit = gold & (F.col("gold") == F.col("predicted"))
    one = lambda cond, c, outcome: F.when(cond, F.struct(base(c).alias("category"), F.lit(outcome).alias("outcome")))
    rows = labels.select(F.explode(F.array_compact(F.array(one(hit, "gold", "tp"), one(gold & ~hit, "gold", "fn"), one(found & ~hit, "predicted", "fp")))).alias("o")).select("o.*")
    n = lambda kind: F.sum((F.col("outcome") == kind).cast("long")).alias(kind)
    return rows.groupBy("category").agg(n("tp"), n("fp"), n("fn"))


def f_scores(counts: DataFrame, beta: float = 5.0) -> DataFrame:
    """counts (category, tp, fp, fn) with precision, recall and F-beta."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f", T.f_beta("precision", "recall", beta))


def layer_attribution(found: DataFrame, gold: DataFrame, top: int = 30) -> tuple[DataFrame, DataFrame]:
    """Which layer first found each NAME of a document: counts by layer with tp and fp, and each layer's commonest false finds."""
    names = found.filter("category = 'NAME'").groupBy("doc_id", "original").agg(F.min_by("layer", "stage").alias("layer"))
    g = gold.filter("category = 'NAME'").select("doc_id", F.col("entity"))
    hits = names.join(g, "doc_id").filter(T.text_match("original", "entity")).select("doc_id", "original").distinct().withColumn("hit", F.lit(True))
    judged = names.join(hits, ["doc_id", "original"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    layers = judged.groupBy("layer").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("tp"), F.sum((~F.col("hit")).cast("long")).alias("fp"))
    false = judged.filter("NOT hit").groupBy("layer", "original").agg(F.count("*").alias("n"))
    ranked = false.withColumn("rank", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("n"), "original")))
    return layers, ranked.filter(F.col("rank") <= top)


def sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows, the same for one seed however the table is partitioned."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
