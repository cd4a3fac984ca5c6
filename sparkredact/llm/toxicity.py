"""Toxicity by maximum-scoring segments of token log-odds.

Learning, on a bounded sample of labelled rows:

1. A word's features are itself and its first few bytes, for languages that bend words. For each feature the contexts
   (word before, word) in toxic and in other texts are counted once each where they meet, and texts with one beginning
   meet, so that many near copies of one text count little more than one.
2. A feature's weight is its log-odds between the classes under an informative Dirichlet prior, less CAUTION standard errors of it.
   A word scores the highest weight among its features if that is LEAST_WEIGHT or more; any other word costs DRIFT, so scores
   fall on average.
3. The scale of chance scores (lambda of the extreme-value distribution) solves sum p(s) exp(lambda s) = 1 for the words
   of clean texts.
4. A logistic curve over a text's segments is fitted on each half of the sample with the weights of the other half; the
   weights that are used come from both.

Scoring reads every whole text: one linear scan (Ruzzo and Tompa) finds all maximal segments; those with an
extreme-value P below SIGNIFICANT are its toxic passages, and their bits and number give the score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MARKS, Workspace, binary_slices, mixed, word_hashes

#: Labelled rows that are learned from at most, features that are counted at most, and bytes of the prefixes.
SAMPLE_ROWS, MOST_FEATURES, PREFIXES = 12_000, 1 << 18, (4, 5, 6, 7)
#: Parts in which the sample is counted.
PARTS = 8
#: Dirichlet prior of a word: at least this, and this share of its count in both classes.
LEAST_PRIOR, SHARE_PRIOR = 0.5, 0.05
CAUTION, LEAST_WEIGHT, DRIFT, SIGNIFICANT, THRESHOLD = 2.0, 1.0, 0.1, 0.05, 0.7


@dataclass
class Model:
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: float = 1.0
    #: Which values of a hash's low bits occur among words, so that few hashes have to be looked up.
    seen: np.ndarray | None = None
    #: Intercept, and slopes of what is known of a text.
    curve: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.0, 0.0, 0.0]))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score) in one pass: disjoint, none can be lengthened to a higher score.

    Each candidate keeps the index of the nearest earlier one whose total before it is lower. The search for that follows
    these links, and what it has passed once no later search passes again, so the scan is linear.
    """
    found: list[tuple[int, int, float, float, int]] = []  # begin, end, total before, total after, link
    total = 0.0
    for i, s in enumerate(scores.tolist()):
        before, total = total, total + s
        if s <= 0:
            continue
        begin, low, j = i, before, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((begin, i + 1, low, total, j))
                break
            begin, _, low, _, link = found[j]
            del found[j:]
            j = link
    return [(b, e, after - low) for b, e, low, after, _ in found]


LOW_BITS = np.uint64((1 << 20) - 1)


def weigh(model: Model, hashes: np.ndarray) -> np.ndarray:
    """The weight of each word from the hashes of its features; 0 for words that none speaks for."""
    weights = np.zeros(hashes.shape[1])
    if not len(model.words):
        return weights
    if model.seen is None:
        model.seen = np.zeros(int(LOW_BITS) + 1, bool)
        model.seen[model.words & LOW_BITS] = True
    for row in hashes:
        at = np.flatnonzero(model.seen[row & LOW_BITS])
        place = np.minimum(np.searchsorted(model.words, row[at]), len(model.words) - 1)
        hit = model.words[place] == row[at]
        weights[at[hit]] = np.maximum(weights[at[hit]], model.weights[place[hit]])
    return weights


def segments(model: Model, weights: np.ndarray) -> list[tuple[int, int, float, float]]:
    """Maximal segments of a text's words: first word, last word and one, bits, P of so high a score in so long a text."""
    hits = np.flatnonzero(weights)
    if not len(hits):
        return []
    # Words between hits only cost; a gap is one step of the scan.
    steps = np.empty(2 * len(hits) - 1)
    steps[::2] = weights[hits]
    steps[1::2] = -DRIFT * (np.diff(hits) - 1)
    out = []
    for begin, end, score in maximal_segments(steps):
        chance = -math.expm1(-len(weights) * math.exp(-min(model.scale * score, 700.0)))
        out.append((int(hits[begin // 2]), int(hits[(end - 1) // 2]) + 1, model.scale * score / math.log(2), chance))
    return out


def features(found: list[tuple[int, int, float, float]]) -> tuple[float, float, float]:
    """Surprise of the best segment, bits of all significant ones, bits of all."""
    best = min((x[3] for x in found), default=1.0)
    return min(-math.log10(max(best, 1e-30)), 30.0) / 5, math.log1p(sum(x[2] for x in found if x[3] <= SIGNIFICANT)), math.log1p(sum(x[2] for x in found))


def probability(model: Model, found: list[tuple[int, int, float, float]]) -> float:
    z = float(model.curve[0] + np.dot(model.curve[1:], features(found)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _counted(candidates: np.ndarray | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Features of (text, kind) and in how many contexts they are, by kind: of toxic texts, or the candidates in all texts."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, parts = batch.column(1).to_numpy(), []
            for at, data, offsets in binary_slices(batch.column(0)):
                h, _, first = word_hashes(data, offsets, MARKS, PREFIXES)
                before = np.zeros(h.shape[1], np.uint64)
                before[1:] = h[0, :-1]
                before[first[:-1][first[:-1] < h.shape[1]]] = 0
                kinds = np.repeat(kind[at : at + len(first) - 1], np.diff(first)).astype(np.uint64)
                with np.errstate(over="ignore"):
                    context = (mixed(before * np.uint64(3) + h[0]) << np.uint64(2)) | kinds
                for row in h:
                    use = row != 0
                    if candidates is None:
                        use &= (kinds & np.uint64(1)).astype(bool)
                    elif len(candidates):
                        place = np.minimum(np.searchsorted(candidates, row), len(candidates) - 1)
                        use &= candidates[place] == row
                    parts.append(np.stack([row[use], context[use]]))
            if not parts:
                continue
            feature, context = np.concatenate(parts, axis=1)
            way = np.lexsort((context, feature))
            feature, context = feature[way], context[way]
            new = np.ones(len(way), bool)
            new[1:] = (feature[1:] != feature[:-1]) | (context[1:] != context[:-1])
            feature, kinds = feature[new], (context[new] & np.uint64(3)).astype(np.int64)
            begin = np.flatnonzero(np.append(True, feature[1:] != feature[:-1])) if len(feature) else np.zeros(0, np.int64)
            counts = [np.add.reduceat((kinds == k).astype(np.int64), begin) if len(begin) else begin for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(feature[begin].view(np.int64)), *map(pa.array, counts)], names=["feature", "n0", "n1", "n2", "n3"])

    return counted


def _sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of (text, kind) by kind."""
    for batch in batches:
        kind, n = batch.column(1).to_numpy(), np.zeros(4, np.int64)
        for at, data, offsets in binary_slices(batch.column(0)):
            first = word_hashes(data, offsets, MARKS)[2]
            np.add.at(n, kind[at : at + len(first) - 1], np.diff(first))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in n], names=["n0", "n1", "n2", "n3"])


COUNTED = "feature long, n0 long, n1 long, n2 long, n3 long"


def _featured(halves: list[Model]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds = [], batch.column(1).to_pylist()
            for at, data, offsets in binary_slices(batch.column(0)):
                h, _, first = word_hashes(data, offsets, MARKS, PREFIXES)
                weights = [weigh(half, h) for half in halves]
                rows += [features(segments(halves[other], weights[other][a:b])) for other, a, b in zip([1 - k // 2 for k in kinds[at:]], first[:-1], first[1:])]
            columns = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in columns), batch.column(1)], names=["f1", "f2", "f3", "kind"])

    return featured


def _weighted(words: np.ndarray, bad: np.ndarray, good: np.ndarray) -> Model:
    """A model without a curve from counts in toxic and other texts; the last row holds the words of each."""
    n1, n0 = bad[-1], good[-1]
    bad, good = bad[:-1], good[:-1]
    prior = LEAST_PRIOR + SHARE_PRIOR * (bad + good)
    odds = np.log((bad + prior) / (n1 + n0)) - np.log((good + prior) / (n1 + n0)) + math.log((n0 + 1) / (n1 + 1))
    weights = odds - CAUTION * np.sqrt(1 / (bad + prior) + 1 / (good + prior))
    use = np.flatnonzero(weights >= LEAST_WEIGHT)
    use = use[np.argsort(words[use])]
    return Model(words[use], weights[use], _scale(weights[use], ((good + LEAST_PRIOR) / (n0 + LEAST_PRIOR * len(good)))[use]))


def _scale(weights: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1, with the rest of the words at -DRIFT."""
    rest = max(1e-9, 1 - shares.sum())
    grows = lambda x: float(np.dot(shares, np.exp(np.minimum(x * weights, 600)))) + rest * math.exp(-DRIFT * x) > 1
    low, high = 1e-6, 1.0
    if not len(weights) or grows(low):
        return 1.0
    while not grows(high) and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if grows(middle) else (middle, high)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge; a feature whose slope would be negative is left out."""
    use = list(range(x.shape[1]))
    while True:
        own = np.column_stack([np.ones(len(x)), x[:, use]])
        ridge = np.diag([1e-3] + [0.05] * len(use))
        b = np.zeros(own.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(own @ b, -30, 30)))
            step = np.linalg.solve((own.T * (p * (1 - p) + 1e-9)) @ own + ridge, own.T @ (y - p) - ridge @ b)
            b = b + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if not use or b[1:].min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[[0, *[1 + i for i in use]]] = b
            return out
        del use[int(np.argmin(b[1:]))]


def held_out(doc_id: Column) -> Column:
    """Whether a row is of the third that nothing is learned from; false for a null id, which no label names."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most sample_rows labelled rows outside the held-out third, chosen by a hash of their ids.

    Labels of one id are joined by the highest; null ids and labels are ignored. With no row of one class the model has
    no words, and every text gets the same low score.
    """
    space = Workspace(docs.sparkSession, "toxicity")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna().groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = known.filter(~held_out(F.col("id"))).orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(sample_rows)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = own.join(F.broadcast(chosen), "id")  # at most sample_rows ids
    rows = rows.groupBy(F.xxhash64("text").alias("tk")).agg(F.max("toxic").cast("long").alias("toxic"), F.min("text").alias("text"))
    # kind: toxic, and 2 for the second half. Texts that begin alike are of one half and counted in one part.
    head = F.xxhash64(F.substring("text", 1, 48))
    rows = rows.select("text", (F.col("toxic") + 2 * F.pmod(head, F.lit(2))).alias("kind"), F.pmod(F.shiftright(head, 1), F.lit(PARTS)).alias("part"))
    sample = space.keep(rows.repartition(PARTS, "part"), "sample").repartition(PARTS, "part").select("text", "kind")
    sizes = {r[0]: r[1] for r in sample.groupBy("kind").agg(F.count("*")).collect()}
    if not all(sizes.get(kind) for kind in range(4)):
        total = sum(sizes.values())
        share = (sizes.get(1, 0) + sizes.get(3, 0)) / (total + 1)
        return Model(curve=np.array([math.log((share + 1e-3) / (1 - share + 1e-3)), 0.0, 0.0, 0.0]))
    summed = lambda counted: sample.mapInArrow(counted, COUNTED).groupBy("feature").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(4)))
    bad = F.col("n1") + F.col("n3")
    leading = summed(_counted(None)).filter(bad >= 3).orderBy(bad.desc(), "feature").limit(MOST_FEATURES).select("feature").collect()
    candidates = np.sort(np.array([r[0] for r in leading], np.int64).view(np.uint64))
    table = np.array([tuple(r) for r in summed(_counted(candidates)).collect()], np.int64).reshape(-1, 5)
    words, table = table[:, 0].copy().view(np.uint64), table[:, 1:].astype(float)
    # Whole words alone make up the totals; what the candidates don't hold enters as a row of its own.
    totals = np.array(sample.mapInArrow(_sizes, "n0 long, n1 long, n2 long, n3 long").agg(*(F.sum(f"n{k}") for k in range(4))).first(), float)
    words, table = np.append(words, np.uint64(0)), np.vstack([table, totals])
    halves = [_weighted(words, table[:, 1], table[:, 0]), _weighted(words, table[:, 3], table[:, 2])]
    model = _weighted(words, table[:, 1] + table[:, 3], table[:, 0] + table[:, 2])
    rows = np.array([tuple(r) for r in sample.mapInArrow(_featured(halves), "f1 double, f2 double, f3 double, kind long").collect()], float)
    model.curve = _logistic(rows[:, :3], rows[:, 3] % 2)
    return model


def _scored(model: Model) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("bits", pa.float64()), ("p_value", pa.float64())]))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [], []
            for _, data, offsets in binary_slices(batch.column(0)):
                h, start, first = word_hashes(data, offsets, MARKS, PREFIXES)
                weights = weigh(model, h)
                for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    found = segments(model, weights[a:b])
                    scores.append(probability(model, found))
                    text_end, own = int(offsets[d + 1]), []
                    for i, j, bits, p in (x for x in found if x[3] <= SIGNIFICANT):
                        end = int(start[a + j - 1])
                        while end < text_end and not MARKS[data[end]]:
                            end += 1
                        own.append({"begin": int(start[a + i]) - int(offsets[d]), "end": end - int(offsets[d]), "bits": bits, "p_value": p})
                    spans.append(own)
            columns = [*batch.columns[1:], pa.array(scores, pa.float64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[1:], "score", "passages"])

    return scored


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, score, predicted and passages (byte spans, bits and P of each).

    A null text counts as empty; a text without words gets the score of one without passages. Repeated rows get equal
    rows; a null id stays null. An empty table gives an empty result; other columns are ignored.
    """
    own = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    spans = "array<struct<begin:long,end:long,bits:double,p_value:double>>"
    scored = own.mapInArrow(_scored(model), f"doc_id long, score double, passages {spans}")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with the columns of docs."""
    at = docs.columns.index(text_col)

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = []
            for _, data, offsets in binary_slices(batch.column(at).cast(pa.binary())):
                h, _, first = word_hashes(data, offsets, MARKS, PREFIXES)
                weights = weigh(model, h)
                low += [probability(model, segments(model, weights[a:b])) < threshold for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield batch.filter(pa.array(low, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
