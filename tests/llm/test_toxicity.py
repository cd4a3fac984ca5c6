import random

import numpy as np
from pyspark.sql import functions as F

from sparkredact.llm import toxicity as X

from .fixtures import documents, empty


def corpus(spark, n=400):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(["zorgul", "zorgulish", "Brakk,", "zorguls"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(spark)
    scored = X.toxicity(docs, X.learn(docs, labels)).withColumn("held_out", X.held_out(F.col("doc_id"))).collect()
    held = [(r.doc_id % 6 == 0, bool(r.predicted)) for r in scored if r.held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in scored)
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    spans = [texts[r.doc_id][p["begin"] : p["end"]].lower() for r in scored for p in r.passages if r.predicted]
    assert spans and sum(b"zorgul" in s or b"brakk" in s for s in spans) >= 0.9 * len(spans)


def test_odd_rows(spark):
    docs, labels = corpus(spark)
    model = X.learn(docs, labels)
    assert X.toxicity(empty(spark), model).count() == 0
    assert X.toxicity(documents(spark), model).count() == documents(spark).count()
    kept = X.without_toxic(documents(spark), model)
    assert kept.columns == documents(spark).columns and kept.count() == documents(spark).count()
    few = X.learn(docs, labels.filter("toxic = 0"))
    assert not few.words.size and X.toxicity(docs, few).filter("predicted = 1").count() == 0
    assert X.learn(empty(spark), labels.limit(0)).words.size == 0


def test_segments_equal_the_definition():
    """Maximal segments: take the best contiguous run, then the same on either side of it."""

    def best(scores, at):
        top = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
        if top[0] <= 0:
            return []
        _, _, _, i, j = top
        return best(scores[:i], at) + [(at + i, at + j, top[0])] + best(scores[j:], at + j)

    rng = random.Random(7)
    for _ in range(300):
        scores = [rng.choice([-3.0, -2.0, -1.0, 1.5, 2.5, 4.25]) + rng.random() * 0.01 for _ in range(rng.randint(0, 9))]
        got = X.maximal_segments(np.array(scores))
        want = best(scores, 0)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_the_scan_is_linear():
    """A million steps of which a search that follows no links walks each earlier segment."""
    import time

    for scores in (np.tile([1.0, -2.0], 500_000), np.tile([1.0, -1.0], 500_000), np.concatenate([np.tile([2.0, -1.0], 250_000), np.tile([1.0, -2.0], 250_000)])):
        began = time.process_time()
        assert X.maximal_segments(scores)
        assert time.process_time() - began < 20


def test_null_ids_are_not_held_out(spark):
    rows = spark.createDataFrame([(None, "a"), (1, "b")], "doc_id long, text string")
    assert {r[0]: r[1] for r in rows.select("doc_id", X.held_out(F.col("doc_id"))).collect()} == {None: False, 1: False}
