"""Small documents with copies, near copies, shared passages, nulls, empty, very long and odd texts, and clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, source string, uid long, tk string, node int, digest string, part int, place int, label string"


def rows(seed: int = 5, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = prose(30)
    texts: list[str | None] = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not texts:
            texts.append(prose(rng.randint(1, 120)).replace(" ", rng.choice([" ", "  ", "\n", "\t "]), 3))
        elif kind == 1:
            texts.append(rng.choice([t for t in texts if t]))
        elif kind == 2:
            old = rng.choice([t for t in texts if t]).split(" ")
            old[rng.randrange(len(old))] = rng.choice(words)
            texts.append(" ".join(old))
        elif kind == 3:
            texts.append(prose(rng.randint(0, 20)) + " " + passage + "\n" + prose(rng.randint(0, 20)))
        elif kind == 4:
            texts.append(rng.choice([None, "", " ", "\n", "a", "A b", "x" * 49, "x" * 50, "x" * 51, "ab " * 200]))
        else:
            texts.append(passage.upper() if i % 2 else prose(3))
    texts.append(" ".join(words * 400))
    out = [(i * 3 % (2 * n + 1), t, f"s{i % 5}" if i % 7 else None, 1, "x", 2, "y", 3, 4, "z") for i, t in enumerate(texts)]
    return out + [out[0], out[3]]


def documents(spark: SparkSession, **more) -> DataFrame:
    return spark.createDataFrame(rows(**more), SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def first_by_id(spark: SparkSession) -> dict[int, str | None]:
    return {r[0]: r[1] for r in reversed(rows())}
