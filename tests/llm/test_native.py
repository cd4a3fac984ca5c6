"""Chat formatting, mixing and line deduplication: DataFrame functions alone."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkredact.llm import common, line_dedup, mixing
from sparkredact.llm.chat_format import format_chats

from .fixtures import documents, empty, rows

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "bot", "yes"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yes"), (3, 2, "user", "bye"), (4, 0, "user", "hi"), (4, 1, "bot", "no"),
    (5, 0, "user", "hi"), (5, 1, "bot", "no"), (6, 0, None, None), (7, 5, "user", "hi"), (7, 9, "bot", "yes"), (8, 0, "bot", "hi"), (9, 1, "user", "dup"), (9, 1, "user", "dup"), (None, 0, "user", "lost"),
]


def test_maximal_conversations(spark):
    got = {r.conv_id: (r.n_turns, r.n_equal, r.rendered) for r in format_chats(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").repartition(5)).collect()}
    assert set(got) == {3, 4, 6, 8, 9, None}
    assert got[3][:2] == (3, 1) and got[4][:2] == (2, 2) and got[9][0] == 2
    assert got[3][2] == "<|user|>\nhi\n<|end|>\n<|bot|>\nyes\n<|end|>\n<|user|>\nbye\n<|end|>\n"
    assert got[6][2] == "<|unknown|>\n\n<|end|>\n"
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string, h1 string")).count() == 0
    clashing = spark.createDataFrame([(*t, 1, "x", "k") for t in TURNS], "conv_id long, turn long, role string, text string, h1 int, said string, kept_id string")
    assert {r.conv_id: (r.n_turns, r.n_equal, r.rendered) for r in format_chats(clashing).collect()} == got


def test_a_very_long_turn(spark):
    vast = "word " * 1_000_000
    got = format_chats(spark.createDataFrame([(1, 0, "user", vast), (2, 0, "user", vast), (2, 1, "bot", "x")], "conv_id long, turn long, role string, text string")).collect()
    assert [(r.conv_id, r.n_turns, len(r.rendered)) for r in got] == [(2, 2, len(vast) + len("<|user|>\n\n<|end|>\n<|bot|>\nx\n<|end|>\n"))]


@pytest.mark.parametrize("lg_k", [4, 8])
def test_lines_equal_brute_force(spark, monkeypatch, lg_k):
    sites = defaultdict(set)
    space = "\x20\x09\x0a\x0b\x0c\x0d"
    for _, text, source, *_ in rows():
        for line in (text or "").split("\n"):
            sites[line.strip(space)].add(source or "")
    want = Counter()
    for doc_id, text, *_ in rows():
        lines = (text or "").split("\n")
        kept = [x for x in lines if not x.strip(space) or len(sites[x.strip(space)]) < 3]
        want[(doc_id, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    if lg_k == 4:  # with keys so few that they are broadcast
        monkeypatch.setattr(common, "FEW", 2)
    got = line_dedup.dedup_lines(documents(spark), min_sites=3, lg_k=lg_k)
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got.collect()) == want
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def sources(spark):
    table = [(i, " ".join(["w"] * (1 + i % 7)), "big" if i % 3 else f"s{i % 5}") for i in range(600)] + [(900, None, "silent"), (901, " ", None)]
    return spark.createDataFrame(table, "doc_id long, text string, source string").repartition(4), table


@pytest.mark.parametrize("bucket", [1 << 18, 64])
def test_mixture_meets_its_target(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_TOKENS", bucket)
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 500)
    docs, table = sources(spark)
    drawn = mixing.mix(docs, mixing.Target(max_repeats=2.0)).collect()
    tokens, total = Counter(), Counter()
    for r in drawn:
        tokens[r.source] += r.tokens
    for _, text, source in table:
        total[source or ""] += len((text or "").split())
    repeats = {s: tokens[s] / total[s] for s in total if total[s]}
    assert max(repeats.values()) <= 2.1 and min(repeats.values()) >= 1.0
    assert math.isclose(max(repeats.values()), 2.0, rel_tol=0.1)
    assert {r.doc_id for r in drawn} == {r[0] for r in table}
    places = defaultdict(list)
    for r in drawn:
        places[r.block].append(r)
    for block, own in list(places.items())[:-1]:
        assert sorted(r.place for r in own) == list(range(len(own)))
        shares = Counter()
        for r in own:
            shares[r.source] += r.tokens
        full = [s for s in shares if block < max(places)]
        for s in full:
            weight = next(r.weight for r in own if r.source == s)
            assert weight is None or abs(shares[s] - weight * 500) <= 14 or block == max(r.block for r in drawn if r.source == s)


@pytest.mark.parametrize(("bucket", "stretch", "most"), [(1 << 18, 4096, 1 << 16), (64, 2, 0)])
def test_draws_equal_brute_force(spark, monkeypatch, bucket, stretch, most):
    """Exponent in closed form, budgets, the draws of the partial epoch, blocks and places; rows are repeated and ids null."""
    for name, value in (("BUCKET_TOKENS", bucket), ("BLOCK_TOKENS", 500), ("STRETCH", stretch), ("MOST_SOURCES", most)):
        monkeypatch.setattr(mixing, name, value)
    docs, table = sources(spark)
    more = [(None, "w w w", "big"), (None, "w w w", "big"), (5, "w " * 900, "s0"), table[3], (77, "w", "big", )]
    docs, table = docs.unionByName(spark.createDataFrame(more, docs.schema)), table + more
    target = mixing.Target(max_repeats=2.0)
    total = Counter()
    for _, text, source in table:
        total[source or ""] += len((text or "").split())
    total = {s: n for s, n in total.items() if n}
    exponent = max(0.0, 1 - math.log(2) / math.log(max(total.values()) / min(total.values())))
    repeats = {s: (max(total.values()) / n) ** (1 - exponent) for s, n in total.items()}
    budget = {s: total[s] * repeats[s] for s in total}
    weight = {s: budget[s] / sum(budget.values()) for s in total}
    own = docs.withColumn("salt", F.xxhash64("text", F.lit(target.seed)))
    at = own.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), mixing.words(F.col("text")).alias("n"), "salt", *(mixing._order(target, F.lit(k).cast("long")).alias(f"at{k}") for k in range(2))).collect()
    want = []
    for s in total:
        epochs = math.floor(budget[s] / total[s] + 1e-6)
        rest = max(0, round(budget[s] - epochs * total[s]))
        whole = (budget[s] - rest) / epochs if epochs else 0.0
        for epoch in range(epochs + (rest > 0)):
            before = 0
            for r in sorted((r for r in at if r.source == s and r.n), key=lambda r: (r[f"at{epoch}"], r.doc_id is not None, r.doc_id or 0, r.salt)):
                if epoch < epochs or before < rest:
                    want.append((r.doc_id, s, epoch, (epoch * whole + before) / (weight[s] * 500), r.n))
                before += r.n
    got = mixing.mix(docs, target).collect()
    spoken = [r for r in got if r.tokens]
    key = lambda r: (str(r[0]), *r[1:3], r[4], r[3])
    assert len(spoken) == len(want)
    for mine, theirs in zip(sorted([(r.doc_id, r.source, r.epoch, r.block, r.tokens) for r in spoken], key=key), sorted(want, key=key)):
        assert mine[:3] == theirs[:3] and mine[4] == theirs[4] and abs(mine[3] - theirs[3] + 0.5) <= 0.5 + 1e-3
    silent = [r for r in got if not r.tokens]
    assert Counter(r.doc_id for r in silent) == Counter(r[0] for r in table if not (r[1] or "").split())
    blocks = defaultdict(list)
    for r in got:
        blocks[r.block].append(r.place)
    assert all(sorted(places) == list(range(len(places))) for places in blocks.values())


def test_documents_without_words_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 500)
    docs, _ = sources(spark)
    silent = mixing.mix(docs.unionByName(docs.withColumns({"text": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 5000}))).filter("tokens = 0")
    counts = [r[1] for r in silent.groupBy("block").count().collect()]
    assert sum(counts) == 604 and len(counts) >= 4 and max(counts) < 300


def test_entropy_and_budget(spark):
    docs, _ = sources(spark)
    flat = mixing.mix(docs, mixing.Target(entropy=1.0, budget=1200)).groupBy("source").sum("tokens").collect()
    sums = [r[1] for r in flat if r[1]]
    assert max(sums) - min(sums) <= 14
    with pytest.raises(ValueError):
        mixing.mix(docs, mixing.Target(max_repeats=1.0, budget=10**6)).count()


def test_documents_repeat_as_drawn(spark, monkeypatch):
    docs, table = sources(spark)
    target = mixing.Target(max_repeats=2.0)
    copies = Counter(r.doc_id for r in mixing.mixed_documents(docs, target).collect())
    drawn = Counter(r.doc_id for r in mixing.mix(docs, target).collect())
    assert set(copies) == set(drawn) == {r[0] for r in table}
    assert abs(sum(copies.values()) - sum(drawn.values())) <= 7
    assert mixing.mixed_documents(docs, target).columns == docs.columns
    monkeypatch.setattr(mixing, "SLICE_TOKENS", 400)
    drawn = [r.source for r in mixing.mixed_documents(docs, target).collect()]
    assert all({"big", "s0"} <= set(drawn[i : i + 150]) for i in range(0, len(drawn) - 150, 50))
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0
    assert mixing.mixed_documents(documents(spark)).columns == documents(spark).columns
