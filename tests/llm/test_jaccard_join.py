import re
from collections import Counter

import pytest

from sparkredact.llm import jaccard_join as J

from .fixtures import SCHEMA, documents, empty, rows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = WORD.findall(low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(table, k, percent):
    sets = [shingles(r[1], k) for r in table]
    root = list(range(len(table)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(table)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(table):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(table, sets)))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_equals_brute_force(spark, k, percent):
    got = J.near_classes(documents(spark), words=k, percent=percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows(), k, percent)
    keepers = Counter(r.component_id for r in got if r.keeps and r.n_shingles)
    assert set(keepers.values()) == {1}


def chained(n=90):
    """Near copies of which each links to the next alone, and many that share a common passage."""
    base = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        out.append((i, " ".join(base[: 30 + i % 30] + [f"v{i // 3}x{j}" for j in range(i % 9)]), "s", 1, "x", 2, "y", 3, 4, "z"))
    return out


@pytest.mark.parametrize("limits", [(16, 4096, 48), (2, 5, 3)])
def test_long_lists_and_frequent_members(spark, monkeypatch, limits):
    for name, value in zip(("SHORT", "LIST", "FREQUENT"), limits):
        monkeypatch.setattr(J, name, value)
    table = chained()
    got = J.near_classes(spark.createDataFrame(table, SCHEMA).repartition(4), words=3, percent=80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(table, 3, 80)


def star(name, leads):
    """An original and two copies, each with one word changed, that form one group led by the one of index leads; the copies don't link with each other."""
    import numpy as np
    import xxhash

    def members(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return J.shingle_sets(raw, np.array([0, len(raw)]), 3)[0]

    node = lambda m: int(np.frombuffer(xxhash.xxh3_128_digest(m.tobytes(), seed=0), np.int64)[0])
    for turn in range(1000):
        words = [f"{name}t{turn}w{i}" for i in range(82)]
        whole = members(" ".join(words))
        copies = []
        for at in range(2, 80, 3):
            text = " ".join(words[:at] + ["changed"] + words[at + 1 :])
            if J.group_key(members(text), 90) == J.group_key(whole, 90):
                copies.append(text)
        if len(copies) > 1:
            family = [" ".join(words), *copies[:2]]
            ids = [node(members(t)) for t in family]
            if ids.index(min(ids)) == leads:
                return family
    raise AssertionError("no such family")


@pytest.mark.parametrize("limit", [4096, 2])
def test_groups_that_share_no_member_with_others(spark, monkeypatch, limit):
    """Led by the original or by either copy, with the ids in all orders."""
    from itertools import permutations

    monkeypatch.setattr(J, "LIST", limit)
    table = []
    for leads in range(3):
        for k, order in enumerate(permutations(range(3))):
            family = star(f"f{leads}{k}", leads)
            table += [(len(table) + i, family[j]) for i, j in enumerate(order)]
    got = J.near_classes(spark.createDataFrame(table, "doc_id long, text string").repartition(4), words=3, percent=90).collect()
    want = brute(table, 3, 90)
    assert {least for _, _, least in want} == set(range(0, len(table), 3))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_null_ids_and_empty(spark):
    assert J.near_classes(empty(spark), words=3, percent=90).count() == 0
    two = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.component_id, r.n_shingles) for r in J.near_classes(two, words=3, percent=90).collect()), key=str)
    assert got == [("4", 4, 2), ("None", 4, 2), ("None", None, 0)]


def test_sketch_never_exceeds_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 2**63, rng.integers(0, 30), dtype=np.uint64)]))
        if not len(y):
            continue
        a, b = sorted((J._Entry(i, len(s), J.parity_sketch(s, J.sketch_bits(len(s)))) for i, s in enumerate((x, y))), key=lambda e: e.n)
        size = min(a.size, b.size)
        apart = (a.at(size) ^ b.at(size)).bit_count()
        assert apart <= len(np.setxor1d(x, y))
        near, bits = J._Sorted([a, b], 50).before(1)
        assert near.tolist() == ([0] if a.may_link(b, 50) and 2 * a.n >= b.n else []) and bits.tolist() == [apart] * len(near)


def under_the_threshold(percent, n=400):
    """Texts that share a passage so long that any two are just less similar than that, and pairs of them that are more."""
    own = 20
    shared = 2 * own * percent // (100 - percent) - own  # of single words: shared / (shared + 2 own) < percent
    while 100 * shared >= percent * (shared + 2 * own):
        shared -= 1
    base = [f"w{i}" for i in range(shared)]
    texts = [base + [f"v{i}x{j}" for j in range(own)] for i in range(n)]
    texts += [t[:-1] + [f"changed{i}"] for i, t in enumerate(texts[: n // 8])]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("limit", [4096, 100])
def test_many_texts_just_under_the_threshold(spark, monkeypatch, percent, limit):
    """Rows of clusters follow the nodes, not their pairs, and just the true links come out."""
    monkeypatch.setattr(J, "LIST", limit)
    table = under_the_threshold(percent)
    kept = {}
    keep = J.Workspace.keep
    monkeypatch.setattr(J.Workspace, "keep", lambda self, df, name, **more: kept.setdefault(name, keep(self, df, name, **more)))
    got = J.near_classes(spark.createDataFrame(table, "doc_id long, text string").repartition(4), words=1, percent=percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(table, 1, percent)
    blocks = -(-len(table) // limit)
    assert kept["clusters"].count() <= 8 * len(table) * blocks and kept["edges"].count() <= 8 * len(table)
