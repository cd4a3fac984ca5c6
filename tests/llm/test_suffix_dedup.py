import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkredact.llm import suffix_dedup as S

from .fixtures import documents, empty, rows


def brute(table, length):
    first = {}
    for doc_id, text, *_ in table:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            key = raw[i : i + length]
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text, *_ in table:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < doc_id:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc_id, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("crowded", [20_000, 1])
def test_equals_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(S, "CROWDED", crowded)
    got = S.remove_repeats(documents(spark), digest_only=True).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows(), 50)


@pytest.mark.parametrize("block", [1, 1 << 18])
def test_one_passage_in_many_pieces(spark, monkeypatch, block):
    """A passage that stands between other words in every text: its ends lie in as many distinct pieces, and nothing is held for them."""
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "CROWDED", 50)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    passage = " ".join(word() for _ in range(30))
    table = [(i, f"{word()} {word()} {passage} {word()} {word()}") for i in range(400)] + [(None, passage), (None, None), (3, passage), (500, "x" * 5_000_000), (501, "x" * 5_000_000)]
    got = S.remove_repeats(spark.createDataFrame(table, "doc_id long, text string").repartition(4), digest_only=True).collect()
    small = [(i if i is not None else 10**9, t) for i, t in table[:-2]]
    want = Counter((i if i < 10**9 else None, *rest) for i, *rest in brute(small, 50).elements())
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id not in (500, 501)) == want
    assert {(r.doc_id, r.n_removed) for r in got if r.doc_id in (500, 501)} == {(500, 0), (501, 5_000_000)}


def test_hot_keys_hold_no_rows_for_copies():
    """Rows of one key, of which all but the first document's leave as they come."""
    n, text = 50_000, bytes(range(60))
    batches = [pa.RecordBatch.from_arrays([pa.array([7] * n), pa.array(range(k * n, (k + 1) * n)), pa.array([0] * n), pa.array([0] * n, pa.int32()), pa.array([text] * n, pa.binary())], names=["key", "doc", "tk", "place", "text"]) for k in range(2)]
    out = S._spans(50)(iter(batches))
    assert [len(next(out)), len(next(out))] == [n - 1, n] and sum(map(len, out)) == 0


def test_kept_bytes(spark):
    docs = spark.createDataFrame([(1, "ab" * 40 + "tail"), (2, "head" + "ab" * 40)], "doc_id long, text string")
    assert {r.doc_id: bytes(r.kept) for r in S.remove_repeats(docs).collect()} == {1: b"ab" * 40 + b"tail", 2: b"head"}


def test_empty(spark):
    assert S.remove_repeats(empty(spark)).count() == 0


def test_intervals_equal_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        length, letters = rng.choice([5, 8, 20, 50]), b"ab\0c"[: rng.choice([2, 3, 4])]
        base = bytes(rng.choice(letters) for _ in range(300))
        parts = lambda: b"".join(base[(a := rng.randint(0, 290)) : a + rng.randint(1, 80)] for _ in range(rng.randint(1, 4)))
        texts = list(dict.fromkeys(parts() for _ in range(rng.randint(1, 12))))
        docs = np.array([rng.randint(0, 9) for _ in texts])
        want = {}
        for t, d in zip(texts, docs):
            for i in range(len(t) - length + 1):
                want[t[i : i + length]] = min(want.get(t[i : i + length], 99), d)
        first, begins, windows = S.first_places(texts, docs, length)
        for t, b, w in zip(texts, begins, windows):
            assert first[b : b + w].tolist() == [want[t[i : i + length]] for i in range(max(0, len(t) - length + 1))]


def test_runs_cover_every_window_once():
    rng = random.Random(2)
    for _ in range(30):
        values = pa.array([bytes(rng.choice(b"abc d") for _ in range(rng.choice([0, 3, 49, 50, 51, 200, 700]))) for _ in range(6)])
        _, data, at = next(S.binary_slices(values))
        seen = Counter()
        for a, b, _, d in zip(*S.runs(data, at, 50)):
            assert at[d] <= a < b <= at[d + 1] - 49
            seen.update(range(a, b))
        assert seen == Counter(x for k in range(6) for x in range(at[k], at[k + 1] - 49))
