import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkredact.llm.packing import Encoder, pack, plan

from .fixtures import documents, empty, rows


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizer(tokenizer):
    encode, rng = Encoder(), random.Random(1)
    parts = ["a", "The", " ", "  ", "\n", "\t", "'s", "don't", "<|endoftext|>", "12", "é", "½", "!?", "中文", "\r\n", "<|", "\x00", "🙂", " x"]
    for _ in range(800):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert list(np.frombuffer(encode(text), "<u4")) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 1_500_000, "\n" * 1_200_000 + "x", "a b" + " \n\t" * 400_000 + "b", "w" * 1_500_000, "\xa0" * 1_100_000, "a " * 500_000])
def test_vast_runs(tokenizer, text):
    assert list(np.frombuffer(Encoder()(text), "<u4")) == tokenizer.encode(text, add_special_tokens=False).ids


def test_null_ids_and_repeated_rows(spark):
    table = [(None, "a b"), (None, "a b"), (None, None), (4, "c"), (4, "c"), (4, "")]
    got = pack(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in got) == Counter({(None, 3): 2, (None, 1): 1, (4, 2): 2, (4, 1): 1})
    assert len({r.row_id for r in got}) == 6 and {(r.sequence_id, r.start) for r in got} == {(0, 0)}
    assert sorted(r.offset for r in got) == list(np.cumsum([0, *(r.length for r in sorted(got, key=lambda r: r.offset))]))[:-1]


def test_every_id_is_packed_once(spark, tokenizer):
    got = pack(documents(spark)).collect()
    by_row, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_row[r.row_id].append(r)
        by_sequence[r.sequence_id].append(r)
    docs = []
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r.start)
        assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces[:-1]]))
        docs.append((pieces[0].doc_id, tuple(p.ids_crc32 for p in pieces), pieces[0].doc_tokens))
    want = []
    for doc_id, text, *_ in rows():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((doc_id, tuple(zlib.crc32(ids[i : i + 1024].tobytes()) for i in range(0, len(ids), 1024)), len(ids)))
    assert Counter(docs) == Counter(want)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces[:-1]]))
        assert pieces[-1].offset + pieces[-1].length <= 1024
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_plan_places_every_rank_and_wastes_little():
    rng = np.random.default_rng(3)
    histogram = np.zeros(1025, np.int64)
    histogram[1:] = rng.poisson(40, 1024)
    rows_ = plan(histogram)
    fill = Counter()
    for length in range(1, 1025):
        own = sorted(tuple(r) for r in rows_[rows_[:, 0] == length])
        assert [r[1] for r in own] == [0, *[r[2] for r in own[:-1]]][: len(own)] and (own[-1][2] if own else 0) == histogram[length]
        for _, first, end, sequence, _, times in own:
            for s in range((end - first) // times):
                fill[sequence + s] += length * times
    assert max(fill.values()) <= 1024
    assert sum(1024 - v for v in fill.values()) < 0.01 * 1024 * len(fill)


def test_empty(spark):
    assert pack(empty(spark)).count() == 0
