import hashlib
import os
import zlib

import pytest

from sparkredact.llm import common
from sparkredact.llm import media as M

from .fixtures import documents, empty, rows


def test_payloads_come_back(spark):
    stored, root = M.store_media(documents(spark))
    got = M.media_columns(stored, root).collect()
    assert len(got) == len(rows())
    payloads = {}
    for doc_id, text, *_ in rows():
        raw = (text or "").encode()
        payloads.setdefault(doc_id, set()).add((len(raw), M.pad(raw)))
    for r in got:
        raw = next(p for n, p in payloads[r.doc_id] if hashlib.sha256(p).hexdigest() == r.payload_sha256 and n == r.n_bytes)
        assert (r.payload_bytes, r.tail_crc32, r.feature, r.digest) == (len(raw), zlib.crc32(raw[-64:]), M.feature(raw), r.payload_sha256)
        assert (r.width, r.width * r.height, r.bit_depth) == (64, len(raw), 8)
        media = M.encode_image(raw)
        assert (r.media_bytes, r.media_sha256, r.length) == (len(media), hashlib.sha256(media).hexdigest(), len(media))
    place = {(r.digest, r.shard, r.offset, r.length) for r in got}
    assert len(place) == len({r.digest for r in got})


@pytest.mark.parametrize("few", [0, 4096])
def test_null_ids_repeated_rows_and_hot_digests(spark, monkeypatch, few):
    from collections import Counter

    monkeypatch.setattr(common, "FEW", few)
    monkeypatch.setattr(common, "HOT_KEYS", 4 if not few else 1 << 16)
    table = [(None, None), (None, ""), (None, "a"), (7, "a"), (7, "a"), *((i, "copied") for i in range(40)), (8, "x" * 5_000_000)]
    stored, root = M.store_media(spark.createDataFrame(table, "doc_id long, text string").repartition(3))
    got = M.media_columns(stored, root).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256) for r in got) == Counter((i, len(t or ""), hashlib.sha256(M.pad((t or "").encode())).hexdigest()) for i, t in table)
    assert len({(r.digest, r.shard, r.offset) for r in got}) == 4


def test_headers_alone(spark):
    stored, root = M.store_media(documents(spark))
    got = M.header_columns(stored, root).collect()
    assert all(r.height == (max(r.n_bytes, 1) + 63) // 64 for r in got)


def test_images_round_trip():
    for n in (1, 63, 64, 65, 5000):
        payload = M.pad(os.urandom(n))
        assert M.decode_image(M.encode_image(payload)) == payload
    with pytest.raises(ValueError):
        M.decode_image(M.encode_image(M.pad(b"x"))[:-20] + b"0" * 20)
    assert len(M.pad(b"")) == 64 and len(M.pad(b"x" * 64)) == 64


def test_shards_are_tar_files(spark):
    import tarfile
    from urllib.parse import urlparse

    stored, root = M.store_media(documents(spark))
    folder = urlparse(root).path
    names = {}
    for shard in os.listdir(folder):
        with tarfile.open(f"{folder}/{shard}") as tar:
            for entry in tar:
                names[(shard, entry.offset_data)] = (entry.name, entry.size)
    for r in stored.collect():
        assert names[(r.shard, r.offset)] == (f"{r.digest}.png", r.length)


def test_empty(spark):
    stored, root = M.store_media(empty(spark))
    assert M.media_columns(stored, root).count() == 0
