from collections import Counter

import pytest

from sparkredact.llm.common import Workspace
from sparkredact.llm.sharding import LEVEL, SHARD, Store, compacted

from .fixtures import documents, empty, rows


def test_rows_survive_compaction(spark):
    store = compacted(documents(spark), splits=6, target=40_000, fanout=4, lowest=200)
    got = store.read()
    assert Counter((r.doc_id, r.text, r.source) for r in got.collect()) == Counter((r[0], r[1], r[2]) for r in rows())
    assert got.select(SHARD).distinct().count() < 18 and got.agg({LEVEL: "max"}).first()[0] >= 1
    assert all(len(run) < 4 for run in [store.runs(store.shards())])


def test_versions_are_atomic(spark):
    store = Store(spark, Workspace(spark, "test").path("store"))
    store.append(documents(spark), 1)
    first = store.shards()
    assert store.version() == 1 and len(first) == 3
    store.append(documents(spark), 1)
    assert store.version() == 2 and len(store.shards()) == 6 and store.shards(1) == first
    with pytest.raises(RuntimeError):
        store.commit(1, first)
    assert store.version() == 2


def test_of_two_writers_of_a_version_one_fails(spark):
    from concurrent.futures import ThreadPoolExecutor

    store = Store(spark, Workspace(spark, "test").path("store"))
    store.append(documents(spark), 1)
    for _ in range(5):
        base, shards = store.version(), store.shards()

        def write(shards=shards, base=base):
            try:
                return store.commit(base, shards)
            except RuntimeError:
                return None

        with ThreadPoolExecutor(4) as pool:
            won = [f.result() for f in [pool.submit(write) for _ in range(4)]]
        assert won.count(base + 1) == 1 and won.count(None) == 3 and store.version() == base + 1


def test_runs_are_merged_side_by_side_and_the_version_before_stays(spark, monkeypatch):
    store = Store(spark, Workspace(spark, "test").path("store"), target=2000, fanout=2, lowest=200)
    store.append(documents(spark).repartition(12), 2)
    runs, parts = store.runs(store.shards()), []
    write = Store._write
    monkeypatch.setattr(Store, "_write", lambda self, rows, *rest: parts.append(rows.rdd.getNumPartitions()) or write(self, rows, *rest))
    planned = store.read()
    assert len(runs) > 1 and store.compact() == 2 and parts == [len(runs)]
    assert planned.count() == store.read().count() == store.read(1).count() == len(rows())


def test_shards_hold_what_the_manifest_says(spark):
    store = compacted(documents(spark), splits=6, target=40_000, fanout=4, lowest=200)
    got = {}
    for r in store.read().collect():
        n, size, level = got.get(r[SHARD], (0, 0, r[LEVEL]))
        assert level == r[LEVEL]
        got[r[SHARD]] = n + 1, size + len((r.text or "").encode()), level
    assert got == {s.name: (s.n_rows, s.n_bytes, s.level) for s in store.shards()}


def test_tiers(spark):
    store = Store(spark, Workspace(spark, "test").path("store"), target=1000, fanout=4, lowest=10)
    from sparkredact.llm.sharding import Shard

    tiny = [Shard(f"t{i}", 5, 1, 0) for i in range(3)]
    assert store.runs(tiny) == []
    assert store.runs([*tiny, Shard("t3", 7, 1, 0)])[0] == [*tiny, Shard("t3", 7, 1, 0)]
    assert store.runs([Shard(f"b{i}", 900, 1, 0) for i in range(9)]) == []


def test_empty_and_clashes(spark):
    assert compacted(empty(spark)).read() is None
    with pytest.raises(ValueError):
        compacted(documents(spark).withColumnRenamed("source", SHARD))
