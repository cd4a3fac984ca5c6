import hashlib
import re
from collections import Counter, defaultdict

from sparkredact.llm.exact_dedup import exact_dedup, radix_groups

from .fixtures import documents, empty, rows


def test_equals_brute_force(spark):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows():
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(doc_id)
    want = Counter((d, min(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids)
    got = exact_dedup(documents(spark)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert all(sum(r.kept for r in got if r.keep_id == min(ids)) >= 1 for ids in groups.values())
    assert sum(r.kept for r in got) == len(groups)


def test_long_common_beginnings_and_nulls(spark):
    long_a, long_b = "a" * 5000 + "x", "a" * 5000 + "y"
    table = [(1, long_a), (2, long_b), (3, long_a), (None, long_b), (None, None), (7, "")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(spark.createDataFrame(table, "doc_id long, text string").repartition(6)).collect()}
    assert got == {(1, 1, 2, True), (3, 1, 2, False), (2, 2, 2, True), (None, 2, 2, False), (7, 7, 2, True), (None, 7, 2, False)}


def test_empty(spark):
    assert exact_dedup(empty(spark)).count() == 0


def test_radix_groups():
    texts = [b"", b"a" * 64, b"a" * 65, b"a" * 64, b"", b"b", b"a" * 65, b"a" * 320]
    assert sorted(map(sorted, radix_groups(texts))) == [[0, 4], [1, 3], [2, 6]]
