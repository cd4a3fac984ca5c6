import random
from collections import Counter

import corpus_pipeline
from sparkredact.llm import queries


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(500)]
    rows = []
    for i in range(240):
        text = [rng.choice(words) for _ in range(60)]
        if i % 6 == 0:
            for _ in range(4):
                text.insert(rng.randrange(60), rng.choice(["zorgul", "brakk"]))
        rows.append((i, " ".join(text), "en", "a" if i % 3 else "b", 0))
    rows += [(300, rows[1][1].replace(" ", " \n ", 1), "en", "a", 0), (301, rows[1][1] + " tail", "en", "b", 0), (302, None, None, None, None), (303, "", "en", "c", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == before.columns
        kept.append({r.doc_id for r in docs.collect()})
    toxic, exact, near, mixed, packed = kept
    clean = {i for i in range(240) if i % 6}
    assert len(clean - toxic) <= 2 and len({i for i in range(240) if i % 6 == 0} & toxic) <= 2
    assert 300 in toxic and exact == toxic - {300} - ({303} if 302 in toxic else set())
    assert near == exact - {301} and mixed == near == packed
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == packed


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeated_rows_and_null_ids(spark, tmp_path):
    """One of equal rows goes on, and clashing columns come through as they are."""
    text = "one two three four five six seven eight"
    rows = [(1, text, "x"), (1, text, "x"), (None, text, "y"), (2, text + " nine", "z"), (3, None, "n"), (3, None, "n"), (None, "other words", "o"), (None, "other words", "o"), (4, " ", "s"), (5, "other  words", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tk string").repartition(3)
    exact = corpus_pipeline.drop_copies(spark, docs, "")
    assert exact.columns == docs.columns
    assert Counter(tuple(r) for r in exact.collect()) == Counter([(1, text, "x"), (2, text + " nine", "z"), (3, None, "n"), (4, " ", "s"), (5, "other  words", "p")])
    near = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert Counter(tuple(r) for r in near.collect()) == Counter([(1, text, "x"), (3, None, "n"), (3, None, "n"), (4, " ", "s"), (5, "other  words", "p")])


def test_names():
    assert [n for n in queries.QUERIES] == sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.ORACLE) <= set(queries.QUERIES)
