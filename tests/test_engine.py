import csv
import hashlib
import io
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkredact.functions import vocabulary as V
from sparkredact.operators import columns, detect, lookup, models, replay, segments, similarity
from sparkredact.options import Options
from sparkredact.plans import catalog, exact
from sparkredact.plans.engine import Engine
from sparkredact.plans.session import Session, clean_up, sessions
from sparkredact.sources import files
from sparkredact.streaming.stream import CarriedLookup, redact_stream

LETTER = "Dr Jane Smith of Acme Widgets Ltd wrote to jane.smith@acme.org.\nCall +44 7700 900123 from 10.0.0.1 on 31/12/1980.\nJANE SMITH lives at SW1A 1AA, card 4111 1111 1111 1111, key sk_live_abc123XYZ789.\nSee [Jane 2019] and https://a.example/x"


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values, 1)], "doc_id long, text string")


def redacted(result, doc="1"):
    rows = result.redacted.filter(F.col("doc_id") == doc).orderBy("line_number", "sub_index").select(segments.line_text()).collect()
    return "\n".join(r[0] for r in rows)


def test_letter(spark):
    out = redacted(Engine(spark).anonymize_texts(texts(spark, LETTER)))
    for secret in ("jane.smith@acme.org", "7700", "10.0.0.1", "31/12/1980", "Jane Smith", "Acme Widgets", "4111", "sk_live", "a.example", "SW1A"):
        assert secret not in out
    assert "[Jane 2019]" in out and "[EMAIL 1]" in out and "Dr [NAME 1] of [ORG 1] wrote" in out


def test_forms(spark):
    docs = texts(spark, "Mr Jane Smith met Mrs Jane-Smith")
    assert redacted(Engine(spark).anonymize_texts(docs)) == "Mr [NAME 1] met Mrs [NAME 1]"
    assert redacted(Engine(spark, Options(replay="first_form")).anonymize_texts(docs)) == "Mr [NAME 1] met Mrs [NAME 1]-[NAME 1]"


def test_modes_number_tags(spark):
    docs = texts(spark, "a@x.org b@x.org", "b@x.org c@x.org")
    tags = lambda mode: {(r.scope, r.original_term): r.anonymised_term for r in Engine(spark, Options(lookup_mode=mode)).anonymize_texts(docs).lookup.collect()}
    assert tags("per_file") == {("1", "a@x.org"): "[EMAIL 1]", ("1", "b@x.org"): "[EMAIL 2]", ("2", "b@x.org"): "[EMAIL 1]", ("2", "c@x.org"): "[EMAIL 2]"}
    assert tags("persist") == {("all", "a@x.org"): "[EMAIL 1]", ("all", "b@x.org"): "[EMAIL 2]", ("all", "c@x.org"): "[EMAIL 3]"}


def test_disabled_categories_keep_their_numbers(spark):
    result = Engine(spark, Options(enabled_categories=("IP",))).anonymize_texts(texts(spark, "a@x.org at 10.0.0.1"))
    assert redacted(result) == "a@x.org at [IP 1]"


def test_exact_mode_equals_sets_where_nothing_overlaps(spark):
    docs = texts(spark, LETTER, "plain", "", "Mr Li Bo and Mrs Anna Lee-Jones", "a@x.org\n\nb@x.org 555-123-4567")
    both = {}
    for r in exact.redact_exactly(docs).collect():
        both[r.doc_id] = {e["norm_key"]: e["anonymised_term"] for e in r.lookup}
    engine = Engine(spark)
    engine.stages = lambda: iter([detect.emails, detect.organisations, detect.titled_names, detect.structured, detect.secrets])
    found = lookup.assign_tags(engine.detect(segments.segments_of_texts(docs)))
    sets = {d: {} for d in both}
    for r in found.collect():
        sets[r.scope][r.norm_key] = r.anonymised_term
    assert sets == both


def test_exact_mode_masks_later_lines(spark):
    row = exact.redact_exactly(texts(spark, "+44 7700 900123\n+44 7700 900123 15")).first()
    assert row.redacted == "[PHONE 1]\n[PHONE 1] 15"


def test_columns(spark):
    rows = spark.createDataFrame([(1, "Jane", "Smith", "London", "Jane said jane.smith"), (2, "Ann", "Lee", "", "Ann"), (3, "Jane", "Doe", "[X 1]", None)], "i long, a string, b string, c string, d string")
    table = segments.segments_of_rows(rows, "people", "i", ["a", "b", "c", "d"])
    mapping = {0: "NAME", 1: "NAME", 2: "LOCATION", 3: "Freetext"}
    found = lookup.assign_tags(columns.mapped_columns(table, mapping))
    tags = {r.original_term: r.anonymised_term for r in found.collect()}
    assert tags["Jane Smith"] == tags["Jane"] == tags["Smith"] == tags["jane.smith"] == "[NAME 1]" and tags["Jane Doe"] == tags["Doe"] == "[NAME 3]"
    assert tags["London"] == "[LOCATION 1]" and "[X 1]" not in tags and "a" not in tags
    assert columns.name_groups({0: "Skip", 1: "NAME", 2: "NAME", 3: "EMAIL", 5: "NAME"}) == [[1, 2], [5]]
    result = Engine(spark, Options(column_mapping=mapping)).anonymize(table)
    assert redacted(result, "people").splitlines()[1] == "[NAME 1] | [NAME 1] | [LOCATION 1] | [NAME 1] said [NAME 1]"


def test_dictionary_names(spark):
    docs = texts(spark, "Okafor came. Grace Okafor too. Grace alone, The Park, Rose Park. Doctor Smith-Jones, [Okafor]")
    found = [r.original for r in detect.dictionary_names(segments.segments_of_texts(docs)).orderBy("ord").collect()]
    assert found == ["Okafor", "Grace", "Okafor", "Smith-Jones"]


def test_custom_lists(spark):
    lists = [{"category": "LOCATION", "words": ["New York", "New York City", " "]}, {"category": "", "words": ["x"]}]
    found = detect.custom_words(segments.segments_of_texts(texts(spark, "in NEW YORK CITY, New York and Newyork [New York]")), lists)
    assert [r.original for r in found.orderBy("ord").collect()] == ["NEW YORK CITY", "New York"]
    assert detect.custom_words(segments.segments_of_texts(texts(spark, "x")), []).count() == 0


@pytest.mark.parametrize(("text", "most"), [("First sentence. " * 40, 200), ("a" * 600, 200), ("word " * 200, 100), ("", 10)])
def test_long_lines(spark, text, most):
    rows = segments.segments_of_texts(texts(spark, text))
    parts = segments.split_long_lines(rows, most)
    assert all(len(r[0]) <= most for r in parts.select(segments.line_text()).collect())
    whole = segments.reunify_sublines(parts)
    assert whole.count() == rows.count()


def test_all_lines_are_reunified(spark, tmp_path):
    rng = random.Random(6)
    line = lambda n: " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", "!"]) for _ in range(n))
    docs = [(i, "\n".join([line(rng.randint(0, 400)) for _ in range(4)] + ["x" * rng.randint(490, 1200)])) for i in range(12)] + [(12, None), (13, ""), (14, "short")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want, counts = set(), {}
    for i, text in docs:
        for n, whole in enumerate((text or "").splitlines(), 1):
            cells = segments.cut(whole, 500) if len(whole) > 500 else [whole]
            assert "".join("".join(cells).split()) == "".join(whole.split())
            want.add((str(i), n, hashlib.md5("".join(whole.split()).encode()).hexdigest()))
            counts[str(i), n] = len(cells)
    got = [tuple(r) for r in catalog.QUERIES["reunify_sublines"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want and max(counts.values()) > 3
    whole = segments.reunify_sublines(segments.split_long_lines(segments.segments_of_texts(spark.read.parquet(f"{tmp_path}/documents.parquet")), 500))
    assert {(r.doc_id, r.line_number): len(r.cells) for r in whole.collect()} == counts


def test_structured_patterns_reach_documents(spark, tmp_path):
    """A table with the letter that SQL has checked gives the letter's terms, and the other rows theirs."""
    letter = catalog.values(spark, catalog.LETTER, "doc_id, text")
    more = spark.createDataFrame([(8, "10.0.0.9\n10.0.0.9 and +44 7700 900123"), (9, None), (10, "")], "doc_id int, text string")
    letter.union(more).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["detect_structured_documents"](spark, str(tmp_path)).collect())
    want = [tuple(r) for r in catalog.QUERIES["detect_structured_all"](spark, str(tmp_path)).collect()]
    assert len(want) > 10 and got == sorted([*want, ("8", "IP", "10.0.0.9"), ("8", "IP", "10.0.0.9"), ("8", "PHONE", "+44 7700 900123")])


def test_providers(spark):
    docs = texts(spark, "Anna Salai met Jane Smith, then Oak Lane", "Anna Salai met Jane Smith, then Oak Lane", "")
    found = models.ner(segments.segments_of_texts(docs))
    assert {(r.original, r.category) for r in found.collect()} == {("Anna Salai", "LOCATION"), ("Jane Smith", "NAME"), ("Oak Lane", "LOCATION")}

    def broken(frames):
        for frame in frames:
            if frame["line"].str.contains("boom").any():
                raise RuntimeError
            yield from models.title_case_provider(iter([frame]))

    terms, failed = models.encoder(segments.segments_of_texts(texts(spark, "Jane Smith", "boom")), broken)
    assert [r.original for r in terms.collect()] == ["Jane Smith"] and [tuple(r) for r in failed.collect()] == [("2", 1)]

    def tagger(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame([(line, 0, 4, "PROPN/nsubj", 1.0) for line in frame["line"]] + [(line, 5, 10, "PROPN/dobj", 1.0) for line in frame["line"]], columns=["line", "start", "stop", "type", "score"])

    assert [r.original for r in models.proper_nouns(segments.segments_of_texts(texts(spark, "Kofi Annan spoke")), tagger).collect()] == ["Kofi Annan"]


def test_aliases_by_likeness(spark):
    found = detect.titled_names(segments.segments_of_texts(texts(spark, "Mr Johnson of Manchester, Mrs Katherine Lee")))
    table = lookup.assign_tags(found)
    words = spark.createDataFrame([(w,) for w in ["Johnsen", "Jonhson", "Jackson", "Catherine", "Lea", "Johnson"]], "word string")
    none = spark.createDataFrame([], "part string")
    got = {r.word: (r.target, r.by) for r in similarity.fuzzy_aliases(words, table, none).collect()}
    assert got == {"Johnsen": ("johnson", "edits"), "Jonhson": ("johnson", "edits"), "Catherine": ("katherine", "edits")}
    result = Engine(spark, Options(fuzzy_matching=True)).anonymize_texts(texts(spark, "Mr Johnson met Jonhson"))
    assert redacted(result) == "Mr [NAME 1] met [NAME 1]"


def test_layers_can_be_left_out(spark):
    docs = texts(spark, "Mr Kofi Annan, kofi@x.org, 10.0.0.1")
    assert redacted(Engine(spark, Options(layers=("email",))).anonymize_texts(docs)) == "Mr Kofi Annan, [EMAIL 1], 10.0.0.1"
    alone = Engine(spark, Options(layers=("encoder",)), ner=models.title_case_provider, encoder=models.title_case_provider).anonymize_texts(docs)
    assert {r.layer for r in alone.detections.collect()} <= {"encoder"}


def test_other_suffixes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.odd").write_text("two")
    with pytest.raises(ValueError):
        files.read_files(spark, f"{tmp_path}/*")
    assert [r.source_file for r in files.read_files(spark, f"{tmp_path}/*", others="skip").collect()] == ["a.txt"]


def test_aliases_by_vectors(spark):
    """A word that is neither spelt nor said like a name, but used like it."""
    vectors = spark.createDataFrame([("johnson", [1.0, 0.1]), ("walker", [1.0, 0.12]), ("river", [0.0, 1.0])], "word string, vector array<double>")
    docs = texts(spark, "Mr Johnson met Walker by the River")
    options = Options(fuzzy_matching=True)
    assert redacted(Engine(spark, options).anonymize_texts(docs)) == "Mr [NAME 1] met Walker by the River"
    assert redacted(Engine(spark, options, vectors=vectors).anonymize_texts(docs)) == "Mr [NAME 1] met [NAME 1] by the River"


def test_names_of_columns_are_masked_in_other_columns(spark):
    """Later stages don't see a name's word in a column that isn't mapped, and only in its own document."""
    rows = spark.createDataFrame([(1, "Kofi", "met Kofi, MR SMITH Ltd")], "i int, name string, note string")
    segs = segments.segments_of_rows(rows.withColumn("i", F.col("i") + 0), "a", "i", ["name", "note"])
    engine = Engine(spark, Options(column_mapping={0: "NAME", 1: "Freetext"}))
    found = engine.detect(segs)
    table = lookup.assign_tags(found)
    other = table.withColumn("scope", F.lit("b"))
    assert "[NAME 1]" in columns.cross_reference(segs, table, {0: "NAME", 1: "Freetext"}, 2).collect()[-1].cells[1].text
    assert columns.cross_reference(segs, other, {0: "NAME", 1: "Freetext"}, 2).collect()[-1].cells[1].text == "met Kofi, MR SMITH Ltd"
    assert "[NAME 1]" in columns.cross_reference(segs, other, {0: "NAME", 1: "Freetext"}, 2, "persist").collect()[-1].cells[1].text


def test_persist_numbers_in_ranges_and_tries_only_forms_that_may_stand(spark):
    docs = spark.createDataFrame([(i, f"mail a{i % 7}@x.org and a{i}@y.org, x+y") for i in range(60)], "doc_id long, text string").repartition(5)
    segs = segments.segments_of_texts(docs)
    found = detect.emails(segs).withColumn("no", F.col("doc_id").cast("long"))
    got = {r.original_term: r.anonymised_term for r in lookup.assign_tags(found, "persist", "no").collect()}
    want = {}
    for i in range(60):
        for term in (f"a{i % 7}@x.org", f"a{i}@y.org"):
            want.setdefault(term, f"[EMAIL {len(want) + 1}]")
    assert got == want
    forms = spark.createDataFrame([("all", "a3@x.org", "[EMAIL 9]"), ("all", "x+y", "[ID 1]"), ("all", "+", "[ID 2]"), ("all", "zzz", "[ID 3]")], "scope string, form string, tag string")
    near = replay.forms_of_documents(segs, forms)
    assert {r.form for r in near.filter("scope = '3'").collect()} >= {"a3@x.org", "x+y", "+"} and near.filter("form = 'zzz'").isEmpty()
    lines = {r.doc_id: r.cells[0].text for r in replay.redact_segments(segs, forms, "persist").collect()}
    assert lines["3"] == "mail [EMAIL 9] and a3@y.org, [ID 1]" and lines["4"] == "mail a4@x.org and a4@y.org, [ID 1]"


def test_the_exact_mode_agrees_with_the_engine(spark):
    """Where no match on one line hides text on another, both give the same lookup and text."""
    docs = spark.createDataFrame([(1, "Mail jane@x.org\nor call 555-123-4567 now"), (2, "host 10.0.0.1\nMr Kofi Annan, again Kofi Annan"), (3, "token abcDEF123456789xyz stays secret"), (4, None)], "doc_id long, text string")
    read = {r.doc_id: (r.redacted, sorted((x.original_term, x.anonymised_term) for x in r.lookup)) for r in exact.redact_exactly(docs).collect()}
    result = Engine(spark, Options(replay="first_form")).anonymize_texts(docs)
    tags = result.lookup.groupBy("scope").agg(F.collect_list(F.struct("original_term", "anonymised_term")).alias("t")).collect()
    for r in tags:
        assert sorted((x.original_term, x.anonymised_term) for x in r.t) == read[r.scope][1]
    whole = result.redacted.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_number", F.col("cells")[0]["text"].alias("t")))).alias("l")).collect()
    assert {r.doc_id: "\n".join(x.t for x in r.l) for r in whole} == {k: v[0] for k, v in read.items() if k != "4"}


def cosine(a, b):
    sizes = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / sizes if sizes else 0.0


@pytest.mark.parametrize(("block", "most_bytes"), [(1024, 32 << 20), (7, 32 << 20), (7, 0)])
def test_all_vectors_meet(spark, monkeypatch, tmp_path, block, most_bytes):
    """Whole table against brute force: ids of ten and more as targets, none its own, ties to the first, nulls and zeros."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", most_bytes)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    rows += [(60, rows[40][1]), (61, rows[40][1]), (62, [0.0] * 6), (63, None), (64, [-x for x in rows[0][1]])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    best = {}
    for i, v in rows:
        near = [(cosine(v, w), -j) for j, w in rows if j != i and v and w]
        if near and max(near)[0] >= 0.3:
            best[i] = (-max(near)[1], round(max(near)[0], 4))
    known = frame.selectExpr("vec_id AS target_id", "vec_id AS place", "embedding AS vector")
    all_of = similarity.vector_matches(frame.selectExpr("vec_id AS id", "embedding AS vector"), known, 0.3, others=True).collect()
    assert {r.id: (r.target_id, round(r.similarity, 4)) for r in all_of} == best and any(j >= 10 for j, _ in best.values())
    asked = {r.vec_id: (r.best_id, r.similarity) for r in catalog.QUERIES["embed_match"](spark, str(tmp_path)).collect()}
    assert asked == {i: b for i, b in best.items() if i % 20 == 0} and 40 in asked and asked[60][0] == 40
    own = similarity.vector_matches(frame.selectExpr("vec_id AS id", "embedding AS vector"), known, 0.9).collect()
    assert {(r.id, r.target_id) for r in own} == {(i, 40 if i in (60, 61) else i) for i, v in rows if v and any(v)}


def test_words_meet_targets_that_sound_alike(spark, tmp_path):
    from sparkredact.functions.python import sound_code

    docs = [(1, "Smyth fone kat  Steven\nstephenson 1234 Katherine"), (2, "Smith smythereenes Jonson"), (3, None)]
    names = ["smith stephen", "Catherine johnson", "jonsen smooth the"]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, n) for i, n in enumerate(names)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    targets = sorted({w.lower() for n in names for w in n.split() if len(w) >= 4})
    want = {}
    for word in {w for _, t in docs for w in (t or "").split() if len(w) >= 4}:
        alike = [t for t in targets if sound_code(word.lower()) == sound_code(t) != "" and abs(len(word) - len(t)) <= 3]
        if alike:
            want[word] = alike[0]
    got = [tuple(r) for r in catalog.QUERIES["fuzzy_phonetic_match"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) > 3 and dict(got) == want


def test_false_positives_go(spark):
    rows = [("the", "NAME"), ("N/A", "ID"), ("123", "NAME"), ("123", "ID"), ("x", "ORG"), ("Plaintiff", "NAME"), ("Plaintiff", "ORG")]
    kept, gone = lookup.validate(spark.createDataFrame(rows, "original_term string, pii_category string"))
    assert {tuple(r) for r in kept.collect()} == {("123", "ID"), ("Plaintiff", "ORG")} and gone.count() == 5


def test_files_round_trip(spark, tmp_path):
    cells = lambda *t, sheet=None: [{"text": x, "sheet_name": sheet} for x in t]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"one jane@x.org\r\ntwo\n")
    (tmp_path / "in/b.csv").write_text('Name,Email\n"Jane\nSmith",jane@x.org\nragged\n', newline="")
    (tmp_path / "in/c.xlsx").write_bytes(files.render_xlsx([cells("Name", "N", sheet="S1"), cells("Jane & <Smith>", "1", sheet="S1"), cells("z", "", sheet="S2")]))
    (tmp_path / "in/d.docx").write_bytes(files.render_docx([cells("para 1"), cells("b@y.org")]))
    rows = files.read_files(spark, f"{tmp_path}/in/*")
    got = {(r.source_file, r.line_number): [(c.text, c.sheet_name) for c in r.cells] for r in rows.collect()}
    assert got[("a.txt", 1)] == [("one jane@x.org", None)] and ("a.txt", 3) not in got
    assert got[("b.csv", 2)] == [("Jane\nSmith", None), ("jane@x.org", None)] and got[("b.csv", 3)] == [("ragged", None)]
    assert got[("c.xlsx", 2)] == [("Jane & <Smith>", "S1"), ("1", "S1")] and got[("c.xlsx", 3)][0] == ("z", "S2")
    assert got[("d.docx", 2)] == [("b@y.org", None)]
    Engine(spark, Options(output_format="preserve_format")).anonymize_files(f"{tmp_path}/in/*", f"file://{tmp_path}/out")
    assert (tmp_path / "out/a_anon.txt").read_text() == "one [EMAIL 1]\ntwo\n"
    assert list(csv.reader(io.StringIO((tmp_path / "out/b_anon.csv").read_text()))) [1][1] == "[EMAIL 1]"
    assert files.parse_docx((tmp_path / "out/d_anon.docx").read_bytes())[1][2] == ["[EMAIL 1]"]
    assert files.parse_xlsx((tmp_path / "out/c_anon.xlsx").read_bytes())[1][2][0] == "[NAME 1] & <[NAME 2]>"
    assert len(list((tmp_path / "out/lookup").glob("*.csv"))) == 1
    (tmp_path / "in/e.pdf").write_bytes(b"x")
    with pytest.raises(ValueError, match="Unsupported file format"):
        files.read_files(spark, f"{tmp_path}/in/*")
    with pytest.raises(ValueError):
        files.parse_xlsx(b"\xd0\xcf\x11\xe0")


def test_small_sources(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"lists": [{"name": "a", "category": "ORG", "words": ["x"]}]}')
    assert files.read_custom_lists(spark, f"{tmp_path}/l.json")[0]["words"] == ["x"]
    assert files.read_custom_lists(spark, f"{tmp_path}/none.json") == []
    (tmp_path / "bad.json").write_text("{nope")
    assert files.read_custom_lists(spark, f"{tmp_path}/bad.json") == []
    (tmp_path / "words.txt").write_text("Jane\n\nJANE\nbob\n")
    assert sorted(r[0] for r in files.read_dictionary(spark, f"{tmp_path}/words.txt").collect()) == ["bob", "jane"]
    assert files.read_dictionary(spark, f"{tmp_path}/none.txt").count() == 0
    rows = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "i long, Name string, Email string")
    shown = {r.header: (r.category, r.samples) for r in files.preview(segments.segments_of_rows(rows, "t", "i", ["Name", "Email"])).collect()}
    assert shown == {"Name": ("NAME", ["a", "c"]), "Email": ("EMAIL", ["b", "d"])}


def test_stream_equals_batch(spark, tmp_path):
    docs = texts(spark, "a@x.org", "b@x.org a@x.org", "c@x.org", "A@x.org d@x.org")
    for batch in (docs.filter("doc_id <= 2"), docs.filter("doc_id > 2")):
        batch.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = redact_stream(stream, detect.emails, f"{tmp_path}/lookup", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    run.processAllAvailable()
    run.stop()
    got = {r.doc_id: r.redacted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    kept = CarriedLookup(spark, f"{tmp_path}/lookup").all()
    assert kept.count() == 4 and kept.select("anonymised_term").distinct().count() == 4
    tag = {r.original_term: r.anonymised_term for r in kept.collect()}
    assert got[2] == f"{tag['b@x.org']} {tag['a@x.org']}" and got[4].startswith(tag["a@x.org"])


def test_sessions(spark, tmp_path):
    run = Session(spark, f"file://{tmp_path}/s", "one")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, x int")
    assert run.pending(rows).count() == 2 and run.restore() is None
    run.finish(rows.filter("x = 1"))
    assert [r.doc_id for r in run.pending(rows).collect()] == ["b"]
    run.snapshot(lookup.assign_tags(detect.emails(segments.segments_of_texts(texts(spark, "a@x.org")))))
    assert run.restore().count() == 1
    assert [n for n, _ in sessions(spark, f"file://{tmp_path}/s")] == ["one"]
    assert clean_up(spark, f"file://{tmp_path}/s", -1) == ["one"] and sessions(spark, f"file://{tmp_path}/s") == []


def test_replay_is_idempotent(spark):
    docs = texts(spark, LETTER)
    found = detect.emails(segments.segments_of_texts(docs))
    forms = lookup.forms(found, lookup.assign_tags(found))
    once = replay.redact_texts(docs, forms).select("doc_id", F.col("redacted").alias("text"))
    assert once.first().text == replay.redact_texts(once, forms).first().redacted


def test_vocabulary():
    assert len(V.STRUCTURED) == 15 and len(V.CATEGORIES) == 11 and len(set(V.ENCODER_LABELS.values())) <= 11
