import math
import random

import pytest
from pyspark.sql import functions as F

from sparkredact.functions import text as T
from sparkredact.functions.python import edits_within, sound_code
from sparkredact.functions.register import register
from sparkredact.plans import exact


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in rows.select("i", expression.alias("v")).orderBy("i").select("v").collect()]


def test_dates(spark):
    good = ["31/12/2025", "12/31/2025", "01-15-99", "2/4/16"]
    bad = ["99/99/2024", "13/40/2025", "1/1/1800", "1/1/2100", "1/2/300", "1/2/3", "x", ""]
    assert column(spark, good + bad, T.plausible_date("s")) == [True] * 4 + [False] * 8
    assert column(spark, ["311299", "991231", "600002", "20240131", "31012024", "99999999", "123"], T.plausible_numeric_date("s")) == [True, True, False, True, True, False, False]


def test_phones_and_cards(spark):
    good = ["+1-202-555-0173", "+44 7700 900123", "(555) 123-4567", "555-123-4567"]
    bad = ["123456", "1234567890123456", "1.2.3.4.5", "10.23.456", "020 1234 5678"]
    assert column(spark, good + bad, T.plausible_phone("s")) == [True] * 4 + [False] * 5
    assert column(spark, ["4111 1111 1111 1111", "4111111111111112", "411", ""], T.luhn("s")) == [True, False, False, False]


@pytest.mark.parametrize("token", ["sk_live_abc123XYZ789", "eyJhbGciOiJIUzI1NiJ9", "REF2024_ABX9K001", "a3f2b8c9d1e4f5a6", "xK9mP2qL5rT8wN3v"])
def test_secrets(spark, token):
    assert column(spark, [token], T.secret_like("s")) == [True] and exact.is_secret(token)


def test_no_secrets(spark):
    tokens = ["passwordpassword", "1234567890", "snake_case_name", "kebab-case-name", "abc1234", "aaaa1111bbbb", ""]
    assert column(spark, tokens, T.secret_like("s")) == [False] * 7


def test_entropy_equals_the_formula(spark):
    rng = random.Random(3)
    values = ["", "a", *("".join(rng.choice("abcdeXYZ019_-é") for _ in range(rng.randint(1, 30))) for _ in range(60))]
    want = [-sum((p := v.count(c) / len(v)) * math.log2(p) for c in set(v)) for v in values]
    assert column(spark, values, T.shannon_entropy("s")) == pytest.approx(want)


def test_keys(spark):
    variants = ["Jane O'Connor-Smith", "jane oconnor smith", "JANE  O’Connor-Smith ", " Jane-OConnor Smith"]
    assert set(column(spark, variants, T.normalize_key("s"))) == {"jane oconnor smith"} == {exact.key_of(v) for v in variants}
    assert column(spark, ["a.b@c.org"], T.normalize_key("s")) == ["a.b@c.org"]


def test_safe_replace_equals_the_interpreter(spark):
    rng = random.Random(8)
    parts = ["Jane", "Janet", "[Jane]", "[", "]", " ", "é", "x+y", "\n", ".", "Smith", r"\E", "$1"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 9))), rng.choice(["Jane", "x+y", "Smith", "é", "Jane Smith", "$1"]), rng.choice(["[NAME 1]", r"[$1 \2]"])) for _ in range(300)]
    got = spark.createDataFrame(rows, "t string, a string, b string").select(T.safe_replace("t", "a", "b")).collect()
    assert [r[0] for r in got] == [exact.put_tag(t, a, b) for t, a, b in rows]


@pytest.mark.parametrize(("word", "code"), [
    ("smith", "SM0"), ("smyth", "SM0"), ("phone", "FN"), ("city", "ST"), ("center", "SNTR"), ("cat", "KT"), ("cream", "KRM"), ("ghost", "KHST"), ("thomas", "0MS"),
    ("the", "0"), ("william", "WLM"), ("knight", "NT"), ("wreck", "RK"), ("pneumonia", "NMN"), ("", ""), (None, ""),
])
def test_sounds(word, code):
    assert sound_code(word) == code


def test_words_that_sound_alike():
    for a, b in (("catherine", "katherine"), ("johnson", "jonson"), ("philip", "phillip"), ("steven", "stephen")):
        assert sound_code(a) == sound_code(b)


def test_edits_equal_another_engine():
    import duckdb

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(0, 7)))
    pairs = [(word(), word()) for _ in range(600)] + [("ca", "abc"), ("johnson", "jonhson")]
    distances = duckdb.sql("SELECT " + ", ".join(f"damerau_levenshtein('{a}', '{b}')" for a, b in pairs)).fetchall()[0]
    assert all(edits_within(a, b, k) == min(d, k + 1) for (a, b), d in zip(pairs, distances) for k in (1, 2, 3))


def test_small_functions(spark):
    assert column(spark, ["Oak Lane", "Gonzalezland", "Jane Smith", ""], T.looks_like_address("s")) == [True, True, False, False]
    assert column(spark, ["O'Connor", "x"], T.name_variations(F.lit("James"), "s")) == [["james.oconnor", "oconnor.james", "j.oconnor", "james.o", "jamesoconnor", "joconnor"], ["james.x", "x.james", "james.x", "jamesx"]]
    assert column(spark, ["a\nb\r\nc\rd\n", "", "\n", "x"], T.lines("s")) == [["a", "b", "c", "d"], [], [""], ["x"]]
    assert column(spark, ["Hi. You! a"], T.sentences("s")) == [["Hi.", "You!", "a"]]
    assert column(spark, ["kings", "complied", "consulting", "cat"], F.array_contains(T.common_stems("s"), F.lit("consult"))) == [False, False, True, False]
    vectors = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in vectors.select(T.cosine("a", "b")).collect()] == [1.0, 0.0, 0.0]


def test_sql_names(spark):
    assert "sound_code" in register(spark)
    row = spark.sql("SELECT normalize_key('Jane-O''Neil') AS k, passes_luhn('4111 1111 1111 1111') AS c, sound_code('smith') AS s, edits_within('ab', 'ba', 2) AS e, f_beta(0.5D, 0.5D, 5D) AS f").first()
    assert tuple(row) == ("jane oneil", True, "SM0", 1, 0.5)
