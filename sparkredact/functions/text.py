"""Scalar functions and predicates as Column expressions, all of them inside the JVM.

Regular expressions carry ``(?U)`` where letters, digits and word ends are meant in Unicode's sense.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_key(term: ColumnLike) -> Column:
    """The key under which spellings of one term share a tag: lower case, no apostrophes, hyphens and white space as one space."""
    bare = F.regexp_replace(F.lower(col(term)), "['’]", "")
    return F.regexp_replace(F.regexp_replace(F.translate(bare, "-", " "), r"(?U)\s+", " "), r"^ | $", "")


def literal_pattern(term: ColumnLike) -> Column:
    """A regex for the term itself, with word ends where it begins or ends with a word character."""
    t = col(term)
    quoted = F.concat(F.lit(r"\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    end = lambda where: F.when(t.rlike(where), F.lit(r"\b")).otherwise(F.lit(""))
    return F.concat(F.lit("(?U)"), end(r"(?U)^\w"), quoted, end(r"(?U)\w$"))


def outside_brackets(text: ColumnLike, change) -> Column:
    """text with ``change`` applied to what lies outside [...]; a bracket that is never closed protects nothing."""
    pieces = F.regexp_extract_all(col(text), F.lit(r"(?s)\[[^\]]*\]|[^\[]+|\["), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"(?s)^\[[^\]]*\]$"), p).otherwise(change(p))), "")


def safe_replace(text: ColumnLike, term: ColumnLike, tag: ColumnLike) -> Column:
    """Replace a literal term by its tag, case-sensitively, at word ends and outside brackets."""
    to = F.regexp_replace(col(tag), r"([\\$])", r"\\$1")
    return outside_brackets(text, lambda p: F.regexp_replace(p, literal_pattern(term), to))


def replay(text: ColumnLike, entries: ColumnLike) -> Column:
    """safe_replace for each of an array of structs (pattern, tag), in the array's order."""

    def one(done: Column, e: Column) -> Column:
        return outside_brackets(done, lambda p: F.regexp_replace(p, e["pattern"], e["tag"]))

    return F.aggregate(col(entries), col(text), one)


def plausible_date(s: ColumnLike) -> Column:
    """d/m/y with / or -: day and month in either order, year of two digits or from 1900 to 2099."""
    t = col(s)
    part = lambda i: F.try_to_number(F.regexp_extract(t, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2}|\d{4})$", i), F.lit("9999")).cast("int")
    a, b, year = part(1), part(2), F.regexp_extract(t, r"(\d+)$", 1)
    day_month = (a.between(1, 12) & b.between(1, 31)) | (b.between(1, 12) & a.between(1, 31))
    return F.coalesce(t.rlike(r"^\d{1,2}[/-]\d{1,2}[/-](\d{2}|(19|20)\d{2})$") & day_month & (F.length(year) > 0), F.lit(False))


def plausible_numeric_date(s: ColumnLike) -> Column:
    """Six or eight digits that hold a month and a day in one of the usual places."""
    t = col(s)
    pair = lambda at: F.try_to_number(F.substring(t, at, 2), F.lit("99")).cast("int")
    month_day = lambda m, d: pair(m).between(1, 12) & pair(d).between(1, 31)
    six = month_day(3, 5) | month_day(1, 3) | month_day(3, 1)
    eight = month_day(5, 7) | month_day(3, 1) | month_day(1, 3)
    return F.coalesce(F.when(t.rlike(r"^\d{6}$"), six).when(t.rlike(r"^\d{8}$"), eight).otherwise(False), F.lit(False))


def luhn(s: ColumnLike) -> Column:
    digits = F.regexp_replace(col(s), r"\D", "")
    return (F.length(digits) >= 13) & F.call_function("luhn_check", digits)


def plausible_phone(s: ColumnLike) -> Column:
    """7 to 15 digits, no dotted version number, and a mark of a phone number or the grouping 3-3-4."""
    t = col(s)
    digits = F.length(F.regexp_replace(t, r"(?U)\D", ""))
    marked = t.rlike(r"[+()]") | F.contains(F.lower(t), F.lit("x"))
    return digits.between(7, 15) & ~t.rlike(r"^\d{1,3}(\.\d{1,3}){2,}$") & (marked | F.trim(t).rlike(r"^\d{3}-\d{3}-\d{4}$"))


def looks_like_address(s: ColumnLike) -> Column:
    """The first or last word is an address word, or some word ends like a place name."""
    words = F.filter(F.split(F.lower(col(s)), r"(?U)\s+"), lambda w: w != "")
    known = F.array(*map(F.lit, V.ADDRESS_WORDS))
    ends = F.array_contains(known, F.try_element_at(words, F.lit(1))) | F.array_contains(known, F.try_element_at(words, F.lit(-1)))
    return F.coalesce(ends, F.lit(False)) | F.exists(words, lambda w: w.rlike("(?:%s)$" % "|".join(V.PLACE_SUFFIXES)))


def shannon_entropy(s: ColumnLike) -> Column:
    """Bits for each character; 0 for an empty string."""
    t = col(s)
    n = F.length(t)
    share = lambda c: (n - F.length(F.replace(t, c, F.lit("")))) / n
    kinds = F.array_distinct(F.filter(F.split(t, ""), lambda c: c != ""))
    return F.aggregate(kinds, F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def has_mixed_chars(s: ColumnLike) -> Column:
    """At least two of upper case, lower case and digits."""
    kinds = [col(s).rlike(p).cast("int") for p in (r"\p{Lu}", r"\p{Ll}", r"\p{Nd}")]
    return reduce(Column.__add__, kinds) >= 2


def secret_like(token: ColumnLike, min_entropy: float = 3.5, min_length: int = 8) -> Column:
    """A token of mixed characters and high entropy that is no plain word, number, snake_case or kebab-case name."""
    t = col(token)
    plain = t.rlike(r"^\p{L}+$") | t.rlike(r"^\p{Nd}+$") | t.rlike(r"^[a-z]+(?:[_-][a-z]+)+$")
    return (F.length(t) >= min_length) & ~plain & has_mixed_chars(t) & (shannon_entropy(t) >= min_entropy)


def cosine(a: ColumnLike, b: ColumnLike) -> Column:
    """Cosine of two arrays; 0 where one has no length."""
    x, y = col(a), col(b)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda t, e: t + e)
    product = lambda p, q: total(F.zip_with(p, q, lambda i, j: i.cast("double") * j))
    size = F.sqrt(product(x, x)) * F.sqrt(product(y, y))
    return F.when(size == 0, 0.0).otherwise(product(x, y) / size)


def common_stems(word: ColumnLike) -> Column:
    """The word itself and what plain English endings may have been added to; for a look-up of common words."""
    w = col(word)
    cut = lambda ending, n: F.when((F.length(w) >= 4) & w.endswith(ending), F.substr(w, F.lit(1), F.length(w) - n))
    ing = cut("ing", 3)
    return F.array_compact(F.array(w, cut("s", 1), cut("es", 2), cut("ed", 2), cut("ed", 1), ing, F.concat(ing, F.lit("e"))))


def name_variations(first: ColumnLike, last: ColumnLike, min_length: int = 5) -> Column:
    """Mail-style spellings of a name, in a fixed order, those of at least min_length characters."""
    plain = lambda c: F.lower(F.regexp_replace(col(c), r"(?U)['\-\s]", ""))
    f, la = plain(first), plain(last)
    i, li, dot = F.substring(f, 1, 1), F.substring(la, 1, 1), F.lit(".")
    made = F.array(F.concat(f, dot, la), F.concat(la, dot, f), F.concat(i, dot, la), F.concat(f, dot, li), F.concat(f, la), F.concat(i, la))
    made = F.filter(made, lambda v: F.length(v) >= min_length)
    return F.when((f != "") & (la != ""), made).otherwise(F.array().cast("array<string>"))


def mapped(key: ColumnLike, table: dict[str, str]) -> Column:
    """table[key], or null."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), col(key))


def encoder_category(label: ColumnLike) -> Column:
    """Category of a token label; B- and I- and case don't matter, null for what isn't mapped."""
    return mapped(F.upper(F.regexp_replace(col(label), "^[BI]-", "")), V.ENCODER_LABELS)


def suggest_category(header: ColumnLike) -> Column:
    """Category for a column header: exact, else the first known header inside it, else Freetext."""
    key = F.lower(F.regexp_replace(col(header), r"(?U)^\s+|\s+$", ""))
    known = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in V.HEADER_SUGGESTIONS.items()])
    inside = F.filter(known, lambda e: F.contains(key, e["k"]))
    return F.coalesce(mapped(key, V.HEADER_SUGGESTIONS), F.try_element_at(inside, F.lit(1))["v"], F.lit("Freetext"))


def f_beta(precision: ColumnLike, recall: ColumnLike, beta: float = 5.0) -> Column:
    p, r, b2 = col(precision), col(recall), beta * beta
    return F.when((p == 0) & (r == 0), 0.0).otherwise((1 + b2) * p * r / (b2 * p + r))


def text_match(a: ColumnLike, b: ColumnLike) -> Column:
    """One of the two contains the other, whatever the case and white space at the ends."""
    x, y = (F.lower(F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")) for c in (a, b))
    return F.contains(x, y) | F.contains(y, x)


def sentences(text: ColumnLike) -> Column:
    return F.split(col(text), r"(?U)(?<=[.!?])\s+")


def lines(text: ColumnLike) -> Column:
    """Lines of a text file: any line end counts, and a final one begins no further line."""
    t = col(text)
    but = lambda n: F.left(t, F.length(t) - n)
    whole = F.when(t.endswith("\r\n"), but(2)).when(t.endswith("\n") | t.endswith("\r"), but(1)).otherwise(t)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(whole, r"\r\n?|\n", -1))  # cut once: a generator shares no expressions
