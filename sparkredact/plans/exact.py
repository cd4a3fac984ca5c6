"""Exact mode: each document is read as the sequential rules say, a match on one line hiding text on all later ones.

The set-oriented plan resolves stages one by one; inside a stage it doesn't see that a match on line 1 would have
masked part of line 9. Where that order matters, this plan runs a small interpreter of the same rule tables, a document at
a time, by ``mapInArrow``: documents are independent, so it needs no shuffle at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.batches import runs

LOOKUP_ROW = "norm_key string, original_term string, anonymised_term string, pii_category string, first_seen_line int, is_alias boolean"
RESULT = f"doc_id string, redacted string, lookup array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in LOOKUP_ROW.split(', '))}>>"
LOOKUP_ARROW = pa.list_(pa.struct([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]]) for c in LOOKUP_ROW.split(", ")]))


@lru_cache(maxsize=256)
def python_pattern(java: str) -> re.Pattern:
    """A pattern of the vocabulary as a Python one; Python's classes are Unicode's anyway."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)", java)
    body = java[flags.end() :] if flags else java
    return re.compile(body, re.IGNORECASE if flags and "i" in flags[1] else 0)


def key_of(term: str) -> str:
    return " ".join(re.sub("['’]", "", term.lower()).replace("-", " ").split())


@lru_cache(maxsize=4096)
def _term_pattern(term: str) -> re.Pattern:
    ends = [r"\b" if re.match(r"\w", c) else "" for c in (term[0], term[-1])]
    return re.compile(r"\[[^\]]*\]|(" + ends[0] + re.escape(term) + ends[1] + ")")


def put_tag(text: str, term: str, tag: str) -> str:
    if term not in text:  # most lines; looking is far cheaper than matching
        return text
    return _term_pattern(term).sub(lambda m: tag if m[1] else m[0], text)


@dataclass
class Book:
    """The lookup of a document while it is read."""

    tags: dict[str, tuple] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)

    def tag(self, term: str) -> str | None:
        row = self.tags.get(key_of(term))
        return row[1] if row else None

    def add(self, term: str, category: str, line: int) -> str:
        if (known := self.tag(term)) is None:
            self.counts[category] = self.counts.get(category, 0) + 1
            known = f"[{category} {self.counts[category]}]"
            self.tags[key_of(term)] = (term, known, category, line, False)
        return known

    def alias(self, term: str, tag: str, category: str, line: int) -> None:
        self.tags.setdefault(key_of(term), (term, tag, category, line, True))


def _luhn(term: str) -> bool:
    digits = [int(c) for c in term if c.isdigit()]
    return len(digits) >= 13 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _date(term: str) -> bool:
    found = re.fullmatch(r"(\d{1,2})[/-](\d{1,2})[/-](\d{2}|(?:19|20)\d{2})", term)
    if not found:
        return False
    a, b = int(found[1]), int(found[2])
    return (1 <= a <= 12 and 1 <= b <= 31) or (1 <= b <= 12 and 1 <= a <= 31)


def _phone(term: str) -> bool:
    digits = sum(c.isdigit() for c in term)
    marked = bool(re.search(r"[+()]", term)) or "x" in term.lower()
    return 7 <= digits <= 15 and not re.fullmatch(r"\d{1,3}(\.\d{1,3}){2,}", term) and (marked or bool(re.fullmatch(r"\d{3}-\d{3}-\d{4}", term.strip())))


CHECKS = {None: lambda t: True, "plausible_date": _date, "plausible_phone": _phone, "luhn_if_digits": lambda t: not re.fullmatch(r"[\d\s-]{13,}", t) or _luhn(t)}


@lru_cache(maxsize=64)
def _list_pattern(words: tuple[str, ...]) -> re.Pattern:
    """Any of the words, the longest first, whole and in any case."""
    return re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + r")\b", re.IGNORECASE)


def _found(lines: list[str], line: int, pattern: re.Pattern, group: int = 0) -> Iterator[str]:
    """Terms of a line as it stands when the pattern comes to it."""
    if pattern is python_pattern(V.ORG) and not python_pattern(V.ORG_END).search(lines[line]):
        return
    for match in pattern.finditer(lines[line]):
        if (term := match[group]) and not (term.startswith("[") and term.endswith("]")):
            yield term


def _take(lines: list[str], book: Book, term: str, category: str, line: int) -> str:
    tag = book.add(term, category, line + 1)
    lines[:] = [put_tag(text, term, tag) for text in lines]
    return tag


def read_document(text: str, secrets: bool = True, lists: Iterable[dict] = ()) -> Book:
    """The lookup of one text by e-mail, organisation, title, structured, entropy and list rules, in this order."""
    lines, book = re.split(r"\r\n|\r|\n", text), Book()
    if lines and lines[-1] == "":
        lines.pop()
    for category, pattern in (("EMAIL", V.EMAIL), ("ORG", V.ORG)):
        for n in range(len(lines)):
            for term in _found(lines, n, python_pattern(pattern)):
                _take(lines, book, term, category, n)
    for n in range(len(lines)):
        for term in (t.strip() for t in _found(lines, n, python_pattern(V.TITLED_NAME), 1)):
            if not term:
                continue
            fresh = book.tag(term) is None
            tag = _take(lines, book, term, "NAME", n)
            words = term.split()
            for word in words if fresh and len(words) > 1 else ():
                if len(word) >= 3:
                    book.alias(word, tag, "NAME", n + 1)
    for n in range(len(lines)):
        for category, pattern, group, check in V.STRUCTURED:
            for term in _found(lines, n, python_pattern(pattern), group):
                if CHECKS[check](term):
                    _take(lines, book, term, category, n)
    for n in range(len(lines) if secrets else 0):
        tags = [m.span() for m in re.finditer(r"\[[^\]]*\]", lines[n])]
        for match in list(python_pattern(V.SECRET).finditer(lines[n])):
            inside = any(a <= match.start() and match.end() <= b for a, b in tags)
            if not inside and is_secret(match[0]) and book.tag(match[0]) is None:
                _take(lines, book, match[0], "ID", n)
    by_category: dict[str, list[str]] = {}
    for one in lists:
        by_category.setdefault(one["category"], []).extend(w.strip() for w in one["words"] if w.strip())
    for n in range(len(lines) if by_category else 0):
        for category, words in by_category.items():
            for term in _found(lines, n, _list_pattern(tuple(words))):
                _take(lines, book, term, category, n)
    return book


def is_secret(token: str, min_entropy: float = 3.5, min_length: int = 8) -> bool:
    import math

    kinds = (any(c.isupper() for c in token), any(c.islower() for c in token), any(c.isdigit() for c in token))
    if len(token) < min_length or token.isalpha() or token.isdigit() or sum(kinds) < 2 or re.fullmatch(r"[a-z]+(?:[_-][a-z]+)+", token):
        return False
    shares = [token.count(c) / len(token) for c in set(token)]
    return -sum(p * math.log2(p) for p in shares) >= min_entropy


def replay_text(text: str, book: Book) -> str:
    """The pristine text with every entry's first form replaced, longest first."""
    for term, tag, *_ in sorted(book.tags.values(), key=lambda row: -len(row[0])):
        text = put_tag(text, term, tag)
    return text


def redact_exactly(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", secrets: bool = True, lists: Iterable[dict] = ()) -> DataFrame:
    """doc_id, redacted and lookup (array) of each document, read sequentially; tags count from 1 in each."""
    lists = [{"category": x["category"], "words": list(x["words"])} for x in lists if x.get("category")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            redacted, books = [], []
            for text in (t or "" for t in batch["text"].to_pylist()):
                book = read_document(text, secrets, lists)
                redacted.append(replay_text(text, book))
                books.append([dict(zip(names, (key, *row))) for key, row in book.tags.items()])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(redacted, pa.string()), pa.array(books, LOOKUP_ARROW)], ["doc_id", "redacted", "lookup"])

    names = [c.split()[0] for c in LOOKUP_ROW.split(", ")]
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, RESULT)
