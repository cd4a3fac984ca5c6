"""The two scalar functions that built-ins can't express, as Arrow-batched functions for distinct words or close pairs."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "AEIOU"

# How a letter sounds. For each letter, what follows (a regex on the rest of the word from it), the code, and
# how many letters that takes. The first that fits holds. "<" asks for the letter before, "^" for the word's start.
SOUNDS: dict[str, list[tuple[str, str, int]]] = {
    "B": [("<M|B$", "", 1), ("B", "B", 1)],
    "C": [("C[EIY]", "S", 1), ("CH", "X", 2), ("C", "K", 1)],
    "D": [("DG[EIY]", "J", 2), ("D", "T", 1)],
    "F": [("F", "F", 1)],
    "G": [("G[EIY]", "J", 1), ("GH[^AEIOU]", "", 2), ("^|GH", "K", 1), ("GH", "", 1), ("G", "K", 1)],
    "H": [("<AEIOU|H", "", 1), ("H[AEIOU]", "H", 1), ("H", "", 1)],
    "J": [("J", "J", 1)],
    "K": [("<C|K", "", 1), ("K", "K", 1)],
    "L": [("L", "L", 1)],
    "M": [("M", "M", 1)],
    "N": [("N", "N", 1)],
    "P": [("PH", "F", 2), ("P", "P", 1)],
    "Q": [("Q", "K", 1)],
    "R": [("R", "R", 1)],
    "S": [("SH", "X", 2), ("SC[EIY]", "S", 2), ("S", "S", 1)],
    "T": [("TH", "0", 2), ("T", "T", 1)],
    "V": [("V", "F", 1)],
    "W": [("W[AEIOU]", "W", 1), ("W", "", 1)],
    "X": [("X", "KS", 1)],
    "Y": [("Y[AEIOU]", "Y", 1), ("Y", "", 1)],
    "Z": [("Z", "S", 1)],
    **{v: [(f"^|{v}", v, 1), (v, "", 1)] for v in VOWELS},
}
SILENT_START = ("AE", "GN", "KN", "PN", "WR")


@lru_cache(maxsize=None)
def _rule(rule: str) -> tuple[str, bool, re.Pattern]:
    before, _, ahead = rule.rpartition("|")
    return before.lstrip("<^"), before.startswith("^"), re.compile(ahead)


def sound_code(word: str | None) -> str:
    """A code that words which sound alike share: consonants by sound, and a leading vowel."""
    letters = "".join(c for c in (word or "").upper() if c.isalpha())
    if letters.startswith(SILENT_START):
        letters = letters[1:]
    code, at, last = "", 0, ""
    while at < len(letters):
        letter = letters[at]
        step = 1
        if letter != last or letter == "C":
            for rule, sound, taken in SOUNDS.get(letter, []):
                before, only_start, ahead = _rule(rule)
                if (not before or (last and last in before)) and (not only_start or at == 0) and ahead.match(letters, at):
                    code, step = code + sound, taken
                    break
            last = letter
        at += step
    return code


def edits_within(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (edits between swapped letters allowed) if it is at most ``most``, else most + 1."""

    @lru_cache(maxsize=None)
    def apart(i: int, j: int, left: int) -> int:
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        rest_a, rest_b = len(a) - i, len(b) - j
        if not rest_a or not rest_b:
            return min(rest_a + rest_b, left + 1)
        if abs(rest_a - rest_b) > left or left == 0:
            return left + 1
        best = left + 1
        for di, dj in ((1, 0), (0, 1), (1, 1)):
            best = min(best, 1 + apart(i + di, j + dj, min(left, best) - 1))
        for p in range(1, left + 1):  # letters i and i + p of a swapped with j + q and j of b, the letters between edited
            for q in range(1, left + 2 - p):
                if i + p < len(a) and j + q < len(b) and a[i] == b[j + q] and a[i + p] == b[j] and (cost := p + q - 1) <= left:
                    best = min(best, cost + apart(i + p + 1, j + q + 1, left - cost))
        return best

    return apart(0, 0, most)


@F.pandas_udf(T.StringType())
def sound_code_udf(words: pd.Series) -> pd.Series:
    return words.map(sound_code)


@F.pandas_udf(T.IntegerType())
def edits_udf(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([edits_within(x, y, int(m)) for x, y, m in zip(a, b, most)], dtype="int32")
