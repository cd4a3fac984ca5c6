"""Packing documents into token windows by non-negative least squares.

1. Each document is tokenised once, ended with an id 0, and cut into full windows and one remainder.
2. The lengths of all pieces form a histogram with one bin a length, at most ``window`` bins however large
   the corpus is. Only this histogram reaches the driver.
3. Shallow combinations of lengths that fill a window are enumerated; non-negative least squares solves
   how often each is used; the solution is rounded within what the histogram holds, and what is left is packed
   greedily, longest first.
4. The plan says, for each length, which ranks among the pieces of that length go to which sequences and
   offsets. Ranks are counted within a task and raised by the counts of the tasks before, so pieces
   find their places without one task ever holding all pieces of a length.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

WINDOW = 1024
#: White-space characters in a row from which a text goes to the tokenizer's own file.
VAST = 10_000


class Encoder:
    """Token ids as little-endian uint32 bytes, equal to the tokenizer's own for every text.

    The pattern of the fast encoder can't match very long runs of white space; the few texts with such a run are encoded by
    the tokenizer's own file.
    """

    def __init__(self, ranks_path: str | None = None, pattern: str | None = None, special: dict[str, int] | None = None, own_path: str | None = None):
        import public_tokenizers
        import tiktoken

        path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {"<|endoftext|>": 50256} if special is None else special
        self.bpe = tiktoken.Encoding("packing", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.vast = re.compile(rf"\s{{{VAST}}}")
        self.own_path, self.own = own_path or public_tokenizers.path("byte_bpe_50k.json"), None

    def __call__(self, text: str) -> bytes:
        if len(text) >= VAST and self.vast.search(text):
            from tokenizers import Tokenizer

            self.own = self.own or Tokenizer.from_file(self.own_path)
            return array("I", self.own.encode(text, add_special_tokens=False).ids).tobytes()
        if "<|" not in text:
            return array("I", self.bpe.encode_ordinary(text)).tobytes()
        return array("I", self.bpe.encode(text, allowed_special="all")).tobytes()


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str | None) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _cut(window: int, ranks_path: str | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(ranks_path), (0).to_bytes(4, "little")
        task, seen = TaskContext.get(), [0] * (window + 1)
        pid, row = (task.partitionId() if task else 0), 0
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    out.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, (pid << 40) + row, pid, seen[length]))
                    seen[length] += 1
                row += 1
            columns = list(zip(*out)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=PIECE)

    return pieces


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row_id", "part", "nth"]


def combinations(window: int) -> list[tuple[tuple[int, int], ...]]:
    """Shallow ways to fill a window, as (length, times): two pieces, three and four with at most two or three lengths."""
    found = {}
    for a in range(1, window):
        for times in (1, 2, 3):
            rest = window - times * a
            if rest > 0:
                found[tuple(sorted({a: times, rest: 1}.items())) if a != rest else ((a, times + 1),)] = None
        for b in {2 * a, 3 * a, window // 4, window // 3, window // 8}:
            rest = window - a - b
            if rest > 0 and len({a, b, rest}) == 3:
                found[tuple(sorted([(a, 1), (b, 1), (rest, 1)]))] = None
    return list(found)


def least_squares(matrix: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |matrix x - target| over x >= 0, by accelerated projected gradients."""
    step = 1.0 / max(np.linalg.norm(matrix, 2) ** 2, 1e-12)
    x = np.zeros(matrix.shape[1])
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * (matrix.T @ (matrix @ y - target)), 0)
        more = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / more * (new - x), new, more
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, offset, times) that place every counted piece.

    histogram[l] is the number of pieces of length l. The row says that ranks from first to end among the pieces of
    that length go to consecutive sequences, ``times`` in each, from ``offset`` on.
    """
    left = histogram.astype(np.int64).copy()
    used, rows, sequence = np.zeros(window + 1, np.int64), [], 0

    def put(pattern: Iterable[tuple[int, int]], count: int) -> None:
        nonlocal sequence
        offset = 0
        for length, times in pattern:
            rows.append((length, used[length], used[length] + count * times, sequence, offset, times))
            used[length] += count * times
            left[length] -= count * times
            offset += length * times
        sequence += count

    if left[window]:
        put([(window, 1)], int(left[window]))
    if left.any():
        ways = combinations(window)
        matrix = np.zeros((window + 1, len(ways)))
        for j, way in enumerate(ways):
            for length, times in way:
                matrix[length, j] = times
        counts = least_squares(matrix, left.astype(float))
        for j in np.argsort(-counts, kind="stable"):
            count = min([round(float(counts[j])), *(int(left[length]) // times for length, times in ways[j])])
            if count > 0:
                put(ways[j], count)
    while left.any():  # two turns at most use up a length
        pattern, room, longest = {}, window, window
        while longest > 0 and (fits := np.flatnonzero(left[: longest + 1])).size:
            length = int(fits[-1])
            pattern[length] = min(int(left[length]), room // length)
            room -= pattern[length] * length
            longest = min(room, length - 1)
        put(sorted(pattern.items(), reverse=True), min(int(left[length]) // times for length, times in pattern.items()))
    return np.array(rows, np.int64).reshape(-1, 6)


def _place(rows: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    key = rows[:, 0] * (1 << 50) + rows[:, 1]

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            at = rows[np.searchsorted(key, length * (1 << 50) + rank, side="right") - 1]
            nth = rank - at[:, 1]
            arrays = [batch.column(name) for name in PLACED[:6]]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(at[:, 3] + nth // at[:, 5]), pa.array(at[:, 4] + nth % at[:, 5] * length)], names=PLACED)

    return placed


PLACED = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row_id", "sequence_id", "offset"]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, ranks_path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and row_id.

    A null or empty text is one piece with the id 0 alone. Rows are packed one by one, so repeated rows, null
    ids and equal ids each get pieces of their own, told apart by row_id. An empty table gives an empty result.
    Other columns are ignored.
    """
    space = Workspace(docs.sparkSession, "packing")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = space.keep(texts.mapInArrow(_cut(window, ranks_path), ", ".join(f"{c} long" for c in PIECE)), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most window rows
        histogram[length] = n
    ranked = pieces.join(bases, ["part", "length"]).select(*PIECE[:6], (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_place(plan(histogram, window)), ", ".join(f"{c} long" for c in PLACED))
