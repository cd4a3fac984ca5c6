"""Repeated-substring removal on suffix arrays: threshold-bounded interval expansion.

A byte goes when some string of ``min_length`` bytes that covers it also starts in a document with a smaller
id. Inside a block of text the common prefixes are found on a Burrows-Wheeler transform: the rows of the
sorted suffixes start as one interval for each string of WORD bytes; breadth first, all intervals of strings of length v
are extended backwards at once, which splits rows whose common prefix is v bytes and so yields the prefix lengths by increasing
value. At ``min_length`` the expansion stops: rows still together share that many bytes.

Pieces of text that are equal as a whole are told by 128-bit hashes before that, so results hold but for a clash of those;
intervals are expanded for what differs.

Getting equal strings into one block takes three steps, none of which loses a match:

* Every window of min_length bytes has a minimiser: the smallest hash of the short strings in it. Equal windows
  have equal minimisers. Windows with one minimiser in a row form a run; a run whose minimiser is a multiple of
  CHUNK starts a new piece, so pieces are cut by content. Equal pieces collapse to their first document: later copies
  go whole, and only the first has to be compared with others.
* A minimiser that occurs in just one distinct piece can't take part in another match. Counting minimisers
  over distinct pieces leaves the runs that may.
* Those runs, a few dozen bytes longer than a window, are dealt by minimiser into blocks, and each block is expanded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, binary_slices, with_keys

MIN_LENGTH = 50
#: Bytes of the strings whose hashes are compared, runs a piece on average, and windows of a run at most.
SEED, CHUNK, LONGEST_RUN = 24, 16, 256
#: Bytes of a block that is expanded at once, unless one minimiser's runs exceed it; so few that its rows stay in the cache.
BLOCK = 1 << 18
#: Bytes of the strings that intervals start with: as many as are compared at once.
WORD = 8
#: Pairs of minimiser and piece in a bucket, about.
BUCKET = 1 << 23
#: Distinct pieces with one minimiser from which its windows are dealt by their own hash.
CROWDED = 20_000
NOWHERE = np.iinfo(np.int64).max


# ---- strings of a block ----------------------------------------------------------------------------------------


def sorted_suffixes(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions of data in the order of their suffixes' first bytes, at least depth of them; zeros follow the end."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), "<u8", padded, strides=(1,)).byteswap()
    order = np.argsort(key)
    fresh = np.ones(n, bool)
    ordered = key[order]
    fresh[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n + 1, np.int64)
    starts = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order], rank[n] = starts, -1
    width = 8
    while width < depth:
        together = ~fresh
        together[:-1] |= together[1:]
        at = np.flatnonzero(together)
        if not at.size:
            break
        who = order[at]
        then = rank[np.minimum(who + width, n)] + 1
        key = (rank[who] << 32) | then
        way = np.argsort(key)
        order[at], key = who[way], key[way]
        fresh[at[1:]] = key[1:] != key[:-1]
        fresh[at[0]] = True
        starts = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[order] = starts
        width *= 2
    return order


def expand(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each row of order, whether it starts an interval: its first ``length`` bytes differ from the row before's.

    Row p holds the suffix at order[p]; next[p] is the row of the suffix one byte shorter, so p is where the
    backward step by data[order[p]] takes row next[p]. The interval of c+w is the run of rows that begin with c and come
    from the interval of w. Values are found in increasing order; a row whose value is known isn't looked at again.
    """
    n, known = len(data), WORD if length >= WORD else 1
    row = np.empty(n + 1, np.int32)
    row[order] = np.arange(n, dtype=np.int32)
    row[n] = row[n - 1]
    first = (np.ndarray((n,), "<u8", np.concatenate([data, np.zeros(WORD, np.uint8)]), strides=(1,)) if known == WORD else data)[order]
    starts = np.ones(n, bool)
    starts[1:] = first[1:] != first[:-1]
    following = row[np.minimum(order + 1, n)]
    open_rows = np.flatnonzero(~starts).astype(np.int32)
    left, right = following[open_rows - 1], following[open_rows]
    for _ in range(length - known):
        interval = np.cumsum(starts, dtype=np.int32)
        apart = interval[left] != interval[right]
        if not apart.any():
            break
        starts[open_rows[apart]] = True
        together = ~apart
        open_rows, left, right = open_rows[together], left[together], right[together]
    return starts


def first_places(texts: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest document among all texts with a window, in one array; and where each text's windows begin in it, and their number."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    windows = np.maximum(sizes - length + 1, 0)
    inside = np.arange(len(data)) - np.repeat(begins, sizes + 1)
    order = sorted_suffixes(data, length)
    starts = np.flatnonzero(expand(data, order, length))
    values = np.where(inside < np.repeat(windows, sizes + 1), np.repeat(docs, sizes + 1), NOWHERE)[order]
    least = np.minimum.reduceat(values, starts)
    first = np.empty(len(data), np.int64)
    first[order] = np.repeat(least, np.diff(np.append(starts, len(data))))
    return first, begins, windows


# ---- minimisers and pieces ------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def minima(data: np.ndarray, length: int) -> np.ndarray:
    """For each window of data, the smallest hash of the SEED-byte strings in it."""
    n = len(data) - SEED + 1
    if len(data) < length:
        return np.zeros(0, np.uint64)
    word = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        least = word[:n] * np.uint64(0x9E3779B97F4A7C15)
        for at in {*range(8, SEED - 7, 8), SEED - 8}:
            least += word[at : at + n] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * at)
        least = _mixed(least)
    span, want = 1, length - SEED + 1
    while span * 2 <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(least) - (want - span)], least[want - span :]) if want > span else least


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end (in windows), minimiser and document (index) of each run of windows with one minimiser."""
    least = minima(data, length)
    n = len(least)
    inside = np.zeros(n + 1, np.int8)  # +1 where a document's windows begin, -1 where they end
    ends = np.maximum(offsets[1:] - length + 1, offsets[:-1])
    some = ends > offsets[:-1]
    begins, ends = offsets[:-1][some], ends[some]
    if not len(begins):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    np.add.at(inside, begins, 1)
    np.add.at(inside, ends, -1)
    valid = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    new = np.ones(n, bool)
    new[1:] = least[1:] != least[:-1]
    new[begins] = True
    start = np.flatnonzero(new & valid)
    which = np.searchsorted(begins, start, side="right") - 1
    end = np.minimum(np.append(start[1:], n), ends[which])
    return start, end, least[start], np.flatnonzero(some)[which]


def pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """Runs (start, end, minimiser, document) and, for pieces, the index of the first run of each."""
    start, end, least, doc = runs(data, offsets, length)
    opens = (least % np.uint64(CHUNK)) == 0
    if len(doc):
        opens[0] = True
        opens[1:] |= doc[1:] != doc[:-1]
    return start, end, least, doc, np.flatnonzero(opens)


def _digests(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit hashes of parts of data, as two int64 columns."""
    import xxhash

    view, digest = memoryview(data), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(view[b:e]) for b, e in zip(begins.tolist(), ends.tolist())]), np.int64).reshape(-1, 2)


#: Bits of a minimiser that are told apart besides those of its bucket. Minimisers that collide only deal more into a block.
LOW = np.uint64(40)


def named(least: np.ndarray, buckets: int) -> np.ndarray:
    """Minimisers as bucket and LOW bits."""
    with np.errstate(over="ignore"):
        spread = least * np.uint64(0x9E3779B97F4A7C15)
    return (((spread >> LOW) % np.uint64(buckets)) << LOW) | (spread & ((np.uint64(1) << LOW) - np.uint64(1)))


PIECES = "ha long, hb long, doc long, tk long, start int, windows int"


def _pieces(length: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at, data, offsets in binary_slices(batch.column(2)):
                start, end, _, doc, opens = pieces(data, offsets, length)
                last = np.append(opens[1:], len(start)) - 1
                begin, stop, doc = start[opens], end[last], doc[opens]
                hashes = _digests(data, begin, stop + length - 1)
                arrays = [hashes[:, 0], hashes[:, 1], ids[at + doc], tks[at + doc], (begin - offsets[doc]).astype(np.int32), (stop - begin).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["ha", "hb", "doc", "tk", "start", "windows"])

    return found


def _minimisers(length: int, buckets: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each bucket, the distinct (minimiser, piece) of a batch as two packed arrays."""

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, data, offsets in binary_slices(batch.column(0)):
                start, end, low, _, opens = pieces(data, offsets, length)
                last = np.append(opens[1:], len(start)) - 1
                piece = _digests(data, start[opens], end[last] + length - 1)[:, 0]
                parts.append((low, np.repeat(piece, last - opens + 1)))
            if not parts:
                continue
            least, piece = (np.concatenate(x) for x in zip(*parts))
            least = named(least, buckets)
            way = np.lexsort((piece, least))
            least, piece = least[way], piece[way]
            if len(way):
                new = np.ones(len(way), bool)
                new[1:] = (least[1:] != least[:-1]) | (piece[1:] != piece[:-1])
                least, piece = least[new], piece[new]
            cuts = np.searchsorted(least >> LOW, np.arange(buckets + 1, dtype=np.uint64)).tolist()
            four, one = least.astype(np.uint32), (least >> np.uint64(32)).astype(np.uint8)
            rows = [(b, four[i:j].tobytes(), one[i:j].tobytes(), piece[i:j].tobytes()) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["bucket", "four", "one", "piece"])

    return found


def _shared(group: pa.Table) -> pa.Table:
    """The (minimiser, piece) pairs of a bucket whose minimiser has several pieces, and whether it has very many."""
    least = np.frombuffer(b"".join(group.column("four").to_pylist()), np.uint32).astype(np.uint64)
    least |= np.frombuffer(b"".join(group.column("one").to_pylist()), np.uint8).astype(np.uint64) << np.uint64(32)
    least |= np.uint64(group.column("bucket")[0].as_py()) << LOW
    piece = np.frombuffer(b"".join(group.column("piece").to_pylist()), np.int64)
    way = np.lexsort((piece, least))
    least, piece = least[way], piece[way]
    new = np.ones(len(way), bool)
    new[1:] = (least[1:] != least[:-1]) | (piece[1:] != piece[:-1])
    least, piece = least[new], piece[new]
    begin = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    count = np.diff(np.append(begin, len(least)))
    count = np.repeat(count, count)
    many = count > 1
    return pa.table({"ha": piece[many], "least": least[many].view(np.int64), "crowded": count[many] > CROWDED})


def _all_runs(column: pa.Array, length: int, buckets: int) -> Iterator[tuple]:
    for first, data, offsets in binary_slices(column):
        start, end, least, doc = runs(data, offsets, length)
        yield first, data, offsets, start, end, named(least, buckets).view(np.int64), doc


def _contexts(length: int, buckets: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The texts of the asked runs: key, doc, tk, place of the first byte, text."""

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, tks, asked = (batch.column(i).to_pylist() for i in (0, 1, 3))
            out: list[tuple] = []
            for first, d, data, offsets, start, end, names, doc in ((first, d, *rest) for first, *rest in _all_runs(batch.column(2), length, buckets) for d in range(len(rest[1]) - 1)):
                i, j = np.searchsorted(doc, [d, d + 1])
                begin, stop, low, base, raw = start[i:j], end[i:j], names[i:j], int(offsets[d]), memoryview(data)
                for ask in asked[first + d]:
                    a, b = np.searchsorted(begin, [base + ask["start"], base + ask["start"] + ask["windows"]])
                    crowd = {x["least"]: x["crowded"] for x in ask["keys"]}
                    for k in range(a, b):
                        if (hot := crowd.get(int(low[k]))) is None:
                            continue
                        step = 1 if hot else LONGEST_RUN
                        for at in range(int(begin[k]), int(stop[k]), step):
                            text = bytes(raw[at : min(at + step, int(stop[k])) + length - 1])
                            out.append((xxhash.xxh3_64_intdigest(text) - (1 << 63) if hot else int(low[k]), ids[first + d], tks[first + d], at - base, text))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["key", "doc", "tk", "place", "text"])

    return found


def _spans(length: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Expand blocks of a partition sorted by key and doc: doc, tk, begin and end of bytes whose window has an earlier document.

    Rows of a key come by document, so a text that an earlier document of the key has goes whole at once. Just the first
    document's rows of each distinct text wait for the block, and those of a key with one text or document need no expansion: nothing
    is held for the copies, however many share a key.
    """

    def block(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        doc, tk, place = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        index = {text: i for i, text in enumerate(dict.fromkeys(r[3] for r in rows))}
        which, least = np.array([index[r[3]] for r in rows]), np.full(len(index), NOWHERE)
        np.minimum.at(least, which, doc)
        first, begins, windows = first_places(list(index), least, length)
        row = np.repeat(np.arange(len(rows)), windows[which])
        inside = np.arange(len(row)) - np.repeat(np.cumsum(windows[which]) - windows[which], windows[which])
        gone = first[begins[which][row] + inside] < doc[row]
        both = gone[1:] & gone[:-1] & (row[1:] == row[:-1])
        opens, closes = np.flatnonzero(gone & ~np.append(False, both)), np.flatnonzero(gone & ~np.append(both, False))
        at = row[opens]
        return spans([doc[at], tk[at], place[at] + inside[opens], place[at] + inside[closes] + length])

    def expanded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        own: list[tuple[int, int, int, bytes]] = []  # of the present key
        seen: dict[bytes, int] = {}
        size, previous = 0, None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if len(set(seen.values())) > 1:
                held.extend(own)
                size += sum(map(len, seen))
            own.clear()
            seen.clear()
            if size >= BLOCK:
                yield block(held)
                held.clear()
                size = 0

        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for key, doc, tk, place, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if key != previous:
                    yield from close()
                    previous = key
                if seen.setdefault(text, doc) < doc:
                    out.append((doc, tk, place, place + len(text)))
                else:
                    own.append((doc, tk, place, text))
            if out:
                yield spans(list(zip(*out)))
        yield from close()
        if held:
            yield block(held)

    def spans(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "tk", "begin", "end"])

    return expanded


def _marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, n_removed, n_spans, kept from doc_id, text and the spans found in it."""
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
            text, kept, at, spans = text or b"", [], 0, 0
            end = -1
            for span in sorted((s["begin"], s["end"]) for s in found or ()):
                if span[0] > end:
                    spans += 1
                    kept.append(text[max(end, 0) : span[0]])
                    end = span[1]
                else:
                    end = max(end, span[1])
            kept.append(text[max(end, 0) :])
            left = b"".join(kept)
            out.append((doc_id, len(text), len(text) - len(left), spans, left))
        columns = list(zip(*out)) if out else [()] * 5
        kinds = [pa.int64()] * 4 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _summary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _marked(batches):
        digest = pa.array([hashlib.sha256(x).hexdigest() for x in batch.column(4).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], digest], names=[*batch.schema.names[:4], "kept_sha256"])


MARKED = "doc_id long, n_bytes long, n_removed long, n_spans long"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, digest_only: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans and kept (binary), or kept_sha256 if digest_only.

    Texts are compared as UTF-8 bytes; kept may cut a character in two where a match does. A null text counts as
    empty, texts shorter than min_length stay whole. Rows with one id are one document's parts and don't remove each
    other's bytes; a null id comes after all others. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "suffix-dedup")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(int(NOWHERE) - 1)).alias("doc"), text.alias("text")).withColumn("tk", F.xxhash64("text"))
    long_enough = own.filter(F.length("text") >= min_length)

    found = space.keep(long_enough.select("doc", "tk", "text").mapInArrow(_pieces(min_length), PIECES), "pieces")
    firsts = found.groupBy("ha", "hb").agg(F.min("doc").alias("first"))
    placed = space.keep(found.join(firsts, ["ha", "hb"]), "placed")
    copies = placed.filter("doc > first").select("doc", "tk", F.col("start").cast("long").alias("begin"), (F.col("start") + F.col("windows") + min_length - 1).cast("long").alias("end"))

    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), placed.count() * CHUNK // BUCKET)
    packed = long_enough.select("text").mapInArrow(_minimisers(min_length, buckets), "bucket int, four binary, one binary, piece binary")
    shared = packed.groupBy("bucket").applyInArrow(_shared, "ha long, least long, crowded boolean")
    keys = space.keep(shared.groupBy("ha").agg(F.collect_list(F.struct("least", "crowded")).alias("keys")), "keys")
    asked = placed.filter("doc = first").join(keys, "ha").groupBy("doc", "tk").agg(F.collect_set(F.struct("start", "windows", "keys")).alias("asked"))
    asked = space.keep(asked, "asked")
    contexts = with_keys(long_enough.select("doc", "tk", "text"), asked, ["doc", "tk"]).join(asked, ["doc", "tk"]).select("doc", "tk", "text", "asked")
    contexts = contexts.mapInArrow(_contexts(min_length, buckets), "key long, doc long, tk long, place int, text binary")
    blocks = contexts.repartition("key").sortWithinPartitions("key", "doc")
    spans = blocks.mapInArrow(_spans(min_length), "doc long, tk long, begin long, end long").unionByName(copies)
    spans = space.keep(spans.groupBy("doc", "tk").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "spans")
    # Documents of which nothing goes aren't shuffled.
    touched = with_keys(own, spans, ["doc", "tk"]).join(spans, ["doc", "tk"], "left").select("doc_id", "text", "spans")
    whole = with_keys(own, spans, ["doc", "tk"], "left_anti").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    marked = touched.unionByName(whole)
    if digest_only:
        return marked.mapInArrow(_summary, f"{MARKED}, kept_sha256 string")
    return marked.mapInArrow(_marked, f"{MARKED}, kept binary")
