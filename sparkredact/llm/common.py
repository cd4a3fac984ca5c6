"""Helpers that several corpus operators use: shared storage and stable names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as every contract here means it.
WHITE = r"\x20\x09-\x0D"
#: Bytes of text that a Python worker works on at once; arrays over them take some tens of times as much.
SLICE = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where a session names none (tests, a laptop) a folder of this machine is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Tables in the shared folder that cut lineage; each survives the loss of any executor."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write df as a Parquet table and return a reader of it."""
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Remove a table that nothing still to be run reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Hash buckets by which a scan can skip rows that a join won't need; at most so many rows are broadcast.
BUCKETS = 1 << 20


def with_keys(rows: DataFrame, keys: DataFrame, names: list[str], how: str = "left_semi") -> DataFrame:
    """Rows whose hash bucket holds one of the keys (left_anti: holds none), found without a shuffle of rows.

    Some rows without a key pass, more of them the more keys there are; a join has to follow. left_anti is exact in
    that no row with a key passes.
    """
    bucket = F.pmod(F.xxhash64(*names), F.lit(BUCKETS))
    return rows.join(F.broadcast(keys.select(bucket.alias("bucket_")).distinct()), bucket == F.col("bucket_"), how)


#: Keys that join_hot broadcasts at most, and rows of a key up to which it never does.
HOT_KEYS, FEW = 1 << 16, 4096


def join_hot(rows: DataFrame, values: DataFrame, key: str, copies: str) -> DataFrame:
    """The inner join of rows with values (one row for each key), where ``copies`` says how many of rows have the key.

    Keys that hold more than 1 in HOT_KEYS of the rows are fewer than HOT_KEYS, so their values are broadcast and their rows
    stay where they are; other keys meet in a shuffle. values should be a table, since it is read several times.
    """
    total = values.agg(F.sum(copies)).first()[0] or 0
    hot = F.col(copies) > max(FEW, total // HOT_KEYS)
    often, rest = values.filter(hot).drop(copies), values.filter(~hot).drop(copies)
    if often.isEmpty():
        return rows.join(rest, key)
    cold = rows.join(F.broadcast(often.select(key)), key, "left_anti")
    return rows.join(F.broadcast(often), key).unionByName(cold.join(rest, key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeezed(text):
    """Each run of ASCII white space becomes one space. A lone space between words never matches, so most text is only scanned."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x09-\x0D][{WHITE}]*|\x20[{WHITE}]+", " ")


def binary_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first value, bytes, where values begin and the last ends) of consecutive values of a binary column."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes between words: ASCII white space; and for words of letters and digits alone, all ASCII but these.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * C3
    x ^= x >> np.uint64(29)
    x *= C2
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACES, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in ASCII lower case, where they begin, and the index of each document's first word (and the end).

    With prefixes the hashes have a row for whole words and one for each number of bytes; 0 where a word isn't longer.
    """
    space = between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    start = np.flatnonzero(~space & (before | edge[:-1]))
    first = np.searchsorted(start, offsets)
    if not len(start):
        return np.zeros((1 + len(prefixes), 0) if prefixes else 0, np.uint64), start, first
    word = np.zeros(len(data), np.int32)
    word[start] = 1
    word = np.cumsum(word, dtype=np.int32) - 1
    place = np.arange(len(data)) - start[np.maximum(word, 0)]
    place[space] = 0
    with np.errstate(over="ignore"):
        powers = np.full(int(place.max()) + 1, C1 | np.uint64(1))
        powers[0] = 1
        value = mixed(np.arange(1, 257, dtype=np.uint64) * C1)[LOWER[data]]
        value *= np.multiply.accumulate(powers)[place]
        value[space] = 0
        whole = mixed(np.add.reduceat(value, start))
        if not prefixes:
            return whole, start, first
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        size = np.add.reduceat(~space, start, dtype=np.int64)
        rows = [whole]
        for n in prefixes:
            part = mixed(sums[np.minimum(start + n, len(data))] - sums[start] + np.uint64(n) * C2)
            rows.append(np.where(size > n, part, np.uint64(0)))
        return np.stack(rows), start, first
