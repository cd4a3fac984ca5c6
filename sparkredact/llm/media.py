"""Media columns: content-addressed payloads in tar shards, with metadata from header-only range reads.

Payloads are stored as 8-bit greyscale PNG images, 64 samples a row: lossless, in a format whose header tells its
size. Every task writes one tar shard into the shared folder; inside a shard a payload is stored once, under
its SHA-256. Rows carry digest, shard, offset and length; where several shards hold a digest, all rows point to one
of them. A retried or speculative task writes a shard of its own name, and only the names that a finished task
returned are ever read.

Reading opens a shard once a task. Metadata columns (width, height, bit depth) come from a range read of the image header
alone, in ``header_columns`` as in ``media_columns``; features take another read, of the whole range, decode it and compute
on the samples. Each digest is read once, and rows find its columns by a join in which digests of very many rows are broadcast.
"""

from __future__ import annotations

import hashlib
import io
import math
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_hot

#: Samples of an image row, and so the unit that payloads are padded to.
WIDTH = 64
#: Fixed values of the image format: its signature, and the bytes up to the end of the header chunk.
SIGNATURE, HEADER_BYTES = b"\x89PNG\r\n\x1a\n", 33


def pad(payload: bytes) -> bytes:
    """payload with zeros up to a positive multiple of WIDTH."""
    return payload + bytes(-len(payload) % WIDTH or (0 if payload else WIDTH))


def encode_image(samples: bytes, level: int = 1) -> bytes:
    """An 8-bit greyscale PNG of rows of WIDTH samples."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = len(samples) // WIDTH
    filtered = np.zeros((rows, WIDTH + 1), np.uint8)  # each row begins with its filter, 0: none
    filtered[:, 1:] = np.frombuffer(samples, np.uint8).reshape(rows, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(filtered.tobytes(), level)) + chunk(b"IEND", b"")


def read_header(head: bytes) -> dict[str, int]:
    """width, height and bit_depth from the first HEADER_BYTES of an image."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return {"width": width, "height": height, "bit_depth": depth}


def decode_image(media: bytes) -> bytes:
    """The samples of an image that encode_image wrote; checks every chunk's CRC."""
    at, body = 8, b""
    size = read_header(media[:HEADER_BYTES])
    while at < len(media):
        (length,) = struct.unpack(">I", media[at : at + 4])
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + length]
        if struct.unpack(">I", media[at + 8 + length : at + 12 + length])[0] != zlib.crc32(kind + data):
            raise ValueError("damaged image")
        if kind == b"IDAT":
            body += data
        at += 12 + length
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size["height"], size["width"] + 1)
    if rows[:, 0].any():
        raise ValueError("rows with a filter aren't written here")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """mean, deviation and entropy of the samples, and a 64-bit hash of which of 64 equal parts are brighter than the mean."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    mean = int(np.dot(counts, np.arange(256))) / len(x)
    deviation = math.sqrt(max(0.0, float(np.dot(counts, (np.arange(256) - mean) ** 2)) / len(x)))
    entropy = float(-(share * np.log2(share)).sum())
    parts = x.reshape(64, -1).mean(axis=1) > mean
    return f"mean={mean:.4f};dev={deviation:.4f};entropy={entropy:.4f};hash={np.packbits(parts).tobytes().hex()}"


def _folder(uri: str):
    """File system and path of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


STORED = ["doc_id", "n_bytes", "digest", "shard", "offset", "length"]
STORED_SCHEMA = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def _store(root: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"shard-{task.partitionId() if task else 0:06d}-{uuid.uuid4().hex[:8]}.tar"
        places: dict[bytes, tuple[str, int, int]] = {}
        held: list[list] = []
        out = None
        try:
            for batch in batches:
                rows = []
                for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    raw = raw or b""
                    payload = pad(raw)
                    key = hashlib.sha256(payload).digest()
                    if key not in places:
                        if out is None:
                            system, path = _folder(root)
                            system.create_dir(path, recursive=True)
                            out = system.open_output_stream(f"{path}/{name}")
                            at = 0
                        media = encode_image(payload)
                        entry = tarfile.TarInfo(f"{key.hex()}.png")
                        entry.size = len(media)
                        head = entry.tobuf(tarfile.USTAR_FORMAT)
                        out.write(head + media + bytes(-len(media) % 512))
                        places[key] = (key.hex(), at + len(head), len(media))
                        at += len(head) + len(media) + -len(media) % 512
                    digest, offset, length = places[key]
                    rows.append((doc_id, len(raw), digest, name, offset, length))
                held.append(rows)
            if out is not None:
                out.write(bytes(1024))
        finally:
            if out is not None:
                out.close()
        # Rows leave once the shard is closed, so that no row points into an unfinished one.
        for rows in held:
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=STORED)

    return store


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", space: Workspace | None = None) -> tuple[DataFrame, str]:
    """Rows (doc_id, n_bytes, digest, shard, offset, length) of stored payloads, and the folder of the shards.

    The payload is the text's UTF-8 (null: empty), padded with zeros. Equal payloads have one digest and, over all rows, one place.
    Repeated rows and null ids stay rows. An empty table stores nothing; other columns are ignored.
    """
    space = space or Workspace(docs.sparkSession, "media")
    root = space.path("shards")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    stored = space.keep(own.mapInArrow(_store(root), STORED_SCHEMA), "stored")
    places = space.keep(stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place"), F.count("*").alias("copies")), "places")
    rows = join_hot(stored.select("doc_id", "n_bytes", "digest"), places, "digest", "copies")
    return rows.select("doc_id", "n_bytes", "digest", "place.shard", "place.offset", "place.length"), root


def _ranges(root: str, whole: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _folder(root)
        name, shard = None, None
        for batch in batches:
            rows = []
            for digest, wanted, offset, length, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if wanted != name:
                    if shard is not None:
                        shard.close()
                    name, shard = wanted, system.open_input_file(f"{path}/{wanted}")
                size = read_header(shard.read_at(HEADER_BYTES, offset))
                head = (digest, copies, size["width"], size["height"], size["bit_depth"])
                if not whole:
                    rows.append(head)
                    continue
                media = shard.read_at(length, offset)
                samples = decode_image(media)
                rows.append(
                    (*head, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples))
                )
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = FEATURES if whole else HEADERS
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        if shard is not None:
            shard.close()

    return read


HEADERS = ["digest", "copies", "width", "height", "bit_depth"]
FEATURES = [*HEADERS, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
HEADERS_SCHEMA = "digest string, copies long, width long, height long, bit_depth long"
FEATURES_SCHEMA = f"{HEADERS_SCHEMA}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(rows: DataFrame, root: str, whole: bool, schema: str) -> DataFrame:
    """rows with what is read for each stored payload once, in the order of its shard and dealt by shard and part of it."""
    places = rows.groupBy("digest", "shard", "offset", "length").agg(F.count("*").alias("copies"))
    part = F.floor(F.col("offset") / F.lit(8 << 20))
    found = places.repartition(F.col("shard"), part).sortWithinPartitions("shard", "offset").mapInArrow(_ranges(root, whole), schema)
    return join_hot(rows, Workspace(rows.sparkSession, "media-read").keep(found, "found"), "digest", "copies")


def header_columns(rows: DataFrame, root: str) -> DataFrame:
    """rows with width, height and bit_depth, for which only HEADER_BYTES of each payload are read."""
    return _read(rows, root, False, HEADERS_SCHEMA)


def media_columns(rows: DataFrame, root: str) -> DataFrame:
    """rows with the header's columns and those computed from the payload as it is read back."""
    return _read(rows, root, True, FEATURES_SCHEMA)
