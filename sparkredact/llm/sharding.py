"""Sharding by size-tiered compaction with versioned manifests.

Arrivals are appended as small immutable shards. Shards of similar size (one tier: sizes within a power of FANOUT) that
have gathered are merged into one run of the next tier, until runs reach the target size and are never
rewritten. Which shards make up the data is said by a manifest: a new version lists all live shards and is
committed by moving its file to a name that must not exist yet, in one step, so of two writers of one version one
fails, and readers see either the old or the new state. Replaced shards stay until the next compaction has
something to merge, so whoever planned on the version before can still read it.

The runs of a round are merged side by side, each by one task that reads and writes it end to end.

Rows are written by Spark alone, as Parquet directories in the shared folder; the driver handles names, sizes and
manifests through the file system API of the cluster. A lost executor or driver leaves at most shards that no manifest
names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

#: Bytes of text a finished run should have, runs of a tier that are merged at once, and bytes of the lowest tier.
TARGET_BYTES, FANOUT, LOWEST_BYTES = 128 << 20, 4, 1 << 20
#: Runs that are merged and committed at once.
MERGES = 256
#: Of a plan that unites frames of one partition each: whether it keeps one partition. Runs are merged side by side only if not.
UNITE = "spark.sql.unionOutputPartitioning"


#: Columns that are added to rows here; a column of the rows by such a name is refused.
PART, SHARD, LEVEL = "shard_part", "shard_name", "shard_level"


@dataclass(frozen=True)
class Shard:
    name: str
    n_bytes: int
    n_rows: int
    level: int


class Store:
    """A set of shards in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fanout: int = FANOUT, lowest: int = LOWEST_BYTES):
        self.spark, self.root, self.target, self.fanout, self.lowest = spark, root, target, fanout, lowest
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # ---- manifests ----

    def version(self) -> int:
        folder = self._path("manifest")
        if not self.fs.exists(folder):
            return 0
        return max([int(s.getPath().getName()[1:-5]) for s in self.fs.listStatus(folder) if s.getPath().getName().startswith("v")], default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self.fs.open(self._path(f"manifest/v{version:08d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**x) for x in json.loads(text)["shards"]]

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Make shards the next version after base; RuntimeError if someone else has committed since."""
        final, draft = self._path(f"manifest/v{base + 1:08d}.json"), self._path(f"manifest/.draft-{uuid.uuid4().hex}")
        self.fs.mkdirs(self._path("manifest"))
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps({"version": base + 1, "shards": [asdict(s) for s in shards]}).encode()))
        stream.close()
        try:
            self._move(draft, final)
        except Py4JJavaError as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            raise RuntimeError(f"version {base + 1} was committed by another writer") from None
        return base + 1

    def _move(self, draft, final) -> None:
        """Give draft the name final in one step, or raise FileAlreadyExists."""
        if self.fs.getUri().getScheme() == "file":  # whose rename may replace; a hard link never does
            place = lambda path: self.jvm.java.io.File(path.toUri().getPath()).toPath()
            self.jvm.java.nio.file.Files.createLink(place(final), place(draft))
            self.fs.delete(draft, False)
            return
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.valueOf("NONE")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(final), how)

    # ---- shards ----

    def _write(self, rows: DataFrame, level: int, name: str, text_col: str) -> list[Shard]:
        """Rows with a column PART: a shard for each value of it."""
        rows.write.option("compression", "zstd").partitionBy(PART).parquet(f"{self.root}/data/{name}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.root}/data/{name}")
        sizes = written.groupBy(PART).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length(text_col), F.lit(0))).alias("b"))
        return [Shard(f"data/{name}/{PART}={r[PART]}", int(r["b"]), int(r["n"]), level) for r in sizes.orderBy(PART).collect()]

    def _name(self, version: int, level: int) -> str:
        """A folder's name that says the level of its shards."""
        return f"v{version}-l{level}-{uuid.uuid4().hex[:8]}"

    def append(self, rows: DataFrame, splits: int = 2, text_col: str = "text", key: str = "doc_id") -> int:
        """Add rows as small shards in one new version: each task that reads rows writes ``splits`` of them, with no shuffle."""
        base = self.version()
        split = F.pmod(F.xxhash64(F.col(key).cast("string"), text_col), F.lit(splits))
        dealt = rows.withColumn(PART, F.spark_partition_id().cast("long") * splits + split)
        return self.commit(base, [*self.shards(base), *self._write(dealt, 0, self._name(base + 1, 0), text_col)])

    def tier(self, shard: Shard) -> int:
        size, tier = max(shard.n_bytes, 1), 0
        while size >= self.lowest * self.fanout and size < self.target:
            size, tier = size / self.fanout, tier + 1
        return tier

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """Shards to merge, oldest first: in each tier, runs of at least FANOUT of them, up to the target size."""
        tiers: dict[int, list[Shard]] = {}
        for shard in shards:
            if shard.n_bytes < self.target // 2:
                tiers.setdefault(self.tier(shard), []).append(shard)
        found = []
        for _, waiting in sorted(tiers.items()):
            run: list[Shard] = []
            size = 0
            for shard in waiting:
                if run and size + shard.n_bytes > self.target:
                    found.append(run)
                    run, size = [], 0
                run.append(shard)
                size += shard.n_bytes
            if len(run) >= self.fanout:
                found.append(run)
        return [run for run in found if len(run) > 1]

    def compact(self, text_col: str = "text") -> int:
        """Merge one round of runs and commit; the version is the old one if there was nothing to merge."""
        base = self.version()
        live = self.shards(base)
        runs = self.runs(live)[:MERGES]
        if not runs:
            return base
        self.clean(base)
        schema = self.spark.read.parquet(f"{self.root}/{runs[0][0].name}").schema
        one = lambda run: self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.name}" for s in run]).coalesce(1)
        level = 1 + max(s.level for run in runs for s in run)
        before = self.spark.conf.get(UNITE, None)
        self.spark.conf.set(UNITE, "false")
        try:
            merged = reduce(DataFrame.unionByName, [one(run).withColumn(PART, F.lit(k).cast("long")) for k, run in enumerate(runs)])
            pieces = self._write(merged, level, self._name(base + 1, level), text_col)
        finally:
            self.spark.conf.unset(UNITE) if before is None else self.spark.conf.set(UNITE, before)
        gone = {s.name for run in runs for s in run}
        return self.commit(base, [*(s for s in live if s.name not in gone), *pieces])

    def clean(self, version: int) -> None:
        """Remove the shards that some earlier version names and this one doesn't."""
        live = {s.name for s in self.shards(version)}
        for old in range(version - 1, 0, -1):
            gone = [s.name for s in self.shards(old) if s.name not in live and self.fs.exists(self._path(s.name))]
            if not gone:
                return
            for name in gone:
                self.fs.delete(self._path(name), True)

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version (the current one) with SHARD and LEVEL, which files' paths say, or None without shards."""
        live = self.shards(version)
        if not live:
            return None
        rows, path = self.spark.read.parquet(*[f"{self.root}/{s.name}" for s in live]), F.col("_metadata.file_path")
        return rows.withColumns({SHARD: F.regexp_extract(path, rf"(data/[^/]+/{PART}=\d+)/[^/]+$", 1), LEVEL: F.regexp_extract(path, rf"data/v\d+-l(\d+)-[^/]+/{PART}=\d+/[^/]+$", 1).cast("int")})


def compacted(docs: DataFrame, splits: int = 2, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> Store:
    """A store of docs that arrived as small shards and were compacted until no tier has a run left.

    Every task that reads docs writes ``splits`` of them.
    Null ids and texts and repeated rows are rows like others; an empty table gives a store without shards.
    """
    if clash := {PART, SHARD, LEVEL} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns kept for shards: {sorted(clash)}")
    spark = docs.sparkSession
    space = Workspace(spark, "sharding")
    store = Store(spark, space.path("store"), **sizes)
    store.append(docs, splits, text_col, id_col)
    before = -1
    while (now := store.compact(text_col)) != before:
        before = now
    return store
