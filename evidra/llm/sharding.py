"""A sharded corpus store with size-tiered compaction and a versioned manifest.

Arrivals are appended as small immutable Parquet shards, one per task. ``compact`` takes shards of one size tier (sizes
within a factor of ``fanout``), as soon as there are ``fanout`` of them, and merges runs into files of at most about the
target size; a merge is one task that reads its shards and writes one file, so nothing is shuffled and nothing but shard
names and sizes reaches the driver. A new manifest version names the live shards; it is written under a name of its own
and renamed to ``v<number>``, which fails if another writer has taken that number, so readers see whole versions only.
That holds where a rename does not overwrite, as on HDFS and local disks; a store on an object store needs a file system
client with conditional renames.

Deletion waits: ``vacuum`` removes only what no kept version names and what is older than ``KEEP_SECONDS``, so that readers
of the versions before, and writers whose shards no version names yet, keep their files.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES, SMALLEST_BYTES, FANOUT, MERGES_A_JOB = 128 << 20, 1 << 20, 4, 64
KEEP_VERSIONS, KEEP_SECONDS = 2, 24 * 3600


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


@dataclass(frozen=True)
class Shard:
    name: str  # path of the file, relative to the store
    bytes: int
    level: int  # 0 for an arrival, one more than its highest part for a merged shard


def tier(size: int, smallest: int = SMALLEST_BYTES, fanout: int = FANOUT) -> int:
    """0 up to ``smallest`` bytes, then one more for each factor ``fanout``."""
    return 0 if size <= smallest else math.ceil(math.log(size / smallest, fanout) - 1e-9)


def merges(shards: list[Shard], target: int = TARGET_BYTES, smallest: int = SMALLEST_BYTES, fanout: int = FANOUT) -> list[list[Shard]]:
    """Groups to be merged: in each tier with ``fanout`` shards below the target, runs in order of size whose sum does not
    exceed the target (two shards at least)."""
    tiers: dict[int, list[Shard]] = {}
    for shard in shards:
        if shard.bytes < target:
            tiers.setdefault(tier(shard.bytes, smallest, fanout), []).append(shard)
    groups: list[list[Shard]] = []
    for _, own in sorted(tiers.items()):
        if len(own) < fanout:
            continue
        run: list[Shard] = []
        for shard in sorted(own, key=lambda s: (s.bytes, s.name)):
            if run and sum(s.bytes for s in run) + shard.bytes > target:
                groups.append(run)
                run = []
            run.append(shard)
        groups.append(run)
    return [g for g in groups if len(g) > 1]


class ShardStore:
    """A store at ``path``, a folder that driver and executors share (any file system Spark writes to)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list[tuple[str, int]]:
        at = self._path(f"{self.path}/{folder}")
        if not self._fs.exists(at):
            return []
        return [(f.getPath().getName(), f.getLen()) for f in self._fs.listStatus(at)]

    def version(self) -> int:
        """The last committed version, 0 if there is none."""
        return max([0, *(int(n[1:]) for n, _ in self._list("manifest") if n[0] == "v" and n[1:].isdigit())])

    def manifest(self, version: int | None = None) -> tuple[int, str | None, list[Shard]]:
        """(version, schema as JSON, live shards)."""
        version = self.version() if version is None else version
        if not version:
            return 0, None, []
        found = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest/v{version:08d}", wholetext=True).collect()))
        return version, found["schema"], [Shard(**s) for s in found["shards"]]

    def commit(self, base: int, schema: str | None, shards: list[Shard]) -> int:
        """Commits version ``base`` + 1, or raises Conflict if it exists."""
        folder = self._path(f"{self.path}/manifest")
        self._fs.mkdirs(folder)
        draft, final = self._path(f"{self.path}/manifest/.draft-{uuid.uuid4().hex}"), self._path(f"{self.path}/manifest/v{base + 1:08d}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": base + 1, "schema": schema, "shards": [asdict(s) for s in shards]}, sort_keys=True).encode()))
        out.close()
        if self.version() != base or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {base} is not the last one")
        return base + 1

    def _write(self, rows: DataFrame, level: int) -> list[Shard]:
        run = f"shards/{level:02d}-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{run}")
        return [Shard(f"{run}/{name}", size, level) for name, size in self._list(run) if name.startswith("part-") and size]

    def append(self, rows: DataFrame, retries: int = 20) -> int:
        """Writes ``rows`` as new level-0 shards, one per partition that has rows, and commits them; if another writer was first,
        they go into the version after its own."""
        given, made = rows.schema.json(), None
        for _ in range(retries):
            base, schema, shards = self.manifest()
            if schema is not None and StructType.fromJson(json.loads(schema)) != StructType.fromJson(json.loads(given)):
                raise ValueError("the arrivals have other columns than the store")
            made = self._write(rows, 0) if made is None else made
            try:
                return self.commit(base, given, shards + made)
            except Conflict:
                continue
        raise Conflict(f"{retries} other versions came first")

    def compact(self, target: int = TARGET_BYTES, smallest: int = SMALLEST_BYTES, fanout: int = FANOUT) -> int:
        """Merges until no tier has ``fanout`` shards that fit together; every job's merges are committed at once. Merged shards stay
        until ``vacuum``."""
        while True:
            base, schema, shards = self.manifest()
            groups = merges(shards, target, smallest, fanout)[:MERGES_A_JOB]
            if not groups:
                return base
            kind = StructType.fromJson(json.loads(schema))
            parts = [self.spark.read.schema(kind).parquet(*[f"{self.path}/{s.name}" for s in g]).coalesce(1) for g in groups]
            whole = parts[0]
            for part in parts[1:]:
                whole = whole.union(part)
            made = self._write(whole, 1 + max(s.level for g in groups for s in g))
            gone = {s.name for g in groups for s in g}
            try:
                self.commit(base, schema, [s for s in shards if s.name not in gone] + made)
            except Conflict:  # the merged shards are of a version that is no longer the last: they are left to vacuum
                continue

    def vacuum(self, keep_versions: int = KEEP_VERSIONS, keep_seconds: float = KEEP_SECONDS) -> int:
        """Deletes files that none of the last ``keep_versions`` versions names, and older manifests, if they are more than
        ``keep_seconds`` old; the number of files deleted. A writer that takes longer than that to commit may lose its shards."""
        last, before = self.version(), (time.time() - keep_seconds) * 1000
        live = {s.name for v in range(max(1, last - keep_versions + 1), last + 1) for s in self.manifest(v)[2]}
        gone = 0
        for run, _ in self._list("shards"):
            for file in self._fs.listStatus(self._path(f"{self.path}/shards/{run}")):
                name = file.getPath().getName()
                if name.startswith("part-") and f"shards/{run}/{name}" not in live and file.getModificationTime() < before:
                    self._fs.delete(file.getPath(), False)
                    gone += 1
        for v in range(1, last - keep_versions + 1):
            at = self._path(f"{self.path}/manifest/v{v:08d}")
            if self._fs.exists(at) and self._fs.getFileStatus(at).getModificationTime() < before:
                self._fs.delete(at, False)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, with the columns ``shard`` (name), ``shard_bytes``, ``shard_level`` and ``manifest_version`` behind
        those that were written (which they replace if names clash)."""
        version, schema, shards = self.manifest(version)
        added = ["shard", "shard_bytes", "shard_level", "manifest_version"]
        if schema is None:
            raise ValueError("the store has no version yet")
        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            rows = self.spark.createDataFrame([], kind)
            return rows.drop(*added).withColumns({"shard": F.lit(None).cast("string"), "shard_bytes": F.lit(None).cast("long"), "shard_level": F.lit(None).cast("int"), "manifest_version": F.lit(version)})
        rows = self.spark.read.schema(kind).parquet(*[f"{self.path}/{s.name}" for s in shards])
        name = F.concat_ws("/", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), F.col("_metadata.file_name"))
        level = F.substring(name, 1, 2).cast("int")
        return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in added], name.alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"), level.alias("shard_level"), F.lit(version).alias("manifest_version"))


def sharded(docs: DataFrame, path: str, target: int = TARGET_BYTES) -> DataFrame:
    """Appends ``docs`` to the store at ``path``, compacts it, and returns the rows of the last version (``ShardStore.read``).

    Rows are kept one for one with all their columns and nulls; an empty table commits a version without shards.
    """
    store = ShardStore(docs.sparkSession, path)
    store.append(docs)
    store.compact(target)
    return store.read()
