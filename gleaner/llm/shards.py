"""Sharding: small immutable arrivals, size-tiered compaction, versioned manifests.

A store is a folder with ``data/`` (immutable Parquet files, never changed once
written) and ``manifests/`` (one JSON file per version).  Arrivals are written
as they come, one shard for each task.  Compaction sorts live shards into tiers
by size (each tier ``fan_in`` times the one below), and where a tier has at
least ``fan_in`` shards merges runs of them into shards of up to ``target``
bytes.  A version becomes visible by one step: its manifest is written under a
temporary name and renamed to ``v<number>.json`` by a rename that fails if the
target exists (one atomic operation of HDFS; a store without one needs a single
writer).  Whoever loses such a race rebases: an arrival is added to the newer
version, a compaction keeps the merges whose inputs the newer version still has.
Readers go by a manifest alone, so a job that dies leaves files that no manifest
names and nothing else; ``vacuum`` deletes such files only after a grace period,
for they may belong to a writer that has not committed yet.
"""

from __future__ import annotations

import json
import math
import random
import re
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession

TARGET_BYTES = 128 << 20
FAN_IN = 4
RUNS_PER_JOB = 32
ATTEMPTS = 20  # to commit, while other writers come first
GRACE_SECONDS = 24 * 3600.0
LOT = "__lot"


@dataclass(frozen=True)
class Shard:
    path: str  # relative to the store
    bytes: int
    version: int  # that added it
    merges: int  # how often its rows have been rewritten


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    """All file operations go through Hadoop's file system, so any path Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(self._path("")).toUri(), conf)
        self.no_options = spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _list(self, name: str) -> list[tuple[str, int, float]]:
        """Names, sizes and times of last change."""
        path = self._path(name)
        if not self.fs.exists(path):
            return []
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime() / 1000) for s in self.fs.listStatus(path))

    # manifests

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n, *_ in self._list("manifests") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """A version's number and shards; (0, none) for an empty store."""
        version = max(self.versions(), default=0) if version is None else version
        if version == 0:
            return 0, []
        stream = self.fs.open(self._path(f"manifests/v{version:08d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, [Shard(**s) for s in json.loads(text)["shards"]]

    def commit(self, after: int, shards: list[Shard]) -> int:
        """Publish version ``after + 1``; ``Conflict`` if it exists already."""
        version = after + 1
        final = self._path(f"manifests/v{version:08d}.json")
        draft = self._path(f"manifests/.draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"version": version, "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            out.close()
        try:
            self.context.rename(draft, final, self.no_options)
        except Py4JJavaError as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise Conflict(f"version {version} exists") from None
            raise
        return version

    def _commit(self, change: Callable[[int, list[Shard]], list[Shard]]) -> int:
        """Publish ``change`` of the last version, of a newer one where another writer came first."""
        for attempt in range(ATTEMPTS):
            version, shards = self.manifest()
            try:
                return self.commit(version, change(version + 1, shards))
            except Conflict:
                time.sleep(random.uniform(0, 0.05 * (attempt + 1)))
        raise Conflict(f"{ATTEMPTS} attempts lost to other writers")

    # data

    def _files(self, folder: str) -> list[tuple[str, int, float]]:
        """Data files below a folder, by path relative to the store."""
        found = []
        for name, size, changed in self._list(folder):
            if name.startswith("part-"):
                found.append((f"{folder}/{name}", size, changed))
            elif name.startswith(f"{LOT}="):
                found += self._files(f"{folder}/{name}")
        return found

    def _write(self, df: DataFrame, label: str, *by: str) -> list[tuple[str, int]]:
        folder = f"data/{label}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").partitionBy(*by).parquet(f"{self.root}/{folder}")
        return [(path, size) for path, size, _ in self._files(folder)]

    def _add(self, written: list[tuple[str, int]]) -> int:
        return self._commit(lambda version, shards: [*shards, *(Shard(p, size, version, 0) for p, size in written)])

    def append(self, arrivals: DataFrame) -> int:
        """Write the rows as small shards, one for each task, and commit; an empty arrival adds at most an empty shard."""
        return self._add(self._write(arrivals, "arrival"))

    def append_lots(self, arrivals: DataFrame, lot: Column) -> list[int]:
        """Several arrivals in one pass over the rows, one version for each value of ``lot`` (a number), in order."""
        lots: dict[str, list[tuple[str, int]]] = {}
        for path, size in self._write(arrivals.withColumn(LOT, lot), "arrival", LOT):
            lots.setdefault(path.split("/")[-2].split("=")[1], []).append((path, size))
        return [self._add(written) for _, written in sorted(lots.items(), key=lambda x: (not x[0].isdigit(), x[0].zfill(20)))]

    def tier(self, size: int, base: int, fan_in: int) -> int:
        return 0 if size <= base else math.ceil(math.log(size / base, fan_in))

    def plan(self, shards: list[Shard], target: int, fan_in: int, base: int) -> list[list[Shard]]:
        """Runs to merge: within a tier of ``fan_in`` or more shards, by size, as many as fit ``target``."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < target * 3 // 4:
                tiers.setdefault(self.tier(s.bytes, base, fan_in), []).append(s)
        runs: list[list[Shard]] = []
        for _, members in sorted(tiers.items()):
            if len(members) < fan_in:
                continue
            run: list[Shard] = []
            for s in sorted(members, key=lambda m: (m.bytes, m.path)):
                if run and sum(m.bytes for m in run) + s.bytes > target:
                    runs.append(run)
                    run = []
                run.append(s)
            runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN, base: int = 1 << 20, max_rounds: int = 32) -> int:
        """Merge until no tier has a run to merge; each round is one version.  Returns the last version.

        A run is read, coalesced to one task and written as one file: no
        shuffle.  Runs of a round go in jobs of ``RUNS_PER_JOB``.  Shards that
        arrive meanwhile stay; a merge of shards that another compaction has
        replaced meanwhile is left out.
        """
        version, shards = self.manifest()
        for _ in range(max_rounds):
            runs = self.plan(shards, target, fan_in, base)
            if not runs:
                break
            merged: list[tuple[list[Shard], list[tuple[str, int]]]] = []
            for start in range(0, len(runs), RUNS_PER_JOB):
                part = runs[start : start + RUNS_PER_JOB]
                frames = [self._read(r).coalesce(1) for r in part]
                written: list[list[tuple[str, int]]] = [[] for _ in part]
                for path, size in self._write(reduce(DataFrame.unionAll, frames), "merged"):
                    written[int(re.search(r"part-(\d+)", path)[1])].append((path, size))  # one task, so one number, for each run
                merged += zip(part, written, strict=True)

            def replaced(version: int, now: list[Shard], merged=merged) -> list[Shard]:
                live = {s.path for s in now}
                valid = [(run, files) for run, files in merged if all(s.path in live for s in run)]
                gone = {s.path for run, _ in valid for s in run}
                added = [Shard(p, size, version, 1 + max(s.merges for s in run)) for run, files in valid for p, size in files]
                return [*(s for s in now if s.path not in gone), *added]

            version = self._commit(replaced)
            shards = self.manifest(version)[1]
        return version

    def _read(self, shards: list[Shard]) -> DataFrame:
        paths = [f"{self.root}/{s.path}" for s in shards]
        return self.spark.read.schema(self.schema()).parquet(*paths)

    def schema(self):
        if not hasattr(self, "_schema"):
            _, shards = self.manifest()
            self._schema = self.spark.read.parquet(f"{self.root}/{shards[0].path}").schema
        return self._schema

    def read(self, version: int | None = None) -> DataFrame | None:
        """A version's rows; none for an empty store."""
        _, shards = self.manifest(version)
        return self._read(shards) if shards else None

    def vacuum(self, keep_versions: int = 1, grace_seconds: float = GRACE_SECONDS) -> int:
        """Delete data that none of the last ``keep_versions`` manifests names, and older manifests.

        Files younger than ``grace_seconds`` stay: a writer may be about to name
        them.  Readers of a version have as long from when it was replaced, if
        ``keep_versions`` covers what they read.  Pass 0 only where nothing else
        writes.
        """
        before = time.time() - grace_seconds  # taken first: what is committed from here on is younger
        versions = self.versions()
        kept = versions[-keep_versions:]
        live = {s.path for v in kept for s in self.manifest(v)[1]}
        gone = 0
        for folder, *_ in self._list("data"):
            files = self._files(f"data/{folder}")
            dead = [path for path, _, changed in files if path not in live and changed <= before]
            with ThreadPoolExecutor(8) as pool:
                list(pool.map(lambda path: self.fs.delete(self._path(path), False), dead))
            gone += len(dead)
            if files and len(dead) == len(files):
                self.fs.delete(self._path(f"data/{folder}"), True)
        for name, _, changed in self._list("manifests"):
            if name.startswith(".draft-") and changed <= before:
                self.fs.delete(self._path(f"manifests/{name}"), False)
        for v in versions[: -keep_versions or None]:
            self.fs.delete(self._path(f"manifests/v{v:08d}.json"), False)
        return gone
