"""Sharding by size-tiered compaction under a versioned manifest.

A store is a folder. An arrival is appended as the files that Spark's tasks write for it: small shards that never change.
Compaction sorts the shards under half the target size into tiers by powers of `fan_in` of their size; a tier with at least
`fan_in` of them is merged, in the order they came, into shards of up to the target size, and so on with what that makes.
Every row is rewritten at most once a tier. A merge reads its shards one after the other in one task, without a shuffle.

Each change is one manifest with the next number: a file written aside and renamed, which fails if another writer has taken the
number (CommitConflict; read again and retry). Readers see the shards of one manifest; files that no manifest names are ignored,
so lost tasks and failed writers leave no trace, and `vacuum` removes what the newest manifest doesn't name.

Rows are kept as they are: nulls, empty and very long texts, repeated rows and extra columns come back unchanged. An empty
arrival adds no shard; an empty store gives an empty table with the columns of its first arrival.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.staging import new_path

from .common import free_name

TARGET = 128 << 20
BASE = 1 << 20
FAN_IN = 4
#: Merges of one Spark job.
MERGES = 64
ARRIVALS = 4


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, base: int = BASE, fan_in: int = FAN_IN) -> None:
        if fan_in < 2 or target < base or base < 1:
            raise ValueError("need fan_in >= 2 and target >= base >= 1")
        self.spark, self.root, self.target, self.base, self.fan_in = spark, root.rstrip("/"), target, base, fan_in
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    # --- manifests

    def version(self) -> int:
        """Number of the newest manifest; 0 for a new store."""
        folder = self._path("_manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max([int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()], default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"_manifest/{version:08d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, after: int, schema: str | None, shards: list[dict]) -> int:
        jvm = self.spark.sparkContext._jvm
        aside, to = self._path(f"_manifest/.{uuid.uuid4().hex}"), self._path(f"_manifest/{after + 1:08d}.json")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps({"version": after + 1, "schema": schema, "shards": shards}).encode()))
        finally:
            out.close()
        files = self._hadoop.FileContext.getFileContext(aside.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(self._fs.makeQualified(aside), self._fs.makeQualified(to), never)
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                raise CommitConflict(f"version {after + 1} of {self.root} is taken") from e
            raise
        return after + 1

    # --- shards

    def _tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / self.base, self.fan_in) // 1))

    def _written(self, folder: str, version: int) -> list[dict]:
        """Entries for the files of a finished write that have rows."""
        path = f"{self.root}/{folder}"
        rows = dict(self.spark.read.parquet(path).select(_file_name().alias("f")).groupBy("f").count().collect())
        sizes = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(folder))}
        full = sorted(n for n in sizes if rows.get(n))
        return [{"shard": f"{version:08d}-{i:05d}", "file": f"{folder}/{n}", "rows": rows[n], "bytes": sizes[n], "tier": self._tier(sizes[n])} for i, n in enumerate(full)]

    def _check(self, schema: str | None, arrival: DataFrame) -> None:
        if schema is not None and T.StructType.fromJson(json.loads(schema)).simpleString() != arrival.schema.simpleString():
            raise ValueError(f"the store has the columns {T.StructType.fromJson(json.loads(schema)).simpleString()}")

    def append(self, arrival: DataFrame) -> int:
        """Adds an arrival as new shards, one or more for each of its partitions; gives the new version."""
        now = self.manifest()
        self._check(now["schema"], arrival)
        folder = f"data/{uuid.uuid4().hex}"
        arrival.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return self.commit_written(folder, arrival)

    def dealt(self, rows: DataFrame, arrivals: int) -> list[str]:
        """Writes rows once, as the shards of several arrivals (by a hash of doc_id); gives their folders, which nobody reads until
        commit_written names them."""
        self._check(self.manifest()["schema"], rows)
        folder, name = f"data/{uuid.uuid4().hex}", free_name(rows, "arrival")
        own = rows.withColumn(name, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)))
        own.write.option("compression", "zstd").partitionBy(name).parquet(f"{self.root}/{folder}")
        there = {s.getPath().getName() for s in self._fs.listStatus(self._path(folder))}
        return [f"{folder}/{n}" for n in (f"{name}={i}" for i in range(arrivals)) if n in there]

    def commit_written(self, folder: str, like: DataFrame) -> int:
        """Adds the files of a finished write with like's columns as new shards; gives the new version."""
        now = self.manifest()
        self._check(now["schema"], like)
        return self._commit(now["version"], now["schema"] or like.schema.json(), now["shards"] + self._written(folder, now["version"] + 1))

    def _runs(self, shards: list[dict]) -> list[list[dict]]:
        """Which shards are merged next: runs of one tier, each up to the target size."""
        runs: list[list[dict]] = []
        small = [s for s in shards if 2 * s["bytes"] < self.target]
        for tier in sorted({s["tier"] for s in small}):
            own = sorted((s for s in small if s["tier"] == tier), key=lambda s: s["shard"])
            if len(own) < self.fan_in:
                continue
            run: list[dict] = []
            for s in own:
                if run and sum(x["bytes"] for x in run) + s["bytes"] > self.target:
                    runs.append(run)
                    run = []
                run.append(s)
            runs.append(run)
        return [r for r in runs if len(r) > 1]

    def _read(self, schema: str, shards: list[dict]) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*[f"{self.root}/{s['file']}" for s in shards])

    def compact(self) -> int:
        """Merges tier by tier until no tier has fan_in small shards; commits once for every set of merges."""
        while True:
            now = self.manifest()
            runs = self._runs(now["shards"])[:MERGES]
            if not runs:
                return now["version"]
            folder = f"data/{uuid.uuid4().hex}"
            merged = reduce(DataFrame.union, [self._read(now["schema"], run).coalesce(1) for run in runs])
            merged.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
            gone = {s["shard"] for run in runs for s in run}
            new = self._written(folder, now["version"] + 1)
            if sum(s["rows"] for s in new) != sum(s["rows"] for run in runs for s in run):
                raise RuntimeError("a merge changed the number of rows; nothing was committed")
            self._commit(now["version"], now["schema"], [s for s in now["shards"] if s["shard"] not in gone] + new)

    def read(self, version: int | None = None) -> DataFrame:
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError(f"{self.root} has no version yet")
        if not now["shards"]:
            return self.spark.createDataFrame([], T.StructType.fromJson(json.loads(now["schema"])))
        return self._read(now["schema"], now["shards"])

    def vacuum(self, keep: tuple[str, ...] = ()) -> int:
        """Deletes data files that the newest manifest doesn't name and that aren't in the folders to keep, and older manifests;
        gives how many data files went."""
        now = self.manifest()
        named, gone = {s["file"] for s in now["shards"]}, 0
        if not self._fs.exists(self._path("data")):
            return 0
        root = self._fs.makeQualified(self._path("")).toUri().getPath().rstrip("/") + "/"
        files = self._fs.listFiles(self._path("data"), True)
        while files.hasNext():
            path = files.next().getPath()
            name = path.toUri().getPath().removeprefix(root)
            if name not in named and not name.startswith(tuple(f"{k}/" for k in keep)):
                self._fs.delete(path, False)
                gone += name.endswith(".parquet")
        for s in self._fs.listStatus(self._path("_manifest")):
            if s.getPath().getName() != f"{now['version']:08d}.json":
                self._fs.delete(s.getPath(), False)
        return gone

    def placed(self) -> DataFrame:
        """Every row's doc_id with its shard in the newest version: shard, tier, shard_rows, shard_bytes, version."""
        now = self.manifest()
        schema = "file_name string, shard string, tier int, shard_rows long, shard_bytes long, version long"
        named = [("/".join(s["file"].split("/")[-2:]), s["shard"], s["tier"], s["rows"], s["bytes"], now["version"]) for s in now["shards"]]
        rows = self.read().select("doc_id", _file_name(2).alias("file_name"))
        return rows.join(self.spark.createDataFrame(named, schema), "file_name").drop("file_name")


def _file_name(parts: int = 1) -> Column:
    """The last parts of the path of a row's file."""
    return F.substring_index(F.input_file_name(), "/", -parts)


def sharded(docs: DataFrame, root: str, arrivals: int = ARRIVALS, target: int = TARGET, base: int = BASE, fan_in: int = FAN_IN) -> ShardStore:
    """A store at root with the rows of docs, in arrivals dealt by a hash of doc_id and compacted after each. docs is read once."""
    store = ShardStore(docs.sparkSession, root, target, base, fan_in)
    folders = store.dealt(docs, arrivals)
    if not folders:
        store.append(docs.limit(0))
    for i, folder in enumerate(folders):
        store.commit_written(folder, docs)
        store.compact()
        store.vacuum(tuple(folders[i + 1 :]))
    return store


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sharded(docs, new_path(spark, "shards")).placed()
