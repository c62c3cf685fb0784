"""Stored caches in a shared folder: results of whole searches, scans of a corpus, and reviewers' answers.

What is kept is written as Parquet first; a committed log (`commits.CommitLog`) then names it, so readers see an entry whole or not at
all, writers that race are put one after the other and lose nothing, and what a dead writer left is never read. `now` is a parameter
everywhere. Times in logs are microseconds since 1970 in UTC.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.commits import CommitLog
from colloquy.staging import staged
from colloquy.streaming.state import COMPLETE_SECONDS, FAILED_SECONDS, MOST_ENTRIES, MOST_ENTRY_BYTES, MOST_SOURCE_BYTES, REVIEW_SECONDS, SOURCE_SECONDS


def micros(at: datetime) -> int:
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def midnight_after(now: int) -> int:
    day = 24 * 3600 * 1_000_000
    return (now // day + 1) * day


def key_of(*parts: object) -> str:
    """A key of everything that a result depends on, in its order."""
    return sha256(json.dumps(parts, ensure_ascii=False, sort_keys=True, default=str).encode()).hexdigest()


class _Entries:
    """Entries in the order in which they came, in one document of a log; each names the folder of its rows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, self.root)

    def entries(self) -> list[dict]:
        return self.log.read()[1].get("entries", [])

    def _live(self, key: str, now: int) -> dict | None:
        return next((e for e in self.entries() if e["key"] == key and e["until"] > now), None)

    def _rows(self, entry: dict) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(f"{self.root}/{entry['folder']}")

    def _written(self, rows: DataFrame) -> tuple[str, int]:
        """Folder of the rows and the bytes that they are counted as: two for each character of their JSON."""
        folder, seen = uuid.uuid4().hex, Observation()
        size = F.sum(F.length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})))
        rows.observe(seen, F.coalesce(size, F.lit(0)).alias("chars")).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return folder, 2 * int(seen.get["chars"] or 0)

    def vacuum(self) -> int:
        """Deletes folders that no entry names, and older versions of the log. Writers must not be at work meanwhile."""
        self.log.forget()
        named, gone = {e["folder"] for e in self.entries()}, 0
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for s in fs.listStatus(path) if fs.exists(path) else []:
            if s.isDirectory() and s.getPath().getName() not in {*named, "_log"}:
                gone += fs.delete(s.getPath(), True)
        return gone


class ResultCache(_Entries):
    """Results of searches: a complete one is kept for a day, a failed or partial one for half a minute, MOST_ENTRIES at most.

    Where it is full the entry that came first goes, and an entry that is put again keeps its place, whether or not it has expired.
    """

    def __init__(self, spark: SparkSession, root: str, most: int = MOST_ENTRIES) -> None:
        super().__init__(spark, root)
        self.most = most

    def get(self, key: str, now: datetime) -> DataFrame | None:
        entry = self._live(key, micros(now))
        return self._rows(entry) if entry else None

    def put(self, key: str, rows: DataFrame, complete: bool, now: datetime, quota_exhausted: bool = False) -> None:
        at, (folder, size) = micros(now), self._written(rows)
        until = at + (COMPLETE_SECONDS if complete else FAILED_SECONDS) * 1_000_000
        until = min(until, midnight_after(at)) if quota_exhausted else until
        new = {"key": key, "folder": folder, "until": until, "bytes": size, "schema": rows.schema.jsonValue()}

        def change(now: dict) -> dict:
            own = now.get("entries", [])
            own = own[1:] if len(own) >= self.most else own
            return {"entries": [new if e["key"] == key else e for e in own] if any(e["key"] == key for e in own) else [*own, new]}

        self.log.update(change)

    def through(self, key: str, now: datetime, make: Callable[[], tuple[DataFrame, bool]]) -> tuple[DataFrame, bool]:
        """(rows, were they there?): those kept, or else what make gives (rows, complete), which are then kept."""
        found = self.get(key, now)
        if found is not None:
            return found, True
        rows, complete = make()
        rows = staged(rows)
        self.put(key, rows, complete, now)
        return rows, False


class SourceCache(_Entries):
    """Scans of a corpus for an hour: at most MOST_ENTRIES, of MOST_ENTRY_BYTES each and MOST_SOURCE_BYTES together; the first go first.

    corpus names what is scanned, with its version; it is part of every key.
    """

    def __init__(self, spark: SparkSession, root: str, corpus: str, clock: Callable[[], datetime] = lambda: datetime.now(UTC), most: int = MOST_ENTRIES, most_entry: int = MOST_ENTRY_BYTES, most_bytes: int = MOST_SOURCE_BYTES) -> None:
        super().__init__(spark, root)
        self.corpus, self.clock, self.most, self.most_entry, self.most_bytes = corpus, clock, most, most_entry, most_bytes
        self.hits = self.misses = 0

    def scan(self, asked: tuple, make: Callable[[], tuple[DataFrame, bool, int]]) -> tuple[DataFrame, bool, int]:
        """(rows, truncated, hits) of a scan with these parameters, as kept or as make gives it."""
        key, now = key_of(self.corpus, *asked), micros(self.clock())
        entry = self._live(key, now)
        if entry:
            self.hits += 1
            return self._rows(entry), entry["truncated"], entry["found"]
        self.misses += 1
        rows, truncated, found = make()
        folder, size = self._written(rows)
        if size <= self.most_entry:
            new = {"key": key, "folder": folder, "until": now + SOURCE_SECONDS * 1_000_000, "bytes": size, "schema": rows.schema.jsonValue(), "truncated": truncated, "found": found}

            def change(doc: dict) -> dict:
                own = [e for e in doc.get("entries", []) if e["key"] != key]
                while own and (len(own) >= self.most or sum(e["bytes"] for e in own) + size > self.most_bytes):
                    own = own[1:]
                return {"entries": [*own, new]}

            self.log.update(change)
        return rows, truncated, found


@dataclass(frozen=True)
class ReviewIdentity:
    """What a reviewer's answer depends on besides its input."""

    model: str
    instructions: str
    schema: str
    max_tokens: int = 3072
    effort: str = "default"
    contract: str = "reviews-from-cited-parts-1"
    settings: tuple[str, ...] = ("temperature=0",)

    def key(self, canonical: Column) -> Column:
        """The address of an answer: a digest of all of this and the input as text."""
        own = [self.contract, self.model, *self.settings, self.max_tokens, self.effort, self.instructions, self.schema]
        return F.sha2(F.concat(F.lit(json.dumps(own, ensure_ascii=False)), F.lit("\n"), canonical), 256)


def canonical_input(candidates: DataFrame, batch: str, columns: list[str], order: str) -> DataFrame:
    """(batch, input): a batch's candidates as JSON, in order, with their fields in the given order and nulls said."""
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    rows = candidates.select(F.col(batch).alias("batch"), F.col(order).alias("_ord"), row.alias("_row"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_ord", "_row"))), lambda r: r["_row"])
    return rows.groupBy("batch").agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("input"))


class ReviewCache:
    """Reviewers' answers by the content that they are about, for seven days.

    Only answers that `reusable` names are added: batches of which every row came back, is valid and settled. Batches with one input
    are asked about once. Entries are parts of a table, one for each addition; the log names those that haven't expired.
    """

    _SCHEMA = "key string, response string, until long"

    def __init__(self, spark: SparkSession, root: str, seconds: int = REVIEW_SECONDS) -> None:
        self.spark, self.root, self.seconds = spark, root.rstrip("/"), seconds
        self.log = CommitLog(spark, self.root)

    def known(self, now: datetime) -> DataFrame:
        """(key, response) of entries that haven't expired; of several with one key the newest. Times too far ahead don't count."""
        at = micros(now)
        parts = [f"{self.root}/{p['folder']}" for p in self.log.read()[1].get("parts", []) if p["until"] > at]
        own = self.spark.read.schema(self._SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], self._SCHEMA)
        own = own.where((F.col("until") > at) & (F.col("until") <= at + self.seconds * 1_000_000))
        return own.groupBy("key").agg(F.max_by("response", F.struct("until", "response")).alias("response"))

    def add(self, answers: DataFrame, now: datetime) -> None:
        """Keeps answers (key, response)."""
        at, folder = micros(now), uuid.uuid4().hex
        until = at + self.seconds * 1_000_000
        own = answers.select("key", "response", F.lit(until).alias("until"))
        own.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        self.log.update(lambda doc: {"parts": [*(p for p in doc.get("parts", []) if p["until"] > at), {"folder": folder, "until": until}]})

    def through(self, inputs: DataFrame, identity: ReviewIdentity, ask: Callable[[DataFrame], DataFrame], reusable: Callable[[DataFrame], DataFrame], now: datetime) -> DataFrame:
        """(batch, response, cache_hit) for inputs (batch, input).

        ask gets the batches that no entry answers, (batch, input), and gives (batch, response); reusable gets all that is answered
        anew, (batch, response), and gives the batches (batch) that may be kept. A batch without an answer is left out.
        """
        keyed = staged(inputs.select("batch", "input", identity.key(F.col("input")).alias("key")))
        wanted = keyed.select("key").distinct()
        kept = staged(self.known(now).join(wanted, "key", "left_semi"))
        unseen = keyed.join(kept.select("key"), "key", "left_anti")
        first = staged(unseen.groupBy("key").agg(F.min_by(F.struct("batch", "input"), "batch").alias("b")).select("key", "b.batch", "b.input"))
        out = keyed.select("batch", "key").join(kept, "key").withColumn("cache_hit", F.lit(True))
        if first.isEmpty():
            return out.select("batch", "response", "cache_hit")
        answered = staged(ask(first.select("batch", "input")).select("batch", "response"))
        fresh = staged(first.select("key", "batch").join(answered, "batch").select("key", "response", F.col("batch").alias("asked")))
        good = reusable(fresh.select(F.col("asked").alias("batch"), "response")).select(F.col("batch").alias("asked")).distinct()
        self.add(fresh.join(good, "asked", "left_semi").select("key", "response"), now)
        again = keyed.select("batch", "key").join(fresh.select("key", "response"), "key").withColumn("cache_hit", F.lit(False))
        return out.unionByName(again).select("batch", "response", "cache_hit")


def reusable_batches(candidates: DataFrame, read: DataFrame, checked: DataFrame) -> DataFrame:
    """Batches (batch) of which exactly the candidates came back, each row valid and none uncertain.

    candidates: (batch, id); read and checked: what `verdicts.read_reviews` and `verdicts.checked_rows` give of the answers.
    """
    size = candidates.select("batch", "id").distinct().groupBy("batch").agg(F.count("*").alias("expected"))
    back = read.where("readable").select("batch", F.size("reviews").alias("returned"))
    bad = F.count_if(F.col("reason").isNotNull() | F.coalesce(F.col("said") == "uncertain", F.lit(True)))
    rows = checked.groupBy("batch").agg(F.count("*").alias("rows"), bad.alias("bad"))
    own = size.join(back, "batch").join(rows, "batch")
    return own.where("returned = expected and rows = expected and bad = 0").select("batch")
