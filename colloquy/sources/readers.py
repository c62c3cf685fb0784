"""Readers: corpora of turns and the scans over them, JSON exports of meetings and laws, labelled pairs.

A corpus is a table of turns or a written index of one (`grams.GramIndex`); scans of either give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from colloquy import schema
from colloquy.caches import SourceCache
from colloquy.functions.text import normalize
from colloquy.sources.grams import GramIndex
from colloquy.sources.sinks import CSV
from colloquy.staging import staged

SPEECHES, MEETINGS = 100, 10


@dataclass(frozen=True)
class Scan:
    """Rows of a scan, whether there were more, and how many."""

    rows: DataFrame
    truncated: bool
    hits: int


def read_meetings(spark: SparkSession, path: str) -> DataFrame:
    """Turns from JSON meetings (one a line, or arrays); the order in a meeting is kept in ord."""
    return flatten_meetings(spark.read.schema(schema.MEETINGS_JSON).json(path))


def flatten_meetings(meetings: DataFrame) -> DataFrame:
    own = meetings.select("issueID", "date", "nameOfMeeting", F.posexplode("speechRecord").alias("ord", "s"))
    return own.select(
        F.col("issueID").alias("issue_id"), F.col("s.speechID").alias("speech_id"), F.col("s.speechOrder").try_cast("int").alias("speech_order"), "date",
        F.col("nameOfMeeting").alias("meeting"), F.col("s.speaker").alias("speaker"), F.col("s.speakerGroup").alias("speaker_group"), F.col("s.speakerPosition").alias("speaker_position"),
        F.col("s.speakerRole").alias("speaker_role"), F.col("s.speech").alias("speech"), F.col("s.speechURL").alias("speech_url"), F.col("ord").cast("long").alias("ord"),
    )


def read_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """What sinks.write_csv wrote; values may hold line ends and quotes. Missing and empty values are null."""
    return spark.read.options(header=True, multiLine=True, encoding="UTF-8", **CSV).schema(columns).csv(path)


def read_labeled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.LABELED).json(path)


def read_laws(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.LAWS_JSON).json(path)


def has_all(text: Column, query: str) -> Column:
    """All words of a query, wherever they stand."""
    out = F.lit(True)
    for word in query.split():
        out = out & F.contains(text, F.lit(word))
    return out


def between(date: Column, since: str | None, until: str | None) -> Column:
    out = F.lit(True)
    if since:
        out = out & (date >= since)
    if until:
        out = out & (date <= until)
    return out


def newest(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The newest rows: top-k in each task, then of these."""
    return rows.orderBy(*order).limit(limit)


def _through(cache: SourceCache, asked: tuple, make: Callable[[], Scan]) -> Scan:
    def plain() -> tuple[DataFrame, bool, int]:
        scan = make()
        return scan.rows, scan.truncated, scan.hits

    return Scan(*cache.scan(asked, plain))


def scan_turns(turns: DataFrame | GramIndex, query: str, since: str | None = None, until: str | None = None, limit: int = SPEECHES, excluded: list[str] | None = None, cache: SourceCache | None = None) -> Scan:
    """The newest turns that hold all words of a query; a filter on a range of dates reaches the files.

    The corpus is read once: hits are counted as they pass, and the rows kept are written. Hits count before meetings are
    excluded, and a scan's limit applies to what is left, so a scan isn't used up by meetings that are known. A cache is asked first.
    """
    if cache is not None:
        return _through(cache, ("turns", query, since, until, limit, sorted(excluded or [])), lambda: scan_turns(turns, query, since, until, limit, excluded))
    turns = turns.turns_with(query, since, until) if isinstance(turns, GramIndex) else turns
    hits, seen = turns.where(between(F.col("date"), since, until)).where(has_all(F.col("speech"), query)), Observation()
    hits = hits.observe(seen, F.count(F.lit(1)).alias("n"))
    if excluded:
        hits = hits.where(~F.coalesce(F.col("issue_id").isin(excluded), F.lit(False)))
    rows = staged(newest(hits, [F.desc("date"), F.asc("issue_id"), F.asc("ord")], limit))
    n = seen.get["n"]
    return Scan(rows, n > limit, n)


def scan_meetings(turns: DataFrame | GramIndex, query: str, since: str | None = None, until: str | None = None, limit: int = MEETINGS, meetings: list[str] | None = None, excluded: list[str] | None = None, cache: SourceCache | None = None) -> Scan:
    """All turns of the newest meetings of which a turn holds all words of a query.

    The names of the meetings (at most `limit`) come first, so that the second pass is a filter that reaches the files. A cache is asked first.
    """
    if cache is not None:
        return _through(cache, ("meetings", query, since, until, limit, sorted(meetings or []), sorted(excluded or [])), lambda: scan_meetings(turns, query, since, until, limit, meetings, excluded))

    def within(rows: DataFrame) -> DataFrame:
        own = rows.where(between(F.col("date"), since, until))
        return own.where(F.col("meeting").isin(meetings)) if meetings else own

    indexed = isinstance(turns, GramIndex)
    hit, seen = within(turns.turns_with(query, since, until) if indexed else turns).where(has_all(F.col("speech"), query)).groupBy("issue_id").agg(F.max("date").alias("_date")), Observation()
    hit = hit.observe(seen, F.count(F.lit(1)).alias("n"))
    if excluded:
        hit = hit.where(~F.coalesce(F.col("issue_id").isin(excluded), F.lit(False)))
    kept = [r["issue_id"] for r in newest(hit, [F.desc("_date"), F.asc("issue_id")], limit).collect()]
    n = seen.get["n"]
    named = F.col("issue_id").isin([i for i in kept if i is not None])
    own = turns.meeting_turns(kept) if indexed else turns
    return Scan(staged(within(own).where(named | F.col("issue_id").isNull() if None in kept else named)), n > limit, n)


def meetings_by_id(turns: DataFrame | GramIndex, ids: list[str]) -> DataFrame:
    return turns.meeting_turns(ids) if isinstance(turns, GramIndex) else turns.where(F.col("issue_id").isin(ids))


def valid_term(term: str, name: str = "") -> bool:
    return 2 <= len(term) <= 80 and len(name) <= 30


def normalized_turns(turns: DataFrame) -> DataFrame:
    """turns with speech in normal form, to be written once and read by all queries (then nfkc=False holds)."""
    return turns.withColumn("speech", normalize(F.col("speech")))
