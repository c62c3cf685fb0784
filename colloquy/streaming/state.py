"""Time and state: answers kept for a while, daily quotas and minimum gaps, on tables and on streams."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPLETE_SECONDS, FAILED_SECONDS, SOURCE_SECONDS, REVIEW_SECONDS = 24 * 3600, 30, 3600, 7 * 24 * 3600
MOST_ENTRIES = 32
MOST_ENTRY_BYTES, MOST_SOURCE_BYTES = 2_000_000, 12_000_000


def expires(at: Column, complete: Column, seconds: int = COMPLETE_SECONDS, failed_seconds: int = FAILED_SECONDS) -> Column:
    """A complete result is kept long, a failed or partial one shortly."""
    return F.timestamp_micros(F.unix_micros(at.cast("timestamp")) + F.when(complete, F.lit(seconds)).otherwise(F.lit(failed_seconds)).cast("long") * 1_000_000)


def cacheable(expected: Column, completed: Column, uncertain: Column) -> Column:
    """A review is kept only if every row is there, valid and settled."""
    return (expected == completed) & (uncertain == 0)


def ttl_lookup(probes: DataFrame, entries: DataFrame, key: str, at: str, stored: str, seconds: int, value: str) -> DataFrame:
    """probes with hit: value of the newest entry of their key stored at or before `at`, unless it is older than `seconds`; else null.

    Both are sorted together by key and time in one shuffle; no probe is joined with all entries of its key.
    """
    a = entries.select(F.col(key).alias("_k"), F.col(stored).alias("_t"), F.lit(0).alias("_probe"), F.struct(F.col(stored).alias("t"), F.col(value).alias("v")).alias("_e"), F.lit(None).cast(probes.select(F.struct("*")).schema[0].dataType).alias("_row"))
    b = probes.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_probe"), F.lit(None).cast(a.schema["_e"].dataType).alias("_e"), F.struct("*").alias("_row"))
    last = F.last("_e", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_t", "_probe").rowsBetween(Window.unboundedPreceding, 0))
    both = a.unionByName(b).withColumn("_e", last).where("_probe = 1")
    fresh = F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(F.col("_e.t").cast("timestamp")) < F.lit(seconds * 1_000_000)
    return both.select("_row.*", F.when(fresh, F.col("_e.v")).alias("hit"))


def evict(entries: DataFrame, order: list[str], most: int = MOST_ENTRIES, size: str | None = None, most_bytes: int = MOST_SOURCE_BYTES, most_entry: int = MOST_ENTRY_BYTES) -> DataFrame:
    """The newest entries that fit in: by number, and if size names a column by bytes as well. A cache is small by its limits."""
    own = entries.where(F.col(size) <= most_entry) if size else entries
    own = own.orderBy(*[F.desc(c) for c in order]).limit(most)
    if size:
        upto = Window.orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
        own = own.withColumn("_sum", F.sum(size).over(upto)).where(F.col("_sum") <= most_bytes).drop("_sum")
    return own


def cached(spark_entries: DataFrame | None, key: str, now: datetime, compute: Callable[[], DataFrame]) -> DataFrame:
    """The stored rows of a key that haven't expired, else what compute gives. spark_entries: key, expires_at and the result."""
    if spark_entries is not None:
        own = spark_entries.where((F.col("key") == key) & (F.col("expires_at") > F.lit(now)))
        if not own.isEmpty():
            return own.drop("key", "expires_at")
    return compute()


def daily_quota(events: DataFrame, ts: str, cost: Column, quota: int, order: list[str], key: list[str] | None = None) -> DataFrame:
    """events with day, used (of the day, itself included) and allowed: within the day's quota. Days begin at midnight UTC."""
    own = events.withColumn("day", F.to_date(ts))
    run = Window.partitionBy(*(key or []), "day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("used", F.sum(cost).over(run)).withColumn("allowed", F.col("used") <= quota)


def next_reset(at: Column) -> Column:
    return F.date_trunc("day", at) + F.expr("INTERVAL 1 DAY")


def paused_until(marks: DataFrame, now: datetime, kind: str = "verified_quota") -> datetime | None:
    """The midnight until which an exhausted quota that was observed today pauses requests; only verified marks count."""
    row = marks.where(F.col("kind") == kind).agg(F.max(next_reset(F.col("at"))).alias("until")).first()
    return row["until"] if row["until"] and row["until"] > now else None


def gap_ok(events: DataFrame, key: list[str], ts: str, order: list[str], seconds: float = 3) -> DataFrame:
    """events with gap_us (since the one before) and spaced: the first, or so many seconds after the one before."""
    before = F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(Window.partitionBy(*key).orderBy(*order))
    own = events.withColumn("gap_us", F.unix_micros(F.col(ts).cast("timestamp")) - before)
    return own.withColumn("spaced", F.coalesce(F.col("gap_us") >= int(seconds * 1_000_000), F.lit(True)))


# --- streams ---------------------------------------------------------------------------------------


def stream_daily_usage(stream: DataFrame, ts: str, cost: Column, quota: int, late: str = "1 hour") -> DataFrame:
    """Usage by UTC day and whether it is exhausted, from a stream of events; days close `late` after their end."""
    own = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    per = own.groupBy(F.window("_ts", "1 day").alias("day")).agg(F.sum(cost).alias("used"))
    return per.select(F.col("day.start").alias("day"), "used", (F.col("used") >= quota).alias("exhausted"))


def stream_in_flight(stream: DataFrame, ts: str, key: str, within: str = "30 seconds") -> DataFrame:
    """Requests without those that repeat a key while it is in flight: state is dropped as the watermark passes."""
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", within).dropDuplicatesWithinWatermark([key]).drop("_ts")


def stream_sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key: begin, end and number of events."""
    own = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    per = own.groupBy(key, F.session_window("_ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return per.select(key, F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "n")
