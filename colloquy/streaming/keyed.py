"""Rules with a memory for each key, on tables and on streams: requests in flight, daily quotas that pause, minimum gaps.

A rule is a step: (memory, event) to rows, for the events of a key in order of time and then of a number that names the event. On a
table the rows of a key are sorted within a partition and pass one by one, so a task holds one key's memory at a time. On a stream
(Spark's arbitrary stateful processing, `transformWithState`) a key's events wait in its state until the watermark has passed them and
are then taken in the same order, so the rows are those of the table, however late within the watermark events arrive. An event that
comes later than that is dropped, as Spark drops it; it changes nothing. Memories are of fixed size.

Streams need the RocksDB state store: spark.sql.streaming.stateStore.providerClass. Nulls: a null key is a key; events without a time
are left out. Repeated events are events of their own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

MOST_IN_FLIGHT, ANSWER_SECONDS = 2, 120
VERIFIED = "verified_quota"
DAY_US = 24 * 3600 * 1_000_000

Step = Callable[[dict, dict], list[tuple]]


# --- rules -------------------------------------------------------------------------------------------


def gap_step(memory: dict, event: dict, seconds: float) -> list[tuple]:
    """Was an event the first, or so many seconds after the one before?"""
    last, memory["last"] = memory.get("last"), event["us"]
    gap = event["us"] - last if last is not None else None
    return [(event["id"], gap, gap is None or gap >= int(seconds * 1_000_000))]


GAPS = "id long, gap_us long, spaced boolean"


def quota_step(memory: dict, event: dict, quota: float) -> list[tuple]:
    """An event's use of its UTC day and whether the day still allows it.

    A mark of the verified kind says that the quota was found exhausted: nothing is allowed until midnight, when the mark ends by
    itself. Other kinds of marks say nothing. Marks use nothing and give no row; an event that isn't allowed counts as used, as in the table's rule.
    """
    day = event["us"] // DAY_US
    if memory.get("day") != day:
        memory.update(day=day, used=0, paused=False)
    if event["kind"] is not None:
        memory["paused"] = memory["paused"] or event["kind"] == VERIFIED
        return []
    memory["used"] += event["cost"] or 0
    until = (day + 1) * DAY_US if memory["paused"] else None
    return [(event["id"], memory["used"], not memory["paused"] and memory["used"] <= quota, until)]


QUOTAS = "id long, used double, allowed boolean, paused_until_us long"


def flight_step(memory: dict, event: dict, most: int, seconds: float) -> list[tuple]:
    """Requests for a thing that is already being worked out share its answer; with `most` different things in flight others are refused.

    kind: ask, done or failed. A request leads if its thing isn't in flight, and follows if it is. done and failed end the flight of
    their thing; one that has had no end for so many seconds has crashed, and its place is free from then on. Rows: (id, thing,
    outcome, leader, followers); outcome is lead, follow, refused, answered, failed, or crashed (told with the next event), and the
    last three carry how many followed. An end without a flight gives no row.
    """
    flights, out = memory.setdefault("flights", []), []
    for f in [f for f in flights if f[3] <= event["us"]]:
        out.append((event["id"], f[0], "crashed", f[1], f[2]))
        flights.remove(f)
    own = next((f for f in flights if f[0] == event["thing"]), None)
    if event["kind"] in ("done", "failed"):
        if own:
            flights.remove(own)
            out.append((event["id"], own[0], "answered" if event["kind"] == "done" else "failed", own[1], own[2]))
    elif event["kind"] == "ask":
        if own:
            own[2] += 1
            out.append((event["id"], own[0], "follow", own[1], None))
        elif len(flights) >= most:
            out.append((event["id"], event["thing"], "refused", None, None))
        else:
            flights.append([event["thing"], event["id"], 0, event["us"] + int(seconds * 1_000_000)])
            out.append((event["id"], event["thing"], "lead", event["id"], None))
    return out


FLIGHTS = "id long, thing string, outcome string, leader long, followers long"


# --- in order ----------------------------------------------------------------------------------------


def _events(rows: DataFrame, key: Column, ts: str, id_: str, fields: dict[str, Column]) -> DataFrame:
    """(key, ts, us, id, event): an event's fields as JSON."""
    own = rows.withColumn("_ts", F.col(ts).cast("timestamp"))
    us = F.unix_micros("_ts")
    event = F.to_json(F.struct(us.alias("us"), F.col(id_).cast("long").alias("id"), *[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})
    return own.where(F.col("_ts").isNotNull()).select(key.cast("string").alias("key"), F.col("_ts").alias("ts"), us.alias("us"), F.col(id_).cast("long").alias("id"), event.alias("event"))


def _passed(step: Step, out: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, last = {}, ()
        for batch in batches:
            rows = []
            for key, event in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (key,) != last:
                    memory, last = {}, (key,)
                rows += [(key, *r) for r in step(memory, json.loads(event))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


class InOrder(StatefulProcessor):
    """Takes a key's events in order as the watermark passes them. State: the events that wait, and the rule's memory."""

    def __init__(self, step: Step, names: list[str]) -> None:
        self.step, self.names = step, names

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long, event string")
        self.memory = handle.getValueState("memory", "said string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        least = None
        for row in rows:
            self.waiting.appendValue((row.us, row.id, row.event))
            least = row.us if least is None else min(least, row.us)
        if least is not None:
            self.handle.registerTimer(-(-least // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = list(self.waiting.get())
        now, later = sorted(tuple(e) for e in events if e[0] <= passed), [tuple(e) for e in events if e[0] > passed]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(-(-min(e[0] for e in later) // 1000))
        else:
            self.waiting.clear()
        memory = json.loads(self.memory.get()[0]) if self.memory.exists() else {}
        out = [Row(**dict(zip(self.names, (key[0], *r), strict=True))) for _, _, event in now for r in self.step(memory, json.loads(event))]
        if now:
            self.memory.update((json.dumps(memory),))
        return iter(out)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: Column, ts: str, id_: str, fields: dict[str, Column], step: Step, out: str, late: str | None = None) -> DataFrame:
    """(key, out) of a rule over the events of each key. late: how long after newer ones an event of a stream may come."""
    events = _events(rows, key, ts, id_, fields)
    schema = T._parse_datatype_string(f"key string, {out}")
    if not rows.isStreaming:
        dealt = events.repartition("key").sortWithinPartitions("key", "us", "id", "event").select("key", "event")
        return dealt.mapInArrow(_passed(step, schema), schema)
    provider = rows.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if "RocksDB" not in provider:
        raise RuntimeError("set spark.sql.streaming.stateStore.providerClass to the RocksDB state store")
    if late is None:
        raise ValueError("a stream needs late: how long events may be under way")
    waiting = events.withWatermark("ts", late)
    return waiting.groupBy("key").transformWithState(InOrder(step, schema.names), schema, "Append", "EventTime")


def gaps(rows: DataFrame, key: Column, ts: str, id_: str, seconds: float = 3, late: str | None = None) -> DataFrame:
    """(key, id, gap_us, spaced): minimum gaps between the events of a key."""
    return in_order(rows, key, ts, id_, {}, partial(gap_step, seconds=seconds), GAPS, late)


def quotas(rows: DataFrame, key: Column, ts: str, id_: str, cost: Column, kind: Column, quota: float, late: str | None = None) -> DataFrame:
    """(key, id, used, allowed, paused_until_us) of events by day; kind is null for a use, else that of a mark."""
    return in_order(rows, key, ts, id_, {"cost": cost.cast("double"), "kind": kind.cast("string")}, partial(quota_step, quota=quota), QUOTAS, late)


def flights(rows: DataFrame, service: Column, ts: str, id_: str, thing: Column, kind: Column, most: int = MOST_IN_FLIGHT, seconds: float = ANSWER_SECONDS, late: str | None = None) -> DataFrame:
    """(key, id, thing, outcome, leader, followers): what becomes of each service's requests."""
    return in_order(rows, service, ts, id_, {"thing": thing.cast("string"), "kind": kind.cast("string")}, partial(flight_step, most=most, seconds=seconds), FLIGHTS, late)
