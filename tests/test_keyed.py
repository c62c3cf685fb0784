"""Rules with a memory: tables against plain simulations, and streams with shuffled arrival against tables."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from colloquy.streaming import keyed, state

T0 = datetime(2024, 3, 1, 20, tzinfo=UTC)
SCHEMA = "id long, service string, ts timestamp, thing string, kind string, mark string, cost double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(n=400, seed=1):
    rng, out, at = random.Random(seed), [], T0
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 0.5, 1, 3, 20, 300, 900]))
        mark = rng.choice([None] * 9 + ["verified_quota", "guess"])
        out.append((i, rng.choice(["a", "b", None]), at, rng.choice("xyz"), rng.choice(["ask", "ask", "ask", "done", "failed"]), mark, None if rng.random() < 0.1 else float(rng.randrange(5))))
    return out


@pytest.fixture(scope="module")
def own(spark):
    rows = events()
    return rows, spark.createDataFrame([*rows, (999, "a", None, "x", "ask", None, 1.0)], SCHEMA).repartition(5)


RULES = {
    "gaps": lambda df, late=None: keyed.gaps(df, F.col("service"), "ts", "id", 3, late),
    "quotas": lambda df, late=None: keyed.quotas(df, F.col("service"), "ts", "id", F.col("cost"), F.col("mark"), 20, late),
    "flights": lambda df, late=None: keyed.flights(df, F.col("service"), "ts", "id", F.col("thing"), F.col("kind"), late=late),
}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def us(at):
    return (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def simulated(name, data):
    """A plain retelling of each rule, event by event."""
    out, by = [], {}
    for i, service, at, thing, kind, mark, cost in sorted(data, key=lambda r: (r[2], r[0])):
        m = by.setdefault(service, {"last": None, "day": None, "used": 0, "paused": False, "flying": {}})
        if name == "gaps":
            gap = None if m["last"] is None else us(at) - us(m["last"])
            out.append((service, i, gap, gap is None or gap >= 3_000_000))
            m["last"] = at
        elif name == "quotas":
            if m["day"] != at.date():
                m.update(day=at.date(), used=0, paused=False)
            if mark:
                m["paused"] |= mark == "verified_quota"
                continue
            m["used"] += cost or 0
            midnight = us(datetime(at.year, at.month, at.day, tzinfo=UTC) + timedelta(days=1))
            out.append((service, i, float(m["used"]), m["used"] <= 20 and not m["paused"], midnight if m["paused"] else None))
        else:
            for t, (leader, n, until) in list(m["flying"].items()):
                if until <= at:
                    out.append((service, i, t, "crashed", leader, n))
                    del m["flying"][t]
            if kind != "ask":
                if thing in m["flying"]:
                    leader, n, _ = m["flying"].pop(thing)
                    out.append((service, i, thing, {"done": "answered", "failed": "failed"}[kind], leader, n))
            elif thing in m["flying"]:
                leader, n, until = m["flying"][thing]
                m["flying"][thing] = (leader, n + 1, until)
                out.append((service, i, thing, "follow", leader, None))
            elif len(m["flying"]) == 2:
                out.append((service, i, thing, "refused", None, None))
            else:
                m["flying"][thing] = (i, 0, at + timedelta(seconds=120))
                out.append((service, i, thing, "lead", i, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(RULES))
def test_tables(own, name):
    data, df = own
    got = rows(RULES[name](df))
    assert got == simulated(name, data) and len(got) > 100
    if name == "flights":
        assert {"lead", "follow", "refused", "answered", "failed", "crashed"} == {r[3] for r in got}
    assert RULES[name](df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(RULES))
def test_streams(spark, own, tmp_path, name):
    """Files in which events arrive up to an hour late, in any order: the stream's rows are the table's."""
    data, df = own
    rng = random.Random(name)
    arrival = sorted(data, key=lambda r: us(r[2]) + rng.randrange(3_600_000_000))
    end = max(r[2] for r in data) + timedelta(days=2)
    parts = [arrival[a : a + 60] for a in range(0, len(arrival), 60)] + [[(10**6, "end", end, "x", "ask", None, 0.0)], [(10**6 + 1, "end", T0, "x", "ask", None, 9.0)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:03}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    with pytest.raises(RuntimeError):
        RULES[name](stream, "1 hour")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        with pytest.raises(ValueError):
            RULES[name](stream)
        query = RULES[name](stream, "1 hour").writeStream.format("memory").queryName(f"keyed_{name}").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert query.awaitTermination(240)
        got = [r for r in rows(spark.table(f"keyed_{name}")) if r[0] != "end"]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert got == rows(RULES[name](df)) == simulated(name, data)


def test_gaps_as_by_window(own):
    _, df = own
    window = state.gap_ok(df.where("ts is not null"), ["service"], "ts", ["ts", "id"])
    assert rows(window.select("service", "id", "gap_us", "spaced")) == rows(RULES["gaps"](df))
