"""Stored caches: expiry, limits, writers that race, and what reaches a reviewer."""

import json
import random
from datetime import UTC, datetime, timedelta
from threading import Thread

import pytest
from pyspark.sql import functions as F

from colloquy import caches, schema
from colloquy.operators import verdicts
from colloquy.plans import retrieval
from colloquy.plans.plan import Concept, Plan
from colloquy.sources import grams, readers

NOW = datetime(2024, 6, 1, 23, 59, 50, tzinfo=UTC)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def table(spark, n, text="x"):
    return spark.createDataFrame([(i, text, None) for i in range(n)], "a long, b string, c double")


# --- results


def test_results_expire(spark, tmp_path):
    cache = caches.ResultCache(spark, str(tmp_path / "c"))
    assert cache.get("k", NOW) is None
    cache.put("k", table(spark, 3), True, NOW)
    cache.put("partial", table(spark, 1), False, NOW)
    cache.put("quota", table(spark, 1), False, NOW, quota_exhausted=True)
    at = lambda s: NOW + timedelta(seconds=s)
    assert rows(cache.get("k", at(86_399))) == rows(table(spark, 3)) and cache.get("k", at(86_400)) is None
    assert cache.get("partial", at(29)) is not None and cache.get("partial", at(30)) is None
    assert cache.get("quota", at(9)) is not None and cache.get("quota", at(10)) is None  # midnight comes before half a minute
    assert caches.key_of(1, "a", None) != caches.key_of(1, "b", None) and caches.key_of({"x": 1, "y": 2}) == caches.key_of({"y": 2, "x": 1})


def test_results_first_goes_first(spark, tmp_path):
    cache, want = caches.ResultCache(spark, str(tmp_path / "c"), most=3), {}
    rng, small = random.Random(1), table(spark, 1)
    for i in range(12):
        key = f"k{rng.randrange(5)}"
        cache.put(key, small, True, NOW + timedelta(seconds=i))
        if len(want) >= 3:
            del want[next(iter(want))]
        want[key] = i
        assert [e["key"] for e in cache.entries()] == list(want)
    assert cache.vacuum() == 12 - 3 and rows(cache.get(next(iter(want)), NOW)) == rows(small) and cache.log.version() == 12


def test_writers_lose_nothing(spark, tmp_path):
    """Two caches on one folder, written at once from several threads."""
    own = [caches.ResultCache(spark, str(tmp_path / "c")) for _ in range(4)]
    small = table(spark, 1)
    threads = [Thread(target=lambda c=c, i=i: [c.put(f"{i}-{k}", small, True, NOW) for k in range(4)]) for i, c in enumerate(own)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(e["key"] for e in own[0].entries()) == sorted(f"{i}-{k}" for i in range(4) for k in range(4)) and own[1].log.version() == 16


# --- scans


def test_scans_are_kept(spark, tmp_path):
    clock = [NOW]
    cache = caches.SourceCache(spark, str(tmp_path / "c"), "corpus-1", lambda: clock[0])
    turns = spark.createDataFrame([("m1", f"s{i}", i, f"2024-01-0{i}", None, None, None, None, None, "水素 整備", None, i) for i in range(1, 9)], schema.TURNS)
    first = readers.scan_turns(turns, "水素", limit=3, cache=cache)
    again = readers.scan_turns(turns.limit(0), "水素", limit=3, cache=cache)
    assert rows(first.rows) == rows(again.rows) and (again.hits, again.truncated, cache.hits, cache.misses) == (8, True, 1, 1)
    for other in ({"since": "2024-01-02"}, {"limit": 4}, {"excluded": ["m1"]}, {"query": "整備"}):
        readers.scan_turns(turns, **{"query": "水素", "limit": 3, **other}, cache=cache)
    readers.scan_meetings(turns, "水素", limit=3, cache=cache)
    assert (cache.hits, cache.misses) == (1, 6)
    meeting = readers.scan_meetings(turns.limit(0), "水素", limit=3, cache=cache)
    assert cache.hits == 2 and meeting.rows.count() == 8
    clock[0] += timedelta(seconds=3600)
    assert readers.scan_turns(turns.limit(0), "水素", limit=3, cache=cache).rows.count() == 0 and cache.hits == 2
    other = caches.SourceCache(spark, str(tmp_path / "c"), "corpus-2", lambda: clock[0])
    assert readers.scan_turns(turns, "水素", limit=3, cache=other).rows.count() == 3 and other.hits == 0


def test_scan_limits(spark, tmp_path):
    """Entries, bytes of one and bytes of all hold; those that came first go; one that is too large isn't kept but given."""
    sizes = {n: 2 * sum(len(json.dumps({"a": i, "b": "x", "c": None}, separators=(",", ":"))) for i in range(n)) for n in (1, 5, 9, 40)}
    cache = caches.SourceCache(spark, str(tmp_path / "c"), "x", lambda: NOW, most=3, most_entry=sizes[9], most_bytes=sizes[9] + sizes[5])
    want = []
    for i, n in enumerate((5, 9, 1, 40, 1, 1, 1, 9)):
        got, _, _ = cache.scan((i,), lambda n=n: (table(spark, n), False, n))
        assert got.count() == n
        if sizes[n] <= sizes[9]:
            while want and (len(want) >= 3 or sum(want) + sizes[n] > sizes[9] + sizes[5]):
                want = want[1:]
            want.append(sizes[n])
        assert [e["bytes"] for e in cache.entries()] == want


def test_retrieval_uses_the_cache(spark, tmp_path):
    """A loop that is run again reads its scans from the cache, also over an index, and finds the same."""
    ask = "水素ステーションの整備について、政府としてはどのような見解をお持ちなのか伺います。御答弁をお願いいたします。"
    data = []
    for m in range(6):
        for t in range(4):
            data.append((f"m{m}", f"m{m}s{t}", t, f"202{2 + m % 3}-03-0{1 + m}", "経済産業委員会", "山田" if t % 2 == 0 else "鈴木", "会派" if t % 2 == 0 else None, None if t % 2 == 0 else "経済産業大臣", None, ask if t % 2 == 0 else "水素ステーションの整備を進めます。", "u", t))
    turns = spark.createDataFrame(data, schema.TURNS)
    plan = Plan("", (Concept("水素ステーション", ("水素ステーション",)), Concept("整備", ("整備",))), ("水素", "整備"))
    cache = caches.SourceCache(spark, str(tmp_path / "c"), "t", lambda: NOW)
    index = grams.GramIndex(spark, str(tmp_path / "g"), chunk=8, shelf=16)
    index.add(turns)
    for loop in (retrieval.retrieve_fast, retrieval.retrieve_yearly):
        first = loop(turns, plan, 2024, cache=cache)
        asked = cache.misses
        again = loop(turns.limit(0) if loop is retrieval.retrieve_fast else turns, plan, 2024, cache=cache)
        assert cache.misses == asked and cache.hits > 0
        indexed = loop(index, plan, 2024)
        assert first.candidates.count() > 0 and rows(first.candidates) == rows(again.candidates) == rows(indexed.candidates)
        assert (first.scans, first.hits, first.searched, first.meetings) == (again.scans, again.hits, again.searched, again.meetings) == (indexed.scans, indexed.hits, indexed.searched, indexed.meetings)


# --- reviews


def review(id_, decision="reject", relation="different", **more):
    return {"id": id_, "beneficiary": "who", "activity": "what", "relation": relation, "comparison": "why", "decision": decision, "q": "q1", "a": "v1a1", **more}


@pytest.fixture
def work(spark):
    candidates = spark.createDataFrame([(b, f"c{b}-{i}", f"text {b} {i}") for b in range(6) for i in range(2)], "batch long, id string, text string")
    parts = candidates.select("batch", "id", F.explode(F.array(F.struct(F.lit("q").alias("side"), F.lit("q1").alias("part_id")), F.struct(F.lit("a").alias("side"), F.lit("v1a1").alias("part_id")))).alias("p"), "text", F.lit(1).alias("owner")).select("batch", "id", "p.*", "text", "owner")
    said = {b: [review(f"c{b}-0", "accept", "same"), review(f"c{b}-1")] for b in range(6)}
    said[1][1] |= {"decision": "uncertain", "relation": "unclear"}
    said[2].pop()
    said[3].append(review("c3-1"))
    said[4][0]["q"] = "q9"
    return candidates, parts, {b: json.dumps({"reviews": r}) for b, r in said.items()}


def through(spark, cache, work, identity, now, columns=("id", "text")):
    candidates, parts, said = work
    asked = []

    def ask(unseen):
        got = [r["batch"] for r in unseen.collect()]
        asked.extend(got)
        return spark.createDataFrame([(b, said[b]) for b in got if b in said], "batch long, response string")

    def reusable(answers):
        read = verdicts.read_reviews(answers)
        return caches.reusable_batches(candidates.join(answers.select("batch"), "batch"), read, verdicts.checked_rows(verdicts.review_rows(read), candidates, parts))

    got = cache.through(caches.canonical_input(candidates, "batch", list(columns), "id"), identity, ask, reusable, now)
    return {r["batch"]: (r["response"], r["cache_hit"]) for r in got.collect()}, sorted(asked)


def test_reviews_are_asked_once(spark, tmp_path, work):
    """Only complete, valid and settled batches are kept; a second run asks for the others alone."""
    cache, identity = caches.ReviewCache(spark, str(tmp_path / "r")), caches.ReviewIdentity("m", "compare", "{}")
    got, asked = through(spark, cache, work, identity, NOW)
    assert asked == [0, 1, 2, 3, 4, 5] and got == {b: (t, False) for b, t in work[2].items()}
    got, asked = through(spark, cache, work, identity, NOW + timedelta(days=6))
    assert asked == [1, 2, 3, 4] and {b for b, (_, hit) in got.items() if hit} == {0, 5} and {b: t for b, (t, _) in got.items()} == work[2]
    _, asked = through(spark, cache, work, identity, NOW + timedelta(days=7))
    assert asked == [0, 1, 2, 3, 4, 5]


def test_reviews_of_all(spark, tmp_path, work):
    """When all are kept the reviewer isn't called; any altered part of what an answer depends on calls it again."""
    candidates, parts, said = work
    work = candidates.where("batch in (0, 5)"), parts, said
    cache, identity = caches.ReviewCache(spark, str(tmp_path / "r")), caches.ReviewIdentity("m", "compare", "{}")
    assert through(spark, cache, work, identity, NOW)[1] == [0, 5]
    assert through(spark, cache, work, identity, NOW)[1] == []
    for other in ({"model": "n"}, {"instructions": "Compare"}, {"schema": "[]"}, {"max_tokens": 1}, {"effort": "low"}, {"contract": "2"}, {"settings": ()}):
        own = caches.ReviewIdentity(**{"model": "m", "instructions": "compare", "schema": "{}", **other})
        assert len(through(spark, caches.ReviewCache(spark, cache.root), work, own, NOW)[1]) == 2
    changed = candidates.where("batch in (0, 5)").withColumn("text", F.when(F.col("id") == "c5-1", None).otherwise(F.col("text")))
    assert through(spark, cache, (changed, parts, said), identity, NOW)[1] == [5]
    assert through(spark, cache, work, identity, NOW, ("text", "id"))[1] == [0, 5]


def test_equal_batches_are_one(spark, tmp_path, work):
    """Batches with one input are asked about once and share the answer; one without an answer is left out."""
    candidates = spark.createDataFrame([(b, "c0-0" if b < 3 else "c4-0", "t") for b in (0, 1, 2, 4)], "batch long, id string, text string")
    said = {0: json.dumps({"reviews": [review("c0-0")]})}
    cache = caches.ReviewCache(spark, str(tmp_path / "r"))
    got, asked = through(spark, cache, (candidates, work[1], said), caches.ReviewIdentity("m", "i", "s"), NOW)
    assert asked == [0, 4] and got == {b: (said[0], False) for b in (0, 1, 2)}
    assert cache.known(NOW).count() == 1 and cache.known(NOW - timedelta(days=1)).count() == 0
    nothing = candidates.limit(0)
    assert through(spark, cache, (nothing, work[1], said), caches.ReviewIdentity("m", "i", "s"), NOW) == ({}, [])
