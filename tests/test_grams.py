"""The index of character pairs: its scans against scans of the corpus, and what they leave unread."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from colloquy import schema
from colloquy.commits import CommitConflict, CommitLog
from colloquy.sources import grams, readers

WORDS = ("水素", "整備", "ステーション", "水", "です", "税制", "👩‍👩‍👧", "the", "tion", "é", " ", "\n", "素水")
QUERIES = ("水素", "水素 整備", "ステーション です", "素水素", "水", "水 素", "tion the", "無い", "👩‍👩‍👧 水素", "", "です ですです")


def corpus(spark, seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = None if i % 41 == 0 else "".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 12)))
        meeting = None if i % 37 == 0 else f"m{seed}-{rng.randrange(60)}"
        date = None if i % 43 == 0 else f"20{20 + rng.randrange(4)}-0{rng.randrange(1, 10)}-01"
        rows.append((meeting, f"s{i}", i, date, rng.choice(["本会議", "委員会"]), None, None, None, None, text, None, rng.randrange(5)))
    rows += [rows[5]] * 3
    return spark.createDataFrame(rows, schema.TURNS).repartition(4)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """(all turns, an index of them made of three arrivals)."""
    index = grams.GramIndex(spark, str(tmp_path_factory.mktemp("grams") / "i"), chunk=8, shelf=32)
    parts = [corpus(spark, 1), corpus(spark, 2, 150), corpus(spark, 3, 30).limit(0)]
    for p in parts:
        index.add(p)
    return parts[0].union(parts[1]).cache(), index


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("query", QUERIES)
def test_turn_scans(both, query):
    turns, index = both
    for since, until, limit, excluded in ((None, None, 10_000, None), ("2021-03-01", "2022-08-31", 10_000, ["m1-3"]), ("2022-01-01", None, 7, None), (None, "2020-12-31", 10_000, None)):
        a, b = (readers.scan_turns(x, query, since, until, limit, excluded) for x in (turns, index))
        assert (a.hits, a.truncated) == (b.hits, b.truncated)
        keys = ["date", "issue_id", "ord"]
        assert rows(a.rows.select(*keys)) == rows(b.rows.select(*keys)) and a.rows.columns == b.rows.columns
        if limit == 10_000:
            assert rows(a.rows) == rows(b.rows)


@pytest.mark.parametrize("query", ("水素", "水素 整備", "水", "無い"))
def test_meeting_scans(both, query):
    turns, index = both
    for since, limit, meetings in ((None, 1000, None), ("2022-01-01", 4, ["委員会"])):
        a, b = (readers.scan_meetings(x, query, since, None, limit, meetings) for x in (turns, index))
        assert (a.hits, a.truncated) == (b.hits, b.truncated) and rows(a.rows) == rows(b.rows)
    ids = ["m1-3", "m2-5", "none"]
    assert rows(readers.meetings_by_id(turns, ids)) == rows(readers.meetings_by_id(index, ids))


def test_limits_of_what_is_sent(both, monkeypatch):
    """Beyond the bounds on candidates and shelves, more is read and the rows are the same."""
    turns, index = both
    want = rows(readers.scan_turns(turns, "水素 整備", limit=10_000).rows)
    for name in ("SENT", "NAMED"):
        monkeypatch.setattr(grams, name, 2)
        assert rows(readers.scan_turns(index, "水素 整備", limit=10_000).rows) == want


def test_reads_only_its_shelves(spark, tmp_path):
    """A scan finds what it should with all other shelves gone, and postings of other pairs are not needed either."""
    turns = corpus(spark, 5).where("date is not null and issue_id is not null")
    turns = turns.withColumn("speech", F.when(F.col("speech_id").isin("s17", "s200"), F.lit("珍しい語です")).otherwise(F.col("speech")))
    index = grams.GramIndex(spark, str(tmp_path / "i"), chunk=8, shelf=16)
    index.add(turns)
    want = rows(readers.scan_turns(turns, "珍しい").rows)
    assert len(want) == 2
    shelves = {(r["_year"], r["_shelf"]) for r in index.candidates("珍しい").collect()}
    gone = 0
    for d in Path(index.root).glob("*/turns/_year=*/_shelf=*"):
        if (d.parent.name[6:], int(d.name[7:])) not in shelves:
            shutil.rmtree(d)
            gone += 1
    assert gone > 15 and rows(readers.scan_turns(index, "珍しい").rows) == want
    plan = index.candidates("珍しい", "2021-01-01")._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(EqualTo(gram" in plan and "PartitionFilters: [isnotnull(_year" in plan


def test_postings_are_split(both):
    """A pair that nearly every turn holds is many postings, none longer than a chunk, each sorted."""
    _, index = both
    own = index._table("postings", "_year string, chunk long, gram string, turns array<int>").where("gram = '水素'").collect()
    assert len(own) > 30 and max(len(r["turns"]) for r in own) <= 8
    assert all(r["turns"] == sorted(set(r["turns"])) for r in own)


def test_arrivals(spark, tmp_path):
    index = grams.GramIndex(spark, str(tmp_path / "i"), chunk=8, shelf=16)
    with pytest.raises(ValueError):
        index.turns()
    one = corpus(spark, 7, 20)
    assert index.add(one) == 1 and index.add(corpus(spark, 8, 20)) == 2
    with pytest.raises(ValueError):
        index.add(one.drop("ord"))
    with pytest.raises(ValueError):
        grams.GramIndex(spark, str(tmp_path / "j"), chunk=8, shelf=12)
    # what a dead writer left isn't read
    one.write.parquet(f"{index.root}/left/turns/_year=2020/_shelf=0")
    assert index.turns().count() == one.count() * 2


def test_commits(spark, tmp_path):
    a, b = (CommitLog(spark, str(tmp_path / "log")) for _ in range(2))
    assert a.read() == (0, {}) and a.commit(0, {"n": 1}) == 1
    with pytest.raises(CommitConflict):
        b.commit(0, {"n": 2})
    for log in (a, b, a, b):
        log.update(lambda now: {"n": now["n"] + 1})
    assert a.read() == (5, {"n": 5}) and b.read(2) == (2, {"n": 2})
    b.forget(2)
    assert sorted(p.name for p in (tmp_path / "log/_log").glob("*.json")) == ["0000000004.json", "0000000005.json"]


def test_pairs(spark):
    got = spark.createDataFrame([("abab",), ("a",), ("",), (None,), ("水素👩x",)], "t string").select(grams.pairs_of(F.col("t"))).collect()
    assert [r[0] for r in got] == [["ab", "ba"], [], [], [], ["水素", "素👩", "👩x"]]
    assert grams.query_pairs("水素 x 素水素") == ["水素", "素水"]
