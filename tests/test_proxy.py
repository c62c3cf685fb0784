"""Validated searches: what their options refuse, and their rows against plain scans; law searches over pages."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from colloquy import rules, schema
from colloquy.operators import lookups
from colloquy.sources import proxy


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, path = random.Random(4), str(tmp_path_factory.mktemp("proxy") / "turns")
    rows = []
    for i in range(500):
        date = None if i % 31 == 0 else f"20{18 + i // 90}-0{1 + i % 9}-1{i % 7}"
        text = None if i % 29 == 0 else rng.choice(["水素の整備", "水素", "整備です", "税制 水素"]) + str(i)
        rows.append((None if i % 37 == 0 else f"m{i // 9}", f"s{i}", i, date, rng.choice(["本会議", "委員会"]), None, None, None, None, text, None, None if i % 41 == 0 else i % 9))
    df = spark.createDataFrame(rows + rows[:3], schema.TURNS)
    df.withColumn("more", F.lit(1)).sort("date").coalesce(3).write.option("parquet.block.size", 4096).parquet(path)
    return df.cache(), path


def plain(df, term, name, since):
    own = df.where(F.col("date") >= since).where(F.col("meeting") == name if name else F.lit(True))
    for word in term.split():
        own = own.where(F.contains("speech", F.lit(word)))
    return own.orderBy(F.desc("date"), F.asc("issue_id"), F.asc("ord"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("term", "name", "since", "most"), [("水素", "", "2020-01-01", 30), ("水素 整備", "委員会", "2018-01-01", 7), ("税制", "本会議", "2022-01-01", 1), ("無い語", "", "2018-01-01", 30)])
def test_turns(spark, corpus, term, name, since, most):
    df, path = corpus
    got, want = proxy.validated_turns(spark, path, term, name, since, most), plain(df, term, name, since).limit(most)
    keys = ["date", "issue_id", "ord"]
    assert got.columns == df.columns and rows(got.select(keys)) == rows(want.select(keys))
    assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in plain(df, term, name, since).collect()}


@pytest.mark.parametrize(("term", "since", "most"), [("水素", "2020-01-01", 10), ("税制", "2018-01-01", 3), ("無い語", "2018-01-01", 3)])
def test_meetings(spark, corpus, term, since, most):
    df, path = corpus
    ids = plain(df, term, "", since).groupBy("issue_id").agg(F.max("date").alias("d")).orderBy(F.desc("d"), "issue_id").limit(most).select("issue_id")
    want = df.join(ids.select(F.col("issue_id").alias("of")), F.col("issue_id").eqNullSafe(F.col("of")), "left_semi")
    assert rows(proxy.validated_meetings(spark, path, term, "", since, most)) == rows(want)


@pytest.mark.parametrize("wrong", [
    {"any": "x"}, {"any": "x" * 81}, {"any": " 水 "}, {}, {"any": "水素", "nameOfMeeting": "会" * 31}, {"any": "水素", "nameOfMeeting": "Plenary"}, {"any": "水素", "from": "2020-1-1"},
    {"any": "水素", "from": "20200101"}, {"any": "水素", "maximumRecords": "0"}, {"any": "水素", "maximumRecords": "31"}, {"any": "水素", "maximumRecords": "3.5"}, {"any": "水素", "path": ""},
])
def test_refused(spark, corpus, wrong):
    """Wrong options are refused when the source is made, before any job."""
    proxy.register(spark)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    with pytest.raises(Exception, match="characters|date as|1 to 30|missing"):
        spark.read.format("colloquy_turns").options(**{"path": corpus[1], **wrong}).load()
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    with pytest.raises(ValueError, match="1 to 10"):
        proxy.validated_meetings(spark, corpus[1], "水素", most=11)


def test_row_groups_and_filters(spark, corpus):
    """Row groups out of the range of dates aren't read; filters that Spark hands over give the newest of what is left."""
    df, path = corpus
    asked = proxy.Asked.of({"path": path, "any": "水素", "from": "2022-01-01"}, 30)
    reader = proxy.TurnReader(asked, False)
    every = sum(pq.ParquetFile(p).metadata.num_row_groups for p in __import__("pathlib").Path(path).glob("*.parquet"))
    read = sum(len(g.groups) for g in reader.partitions())
    assert 0 < read < every
    proxy.register(spark)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        own = spark.read.format("colloquy_turns").options(path=path, any="水素", maximumRecords="5", pushdown="true").load()
        until = own.where("date < '2021-06-01' and meeting = '本会議'").orderBy(F.desc("date"), "issue_id", "ord").limit(5)
        want = plain(df, "水素", "本会議", "2020-01-01").where("date < '2021-06-01'").limit(5)
        assert rows(until.select("date", "issue_id", "ord")) == rows(want.select("date", "issue_id", "ord")) and until.count() == 5
        assert rows(proxy.validated_turns(spark, path, "水素", most=9).select("date", "ord")) == rows(plain(df, "水素", "", "2020-01-01").limit(9).select("date", "ord"))
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_empty_folder(spark, tmp_path):
    (tmp_path / "e").mkdir()
    assert proxy.validated_turns(spark, str(tmp_path / "e"), "水素").count() == 0


# --- laws


def law_table(spark, n, size, open_end=False):
    rng, items = random.Random(n), []
    for i in range(n):
        kind = rng.choice([*rules.LAW_TYPES, "Rule", None])
        sentences = [(rng.choice(["<b>廃棄物</b>の処理", "水素", "x"]),), (None,)] if i % 7 else None
        items.append(({"law_id": f"L{i}", "law_type": kind}, {"law_title": rng.choice(["環境省設置法", "廃棄物法", None])}, sentences))
    pages = [(items[a : a + size], a + size if a + size < n or open_end else None) for a in range(0, n, size)]
    rng.shuffle(pages)
    return items, spark.createDataFrame(pages, schema.LAWS_JSON).repartition(3)


@pytest.mark.parametrize(("n", "size", "types", "limit"), [(90, 10, rules.LAW_TYPES, 1000), (90, 7, ("Act",), 5), (40, 100, rules.LAW_TYPES, 3), (90, 1, ("Act", "CabinetOrder"), 20)])
def test_law_search(spark, n, size, types, limit):
    items, pages = law_table(spark, n, size)
    want = [i for i, (info, _, s) in enumerate(items) if info["law_type"] in (*types, None) and s and "廃棄物" in s[0][0]]
    found, truncated, hits = lookups.law_search(pages, "廃棄物", types, limit)
    assert sorted(r["at"] for r in found.collect()) == want[:limit] and (hits, truncated) == (len(want), len(want) > limit)
    named = [r["url"].rsplit("/", 1)[1] for r in lookups.law_jurisdiction(pages, "廃棄物", types, limit).collect()]
    assert sorted(named) == sorted(f"L{i}" for i in want[:limit] if items[i][1]["law_title"] == "環境省設置法")


def test_law_pages_go_on(spark):
    """A last page that says where the next begins: there is more than was searched."""
    _, pages = law_table(spark, 30, 10, open_end=True)
    assert lookups.law_search(pages, "廃棄物")[1] is True
    empty = pages.limit(0)
    found, truncated, hits = lookups.law_search(empty, "廃棄物")
    assert (found.count(), truncated, hits) == (0, False, 0)


@pytest.mark.parametrize("wrong", [{"term": "x"}, {"term": "廃棄 物"}, {"term": "廃" * 31}, {"types": ()}, {"types": ("Rule",)}, {"limit": 0}, {"limit": 1001}])
def test_law_search_refused(spark, wrong):
    with pytest.raises(ValueError):
        lookups.law_search(spark.createDataFrame([], schema.LAWS_JSON), **{"term": "廃棄物", **wrong})
