"""A written index of character pairs, for keyword scans that don't read every text.

The turns of an arrival are numbered by date, meeting and order and written in that order, by year and shelf (SHELF turns). For each
year, chunk (CHUNK turns) and pair of neighbouring characters, the numbers of the turns that hold it, within their chunk, are one
posting: a sorted array of integers, which the file stores as differences. Postings are dealt and sorted by year, pair and chunk, so a
search for a pair reads its own stretch of the files, and a pair that most turns hold is many postings, dealt to many tasks, none longer
than a chunk. A table of meetings says on which shelves each one's turns are.

A turn that holds a word holds its pairs, so the postings of all pairs of a query, intersected chunk by chunk, name every turn that can
hold its words. These candidates are then read, from their shelves alone, and verified on the text: a scan of the index gives the rows
of a scan of the corpus. Words of one character have no pair and restrict nothing; a query of such words alone reads all shelves.

Arrivals are folders of their own; a committed log names those that count, so readers see an arrival whole or not at all, and a writer
that dies leaves nothing that is read. Null texts hold no word; null dates are a year of their own, which no range of dates reaches.
Repeated turns are numbered and found each. All columns of the turns are kept; an empty arrival adds nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.commits import CommitLog
from colloquy.operators.ranking import numbered
from colloquy.staging import staged

#: Turns of one posting at most, and turns of one shelf.
CHUNK, SHELF = 1 << 16, 1 << 20
#: Candidates that are sent to every task (16 bytes each); if there are more, their shelves are read and verified as they are.
SENT = 1_000_000
#: Shelves that are named in a filter; if candidates stand on more, all are read.
NAMED = 10_000
_OWN = ("_year", "_shelf", "_place", "_part")


def pairs_of(text: Column) -> Column:
    """The different pairs of neighbouring characters of a text."""
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    pair = F.zip_with(chars, F.slice(chars, 2, F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(pair, lambda p: p.isNotNull()))


def query_pairs(query: str) -> list[str]:
    return sorted({w[i : i + 2] for w in query.split() for i in range(len(w) - 1)})


class GramIndex:
    """An index of turns (issue_id, date, ord, speech and any other columns) under root."""

    def __init__(self, spark: SparkSession, root: str, chunk: int = CHUNK, shelf: int = SHELF) -> None:
        if shelf % chunk:
            raise ValueError("a shelf holds whole chunks")
        self.spark, self.root, self.chunk, self.shelf = spark, root.rstrip("/"), chunk, shelf
        self.log = CommitLog(spark, self.root)

    # --- writing

    def add(self, turns: DataFrame) -> int:
        """Writes an arrival and commits it; gives the new version. The arrival's columns must be those of earlier ones."""
        _, now = self.log.read()
        if now and T.StructType.fromJson(now["schema"]).simpleString() != turns.schema.simpleString():
            raise ValueError(f"the index has the columns {T.StructType.fromJson(now['schema']).simpleString()}")
        if {c.lower() for c in turns.columns} & set(_OWN):
            raise ValueError(f"{', '.join(_OWN)} are the index's own columns")
        folder = uuid.uuid4().hex
        year = F.coalesce(F.substring("date", 1, 4), F.lit("none"))
        own = numbered(turns.withColumn("_year", year), ["_year", "date", "issue_id", "ord"], "_place").withColumn("_shelf", F.floor(F.col("_place") / self.shelf))
        own.write.option("compression", "zstd").partitionBy("_year", "_shelf").parquet(f"{self.root}/{folder}/turns")
        schema = T.StructType([*turns.schema, T.StructField("_place", T.LongType()), T.StructField("_year", T.StringType()), T.StructField("_shelf", T.LongType())])
        own = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}/turns")
        self._write_postings(own, folder)
        own.select("issue_id", "_year", "_shelf").distinct().repartitionByRange("issue_id").sortWithinPartitions("issue_id").write.parquet(f"{self.root}/{folder}/meetings")
        self.log.update(lambda now: {"schema": turns.schema.jsonValue(), "parts": [*now.get("parts", []), folder]})
        return self.log.version()

    def _write_postings(self, own: DataFrame, folder: str) -> None:
        """Texts are dealt by chunk once; the pairs of a chunk are then grouped where they are, and only postings are dealt again."""
        chunk = own.select("_year", F.floor(F.col("_place") / self.chunk).alias("chunk"), (F.col("_place") % self.chunk).cast("int").alias("at"), "speech").repartition("_year", "chunk")
        each = chunk.select("_year", "chunk", "at", F.explode(pairs_of(F.col("speech"))).alias("gram"))
        postings = each.groupBy("_year", "chunk", "gram").agg(F.array_sort(F.collect_list("at")).alias("turns"))
        postings = staged(postings)
        dealt = postings.repartitionByRange("_year", "gram", "chunk").sortWithinPartitions("_year", "gram", "chunk")
        dealt.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").partitionBy("_year").parquet(f"{self.root}/{folder}/postings")

    # --- reading

    def _parts(self) -> list[tuple[int, str]]:
        return list(enumerate(self.log.read()[1].get("parts", [])))

    def _schema(self) -> T.StructType:
        _, now = self.log.read()
        if not now:
            raise ValueError(f"nothing has been added to {self.root}")
        return T.StructType.fromJson(now["schema"])

    def _table(self, name: str, schema: str) -> DataFrame:
        tables = [self.spark.read.schema(schema).parquet(f"{self.root}/{folder}/{name}").withColumn("_part", F.lit(i)) for i, folder in self._parts()]
        return reduce(DataFrame.unionByName, tables)

    def turns(self) -> DataFrame:
        """All turns, with the index's own columns."""
        schema = T.StructType([*self._schema(), T.StructField("_place", T.LongType()), T.StructField("_year", T.StringType()), T.StructField("_shelf", T.LongType())])
        return self._table("turns", schema)

    @staticmethod
    def _years(since: str | None, until: str | None) -> Column:
        """A filter on folders that no row between the dates fails."""
        out = F.lit(True)
        if since:
            out = out & (F.col("_year") >= since[:4])
        if until:
            out = out & (F.col("_year") <= until[:4])
        return out

    def candidates(self, query: str, since: str | None = None, until: str | None = None) -> DataFrame | None:
        """(_part, _year, _shelf, _place) of the turns that hold all pairs of a query's words; None if it has no pair."""
        pairs = query_pairs(query)
        if not pairs:
            return None
        held = reduce(Column.__or__, [F.col("gram") == p for p in pairs])
        own = self._table("postings", "_year string, chunk long, gram string, turns array<int>").where(self._years(since, until)).where(held)
        per = own.groupBy("_part", "_year", "chunk").agg(F.collect_list("turns").alias("lists")).where(F.size("lists") == len(pairs))
        both = F.aggregate(F.slice("lists", 2, max(1, len(pairs))), F.col("lists")[0], F.array_intersect)
        place = F.explode(both).alias("at")
        at = per.select("_part", "_year", "chunk", place).withColumn("_place", F.col("chunk") * self.chunk + F.col("at"))
        return at.select("_part", "_year", F.floor(F.col("_place") / self.shelf).alias("_shelf"), "_place")

    def _on(self, shelves: DataFrame, turns: DataFrame) -> DataFrame:
        """turns of the shelves (_part, _year, _shelf), as a filter on folders; all turns if there are very many shelves."""
        named = shelves.select("_part", "_year", "_shelf").distinct().limit(NAMED + 1).collect()
        if len(named) > NAMED:
            return turns
        one = [(F.col("_part") == p) & (F.col("_year") == y) & F.col("_shelf").isin([r["_shelf"] for r in named if (r["_part"], r["_year"]) == (p, y)]) for p, y in sorted({(r["_part"], r["_year"]) for r in named})]
        return turns.where(reduce(Column.__or__, one, F.lit(False)))

    def turns_with(self, query: str, since: str | None = None, until: str | None = None) -> DataFrame:
        """Turns that may hold all words of a query between two dates: all that do, and few others."""
        found = self.candidates(query, since, until)
        turns = self.turns().where(self._years(since, until))
        if found is None:
            return turns.drop(*_OWN)
        found = staged(found)
        turns = self._on(found, turns)
        if found.count() <= SENT:
            turns = turns.join(F.broadcast(found.select("_part", "_place")), ["_part", "_place"], "left_semi")
        return turns.select(*self._schema().names)

    def meeting_turns(self, ids: list[str | None]) -> DataFrame:
        """All turns of some meetings, read from their shelves."""
        own = F.col("issue_id").isin([i for i in ids if i is not None])
        own = own | F.col("issue_id").isNull() if None in ids else own
        shelves = self._table("meetings", "issue_id string, _year string, _shelf long").where(own)
        return self._on(shelves, self.turns()).where(own).select(*self._schema().names)
