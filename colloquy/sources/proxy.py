"""Validated searches as data sources: `spark.read.format("colloquy_turns").option("any", "...").load()`.

Options are checked where the source is made, so a wrong one is refused before any job. A corpus of turns is a folder of Parquet
files that every worker can open by its address. Each file is a partition; row groups whose statistics rule out the dates asked for
aren't read, conditions on the date or the meeting that Spark hands over are applied in the same place (the option pushdown, for
sessions that have spark.sql.python.filterPushdown.enabled), and texts are searched batch by batch in Arrow. A partition keeps its newest hits only, at most as many as are
asked for, so what reaches Spark is bounded by their number times the files; `validated_turns` takes the newest of these.

Nulls: a null text holds no term; a null date is before any. Ties of date go by meeting and order, nulls first. Repeated turns are hits
each. A folder without files has no rows. Columns that the files have beyond those of a turn are ignored; missing ones are null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import regex
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from colloquy import schema

TURNS_MOST, MEETINGS_MOST, TERM, NAME = 30, 10, (2, 80), 30
SINCE, GIVEN = "2020-01-01", 5
_NAMES = [c.split()[0] for c in schema.TURNS.split(", ")]
_KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in schema.TURNS.split(", ")])


@dataclass(frozen=True)
class Asked:
    """What a search asks for; made only from options that are right."""

    path: str
    term: str
    meeting: str
    since: str
    most: int

    @classmethod
    def of(cls, options: dict, most: int) -> Asked:
        term, meeting = (str(options.get(k) or "").strip() for k in ("any", "nameOfMeeting"))
        since, given = str(options.get("from") or SINCE), str(options.get("maximumRecords") or min(GIVEN, most))
        wrong = []
        if not options.get("path"):
            wrong.append("path: missing")
        if not TERM[0] <= len(term) <= TERM[1]:
            wrong.append(f"any: {TERM[0]} to {TERM[1]} characters")
        if len(meeting) > NAME or meeting and not regex.fullmatch(r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}々・]+", meeting):
            wrong.append(f"nameOfMeeting: at most {NAME} characters of Han, Hiragana, Katakana, 々 and ・")
        if not regex.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", since):
            wrong.append("from: a date as YYYY-MM-DD")
        if not regex.fullmatch(r"[0-9]{1,4}", given) or not 1 <= int(given) <= most:
            wrong.append(f"maximumRecords: 1 to {most}")
        if wrong:
            raise ValueError("; ".join(wrong))
        return cls(str(options["path"]), term, meeting, since, int(given))


@dataclass
class Groups(InputPartition):
    """Some row groups of a file."""

    file: str
    groups: list[int]

    def __init__(self, file: str, groups: list[int]) -> None:
        super().__init__(None)
        self.file, self.groups = file, groups


def newest(table: pa.Table, most: int) -> pa.Table:
    """The newest rows by date, then meeting and order, nulls first."""
    keys = pa.table({
        "dated": pc.is_valid(table["date"]), "date": pc.fill_null(table["date"], ""), "issued": pc.is_valid(table["issue_id"]), "issue": pc.fill_null(table["issue_id"], ""),
        "ordered": pc.is_valid(table["ord"]), "ord": pc.fill_null(table["ord"], 0),
    })
    at = pc.sort_indices(keys, sort_keys=[("dated", "descending"), ("date", "descending"), *((c, "ascending") for c in ("issued", "issue", "ordered", "ord"))])
    return table.take(at[:most])


class TurnReader(DataSourceReader):
    """Reads the hits of a search. Bounds on the date are [operator, value]; they start with the search's own."""

    def __init__(self, asked: Asked, per_meeting: bool) -> None:
        self.asked, self.per_meeting = asked, per_meeting
        self.bounds: list[tuple[str, str]] = [(">=", asked.since)]
        self.meetings: list[str] = [asked.meeting] if asked.meeting else []

    def _may_hold(self, least: str | None, most: str | None) -> bool:
        """May a row group with these dates hold one that is asked for?"""
        if least is None or most is None:
            return True
        return all({">": most > v, ">=": most >= v, "<": least < v, "<=": least <= v, "=": least <= v <= most}[s] for s, v in self.bounds)

    def partitions(self) -> list[InputPartition]:
        files, root = opened(self.asked.path)
        out: list[InputPartition] = []
        for info in files.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = info.base_name
            if info.type != pafs.FileType.File or name.startswith(("_", ".")) or not name.endswith(".parquet"):
                continue
            with files.open_input_file(info.path) as source:
                meta = pq.ParquetFile(source).metadata
            at = next((i for i in range(meta.num_columns) if meta.schema.column(i).path == "date"), None)
            stats = [meta.row_group(g).column(at).statistics if at is not None else None for g in range(meta.num_row_groups)]
            groups = [g for g, s in enumerate(stats) if s is None or not s.has_min_max or self._may_hold(s.min, s.max)]
            if groups:
                out.append(Groups(info.path, groups))
        return out or [Groups("", [])]

    def _hits(self, batch: pa.RecordBatch) -> pa.Table:
        rows = pa.table({f.name: batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in _SCHEMA})
        date = pc.fill_null(rows["date"], "")
        signs = {">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal, "=": pc.equal}
        held = pa.chunked_array([pa.array([True] * len(rows))])
        for sign, value in self.bounds:
            held = pc.and_(held, signs[sign](date, value))
        for name in self.meetings:
            held = pc.and_(held, pc.equal(pc.fill_null(rows["meeting"], ""), name))
        rows = rows.filter(held)
        for word in self.asked.term.split():
            rows = rows.filter(pc.match_substring(pc.fill_null(rows["speech"], ""), word))
        return rows

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        kept = _SCHEMA.empty_table()
        files, _ = opened(self.asked.path)
        with files.open_input_file(partition.file) as source:
            own = pq.ParquetFile(source)
            columns = [n for n in own.schema_arrow.names if n in _NAMES]
            for batch in own.iter_batches(8192, row_groups=partition.groups, columns=columns):
                rows = self._hits(batch)
                if len(rows):
                    kept = newest(pa.concat_tables([kept, rows]), self.asked.most if not self.per_meeting else len(kept) + len(rows))
                    if self.per_meeting:  # a meeting's newest hit stands for it
                        first: dict[str | None, int] = {}
                        for i, issue in enumerate(kept["issue_id"].to_pylist()):
                            first.setdefault(issue, i)
                        kept = kept.take(pa.array(list(first.values())[: self.asked.most], pa.int64()))
        yield from kept.to_batches()


class PushedTurnReader(TurnReader):
    """A reader that Spark hands conditions to; it refuses one that has the method in a session that doesn't."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes over comparisons of the date and equality of the meeting, which then hold for the newest hits too; gives back the rest."""
        signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", EqualTo: "="}
        for f in filters:
            sign = signs.get(type(f))
            if sign and f.attribute == ("date",) and isinstance(f.value, str):
                self.bounds.append((sign, f.value))
            elif sign == "=" and f.attribute == ("meeting",) and isinstance(f.value, str):
                self.meetings.append(f.value)
            else:
                yield f


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class TurnSource(DataSource):
    """The newest turns that hold all words of a term."""

    @classmethod
    def name(cls) -> str:
        return "colloquy_turns"

    most = TURNS_MOST

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.asked = Asked.of(options, self.most)

    def schema(self) -> str:
        return schema.TURNS

    def reader(self, schema) -> DataSourceReader:
        pushed = str(self.options.get("pushdown") or "").lower() == "true"
        return (PushedTurnReader if pushed else TurnReader)(self.asked, isinstance(self, MeetingSource))


class MeetingSource(TurnSource):
    """The newest hit of each of the newest meetings of which a turn holds all words of a term."""

    @classmethod
    def name(cls) -> str:
        return "colloquy_meetings"

    most = MEETINGS_MOST


def register(spark: SparkSession) -> None:
    """Makes both sources known to the session by their names."""
    for source in (TurnSource, MeetingSource):
        spark.dataSource.register(source)


def _asked(spark: SparkSession, source: type[TurnSource], path: str, term: str, name: str, since: str, most: int) -> DataFrame:
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    options = {"path": path, "any": term, "nameOfMeeting": name, "from": since, "maximumRecords": str(most), "pushdown": pushed}
    Asked.of(options, source.most)
    register(spark)
    own = spark.read.format(source.name()).options(**options).load()
    return own.orderBy(F.desc("date"), F.asc("issue_id"), F.asc("ord"))


def validated_turns(spark: SparkSession, path: str, term: str, name: str = "", since: str = SINCE, most: int = GIVEN) -> DataFrame:
    """The newest turns of a corpus that hold a term; ValueError names every option that is wrong."""
    return _asked(spark, TurnSource, path, term, name, since, most).limit(most)


def validated_meetings(spark: SparkSession, path: str, term: str, name: str = "", since: str = SINCE, most: int = GIVEN) -> DataFrame:
    """All turns of the newest meetings of a corpus of which a turn holds a term; the meetings' names are at most `most`."""
    hits = _asked(spark, MeetingSource, path, term, name, since, most)
    ids = [r["issue_id"] for r in hits.groupBy("issue_id").agg(F.max("date").alias("date")).orderBy(F.desc("date"), F.asc("issue_id")).limit(most).collect()]
    named = F.col("issue_id").isin([i for i in ids if i is not None])
    return spark.read.schema(schema.TURNS).parquet(path).where(named | F.col("issue_id").isNull() if None in ids else named)
