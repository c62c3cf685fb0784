"""Writers."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"
#: What writing and reading must share for texts to come back as they are.
CSV = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_jsonl(rows: DataFrame, path: str) -> int:
    """One JSON object a line (null fields kept); gives the number of rows, counted as they are written."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.option("ignoreNullFields", False).json(path)
    return seen.get["n"]


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """A fixed choice of columns with a header in every file; missing values are empty. The mark that some spreadsheets need
    before UTF-8 is put before the first name of the header. Quotes are doubled, and blanks at the ends stay."""
    own = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    own.withColumnRenamed(columns[0], BOM + columns[0]).write.option("header", True).option("emptyValue", "").option("encoding", "UTF-8").options(**CSV).csv(path)


def append_row(table: DataFrame, path: str, values: dict) -> dict:
    """Appends one row (title trimmed, not empty) to a Parquet table and gives it back."""
    title = (values.get("title") or "").strip()
    if not title:
        raise ValueError("title must not be empty")
    row = table.sparkSession.createDataFrame([{**values, "title": title}], table.schema)
    row.write.mode("append").parquet(path)
    return row.first().asDict()


def best_effort(write: Callable[[], None]) -> bool:
    """A write that may fail without failing its query, as a cache's."""
    try:
        write()
    except Exception:  # noqa: BLE001
        return False
    return True


class EvaluationReport:
    """The report of an evaluation as one JSON file, which is whole at every moment: each state is written aside and put in its place."""

    def __init__(self, spark: SparkSession, path: str, **about: object) -> None:
        self.path, self.state = path, {**about, "results": []}
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._overwrite = spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._overwrite[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE

    def write(self) -> None:
        hadoop = self._jvm.org.apache.hadoop.fs
        to = hadoop.Path(self.path)
        fs = to.getFileSystem(self._conf)
        to = fs.makeQualified(to)
        aside = hadoop.Path(to.getParent(), f".{to.getName()}.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        try:
            out.write(bytearray((json.dumps(self.state, ensure_ascii=False, indent=2) + "\n").encode()))
        finally:
            out.close()
        hadoop.FileContext.getFileContext(fs.getUri(), self._conf).rename(aside, to, self._overwrite)

    def run(self, questions: list[str], ask: Callable[[str], dict], clock: Callable[[], float] = time.monotonic) -> dict:
        """Asks one question after the other and writes the report after each; stops where one fails or is assessed in part, and says why.

        ask gives assessment_status, assessment_error, assessment_partial and whatever else is to be kept. What it raises goes through; the
        report then holds the questions before.
        """
        for question in questions:
            began = clock()
            result = ask(question)
            self.state["results"].append({"question": question, "duration_ms": round((clock() - began) * 1000), "result": result})
            if result.get("assessment_status") == "failed" or result.get("assessment_error") or result.get("assessment_partial"):
                self.state["stopped_reason"] = f"{result.get('assessment_error') or 'partial_assessment'}; remaining cases were not attempted."
                self.write()
                break
            self.write()
        return self.state
