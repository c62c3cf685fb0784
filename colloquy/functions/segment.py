"""Japanese words, cut by the ICU that comes with Spark: on the driver for plans, which are small, and in tasks for columns of texts.

A Java function (colloquy/java) calls it in tasks, as Python workers have no ICU; its jar goes to the executors with the session.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import rules
from colloquy.plans.plan import Concept, Segment, Segmenter, is_katakana, stems

JAR = Path(__file__).resolve().parent.parent / "java" / "words.jar"


class IcuSegmenter:
    """Cuts a text where the session is; `segments` cuts a column's texts where they are."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.icu = spark, spark.sparkContext._jvm.com.ibm.icu

    def __call__(self, text: str) -> list[Segment]:
        words = self.icu.text.BreakIterator.getWordInstance(self.icu.util.ULocale("ja"))
        words.setText(text)
        units = text.encode("utf-16-le")
        out, start, end = [], words.first(), words.next()
        while end != -1:
            out.append((units[2 * start : 2 * end].decode("utf-16-le"), words.getRuleStatus() >= 100))
            start, end = end, words.next()
        return out

    def segments(self, text: Column) -> Column:
        """array<string>: the segments of a text, each after a + if it is a word and a - if it isn't."""
        self.spark.sql(f'ADD JAR "{JAR}"')
        self.spark.udf.registerJavaFunction("colloquy_segments", "colloquy.JapaneseWords", "array<string>")
        return F.call_function("colloquy_segments", text)


def icu_segmenter(spark: SparkSession) -> Segmenter:
    return IcuSegmenter(spark)


def touching_runs(texts: DataFrame, column: str, concepts: list[Concept], segment: Segmenter) -> dict[str, dict[str, list[int]]]:
    """For each Katakana term of the concepts, the longer Katakana runs of a corpus that hold it at word borders, with the offsets.

    Different runs are vocabulary and grow far slower than rows; they are cut one part of the distinct table after the other, and those
    that hold the term at borders are kept.
    """
    all_terms = {s for c in concepts for t in (c.text, *c.parts) for s in stems(t) if is_katakana(t)}
    out: dict[str, dict[str, list[int]]] = {}
    for term in sorted(all_terms):
        run: Column = F.explode(F.regexp_extract_all(F.col(column), F.lit(f"{rules.KATAKANA}*{term}{rules.KATAKANA}*"), F.lit(0)))
        runs = texts.where(F.contains(column, F.lit(term))).select(run.alias("run")).distinct().where(F.col("run") != term)
        found: dict[str, list[int]] = {}
        for (text,) in runs.toLocalIterator(prefetchPartitions=True):
            borders, at = {0}, 0
            for word, _ in segment(text):
                at += len(word)
                borders.add(at)
            places = [i for i in range(len(text) - len(term) + 1) if text.startswith(term, i) and i in borders and i + len(term) in borders]
            if places:
                found[text] = places
        out[term] = found
    return out
