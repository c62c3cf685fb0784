"""Answers that don't repeat a question's concepts: linked through the words of the question itself, or as short replies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import rules
from colloquy.functions.hits import concept_hit, literal_pattern
from colloquy.operators.passages import passage_windows
from colloquy.operators.ranking import keep_max
from colloquy.plans.plan import Plan, Segmenter, clean, concepts
from colloquy.staging import staged

#: Texts whose words are held at once in a task.
BATCH = 500
SAID = "said string, topics array<string>, parts array<struct<part:string,pattern:string>>"


@F.pandas_udf(T.StringType())
def _clean(text: pd.Series) -> pd.Series:
    return text.map(clean)


def spoken(texts: DataFrame, segment: Segmenter) -> DataFrame:
    """(said, topics, parts) for the distinct texts of a column: the concepts of each and the parts of these, with patterns.

    Texts are cut in tasks: by a column function where the segmenter has one, else by the segmenter itself, which then travels there.
    """
    own = texts.toDF("said").distinct()
    cut = hasattr(segment, "segments")
    own = own.withColumn("_cut", segment.segments(_clean(F.col("said")))) if cut else own
    name = None if cut else segment

    def found(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in (p.iloc[i : i + BATCH] for p in parts for i in range(0, len(p), BATCH)):
            ready = ([(s[1:], s[0] == "+") for s in c] for c in rows["_cut"]) if cut else (None for _ in range(len(rows)))
            every = [concepts(t, name or (lambda _, c=c: c)) for t, c in zip(rows["said"], ready, strict=True)]
            pairs = [[(p, literal_pattern(p)) for p in dict.fromkeys(p for c in own for p in c.parts)] for own in every]
            yield pd.DataFrame({"said": list(rows["said"]), "topics": [[c.text for c in own] for own in every], "parts": [[{"part": p, "pattern": q} for p, q in own] for own in pairs]})

    return own.mapInPandas(found, SAID)


def _has(passage: Column, p: Column) -> Column:
    return F.contains(passage, p["part"]) & (F.regexp_instr(passage, p["pattern"]) > 0)


def bridged_answers(pairs: DataFrame, plan: Plan, segment: Segmenter, runs: dict | None = None) -> DataFrame:
    """(pair, answer, answer_score, context) for those of some pairs whose answer can be linked though it doesn't support the plan.

    pairs: pair, question (the passage that matched), question_start, question_end, question_text, answer_text. First a passage of
    the answer that shares words with the question's passage, of which some are neither in the plan nor say nothing, that holds
    the first concept, and with which no other passage of the question shares as many (question_vocabulary). Else a short answer
    about at most one thing, to a question that asks for one, if it holds half of a concept or refers back (turn).
    """
    cues = F.regexp_count("question_text", F.lit(rules.CUES))
    pairs = staged(pairs.withColumn("cues", cues))
    other = passage_windows(pairs, ["pair"], "question_text").join(pairs.select("pair", "question_start", "question_end"), "pair").where("end <= question_start or start >= question_end")
    other = staged(other.select("pair", F.col("window_no").alias("other_no"), F.col("passage").alias("said")))
    short = F.length("answer_text") <= 250
    texts = pairs.select(F.col("question").alias("said")).union(other.select("said")).union(pairs.where(short).select("answer_text"))
    said = staged(spoken(texts, segment))
    known = {p for g in plan.groups for p in g.parts} | set(rules.BRIDGE_GENERIC)
    local = pairs.join(said, F.col("question") == F.col("said")).select("pair", "cues", "parts")
    n = lambda keep: F.size(F.filter("parts", lambda p: _has(F.col("passage"), p) & keep(p)))
    direct = passage_windows(pairs, ["pair"], "answer_text").join(local, "pair")
    direct = direct.select("pair", "window_no", "passage", "cues", n(lambda p: F.lit(True)).alias("shared"), n(lambda p: ~p["part"].isin(*known)).alias("bridge"))
    several = F.col("cues") > 1
    direct = direct.where((F.col("shared") >= F.when(several, 3).otherwise(2)) & (F.col("bridge") >= F.when(several, 2).otherwise(1)))
    direct = staged(direct.where(concept_hit(F.col("passage"), plan.groups[0], runs)["coverage"] >= 0.66))
    rival = direct.join(other, "pair").join(said, "said").where(n(lambda p: F.lit(True)) >= F.col("shared")).select("pair", "window_no").distinct()
    best = keep_max(direct.join(rival, ["pair", "window_no"], "left_anti"), ["pair"], [F.desc("shared"), F.asc(F.length("passage")), F.asc("window_no")])
    best = staged(best.select("pair", F.col("passage").alias("answer"), F.lit(0.75).alias("answer_score"), F.lit("question_vocabulary").alias("context")))
    half = F.lit(False)
    for g in plan.groups:
        half = half | (concept_hit(F.col("answer_text"), g, runs)["coverage"] >= 0.5)
    substantive = F.size(F.filter("topics", lambda t: ~t.rlike(rules.REPLY_GENERIC)))
    brief = pairs.where(short & (F.col("cues") <= 1)).join(best, "pair", "left_anti").join(said, F.col("answer_text") == F.col("said"))
    brief = brief.where((substantive <= 1) & (half | F.col("answer_text").rlike(rules.BACK_REFERENCE)))
    return best.union(brief.select("pair", F.col("answer_text"), F.lit(0.5), F.lit("turn")))
