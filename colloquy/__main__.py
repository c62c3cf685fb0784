"""Command line: labelled pairs, the centroid classifier, exports, and searches over a corpus of meetings.

    python -m colloquy collect MEETINGS OUT --keyword WORD [--keyword WORD] [--since DATE] [--until DATE] [--limit N]
    python -m colloquy predict PAIRS --question TEXT
    python -m colloquy evaluate PAIRS
    python -m colloquy csv PAIRS OUT
    python -m colloquy search MEETINGS --question TEXT [--term WORD] [--since DATE] --year YEAR [--yearly]
    python -m colloquy assignments MEETINGS --question TEXT --term WORD [--term WORD] [--since DATE]
    python -m colloquy analyze MEETINGS --question TEXT
"""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.segment import icu_segmenter, touching_runs
from colloquy.operators import classify
from colloquy.operators.ranking import keep_first, numbered
from colloquy.operators.turns import labeled_pairs
from colloquy.plans.entries import SINCE, analyze, search_assignments
from colloquy.plans.plan import make_plan, validate_request
from colloquy.plans.retrieval import retrieve_fast, retrieve_yearly
from colloquy.sources import readers, sinks

COLUMNS = ["question", "answer", "ministry", "speaker", "position", "date", "meeting", "url"]
SHOWN_QUESTION, SHOWN_ANSWER = 260, 220


def collect(turns: DataFrame, keywords: list[str], since: str | None, until: str | None, limit: int) -> DataFrame:
    """Labelled pairs of the newest meetings for each keyword, the first of those that begin alike."""
    own = reduce(DataFrame.unionByName, [readers.scan_meetings(turns, k, since, until, limit).rows for k in keywords])
    pairs = labeled_pairs(own.dropDuplicates(["issue_id", "speech_id", "ord"])).withColumn("_head", F.left("question", F.lit(120)))
    return keep_first(pairs, ["_head", "ministry", "date", "speaker"], "ord").select(*COLUMNS)


def _numbered(pairs: DataFrame) -> DataFrame:
    return numbered(pairs.select(*COLUMNS), ["date", "meeting", "url", "question", "answer"], "place")


def predict(pairs: DataFrame, question: str) -> dict:
    """Shares of the agencies for a question, and the most similar pairs."""
    asked = pairs.sparkSession.createDataFrame([(0, question)], "asked long, question string")
    shares = classify.question_shares(classify.similarities(asked, "asked", classify.train_centroids(pairs)))
    similar = classify.similar_rows(_numbered(pairs), "place", asked, "asked")
    shown = similar.withColumns({"question": F.left("question", F.lit(SHOWN_QUESTION)), "answer": F.left("answer", F.lit(SHOWN_ANSWER))}).drop("place", "asked")
    return {"predictions": [r.asDict() for r in shares.collect()], "evidence": [r.asDict() for r in shown.collect()]}


def evaluate(pairs: DataFrame) -> dict:
    """Trains on eight of every ten pairs and tests on the others."""
    own = classify.split(_numbered(pairs), F.col("place"))
    test = own.where("not is_train")
    found = classify.predictions(classify.similarities(test, "place", classify.train_centroids(own.where("is_train"))), "place")
    rows = test.select("place", F.col("ministry").alias("actual")).join(found, "place", "left")
    return classify.evaluation(rows).first().asDict() | {"confusion": [r.asDict() for r in classify.confusion_top(rows).collect()]}


def search(turns: DataFrame, question: str, terms: tuple[str, ...], since: str, year: int, yearly: bool) -> dict:
    """Candidates for a reviewer; with yearly also pairs that support the whole question, and their shares."""
    spark, turns = turns.sparkSession, readers.normalized_turns(turns)
    segment = icu_segmenter(spark)
    plan = make_plan(validate_request(question, since, terms), segment, terms)
    runs = touching_runs(turns, "speech", [*plan.groups, *plan.recall_groups], segment)
    found = retrieve_yearly(turns, plan, year, since or "2020-01-01", runs=runs, segment=segment) if yearly else retrieve_fast(turns, plan, year, since or "2001-01-01", runs=runs)
    rows = lambda df: [r.asDict() for r in df.collect()] if df is not None else []
    return {
        "concepts": [g.text for g in plan.groups], "searched": found.searched, "scans": found.scans, "hits": found.hits, "meetings": found.meetings,
        "search_limited": found.search_limited, "historical_only": found.historical_only, "recent_since": found.recent_since,
        "candidates": rows(found.candidates), "pairs": rows(found.pairs), "shares": rows(found.shares),
    }


def assignments(turns: DataFrame, question: str, terms: list[str], since: str = SINCE) -> dict:
    """The local tool's search, as what it answers: an error and nothing found where the request is wrong."""
    try:
        found = search_assignments(turns, question, terms, since)
    except ValueError as e:
        return {"error": str(e), "shares": [], "evidence": []}
    return {
        "searched_terms": found.searched, "focused_query": found.focused, "meetings_searched": found.meetings, "candidate_count": found.found,
        "candidates": [r.asDict() for r in found.candidates.drop("issue_id", "question_id", "ord").collect()],
    }


def analysis(turns: DataFrame, question: str) -> dict:
    """Shares of agencies for a question, with evidence."""
    found = analyze(turns, question, icu_segmenter(turns.sparkSession))
    shares = [r.asDict() for r in found.shares.orderBy(F.desc("percent"), "ministry").collect()]
    return {"shares": shares, "evidence": [r.asDict() for r in found.evidence.collect()], "searched": found.searched, "pairs": found.questions}


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="colloquy", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("collect", "predict", "evaluate", "csv", "search", "assignments", "analyze"))
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--keyword", action="append", default=[])
    parser.add_argument("--term", action="append", default=[])
    parser.add_argument("--question", default="")
    parser.add_argument("--since", default="")
    parser.add_argument("--until", default="")
    parser.add_argument("--limit", type=int, default=readers.MEETINGS)
    parser.add_argument("--year", type=int, default=0)
    parser.add_argument("--yearly", action="store_true")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("colloquy").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "collect":
        out = {"pairs": sinks.write_jsonl(collect(readers.read_meetings(spark, a.paths[0]), a.keyword, a.since or None, a.until or None, a.limit), a.paths[1])}
    elif a.command == "csv":
        sinks.write_csv(readers.read_labeled(spark, a.paths[0]), a.paths[1], COLUMNS)
        out = {"written": a.paths[1]}
    elif a.command == "predict":
        out = predict(readers.read_labeled(spark, a.paths[0]), a.question)
    elif a.command == "evaluate":
        out = evaluate(readers.read_labeled(spark, a.paths[0]))
    elif a.command == "assignments":
        out = assignments(readers.read_meetings(spark, a.paths[0]), a.question, a.term, a.since or SINCE)
    elif a.command == "analyze":
        out = analysis(readers.read_meetings(spark, a.paths[0]), a.question)
    else:
        out = search(readers.read_meetings(spark, a.paths[0]), a.question, tuple(a.term), a.since, a.year, a.yearly)
    print(json.dumps(out, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
