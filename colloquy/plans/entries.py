"""What a caller asks for in one go: the local tool's search for pairs, and the starter route's analysis of a question.

Both validate what they are given, scan for meetings, pair turns and give tables; ValueError says what is wrong with a request.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import rules
from colloquy.caches import SourceCache
from colloquy.operators.shares import weighted_shares
from colloquy.operators.turns import route_pairs, tool_pairs
from colloquy.plans.plan import Segmenter, terms
from colloquy.sources import readers
from colloquy.sources.grams import GramIndex
from colloquy.staging import staged

SINCE = "2020-01-01"
TOOL_QUESTION, TOOL_TERMS, TOOL_TERM, TOOL_MEETINGS, TOOL_CANDIDATES = (8, 1200), 2, 80, 10, 30
ROUTE_QUESTION, ROUTE_KEYWORDS, ROUTE_MEETINGS, ROUTE_EVIDENCE = (12, 1200), 2, 6, 8


@dataclass
class Assignments:
    """Candidates of the tool's search, the most relevant first, and how they were looked for."""

    candidates: DataFrame
    found: int
    meetings: int
    focused: str
    searched: list[str] = field(default_factory=list)


def asked_terms(given: list[str]) -> list[str]:
    """The first different terms that aren't blank, with single blanks and cut to their length."""
    own = dict.fromkeys(t for t in (" ".join(str(g).split())[:TOOL_TERM] for g in given) if t)
    return list(own)[:TOOL_TERMS]


def search_assignments(turns: DataFrame | GramIndex, question: str, search_terms: list[str], since: str = SINCE, cache: SourceCache | None = None) -> Assignments:
    """Pairs of a question and a reply near two terms, in the newest meetings that hold both; if there are none, in those that hold either."""
    length = len(" ".join((question or "").split()))
    if not TOOL_QUESTION[0] <= length <= TOOL_QUESTION[1]:
        raise ValueError(f"question: {TOOL_QUESTION[0]} to {TOOL_QUESTION[1]} characters")
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", since):
        raise ValueError("since: a date as YYYY-MM-DD")
    own = asked_terms(search_terms)
    if not own:
        raise ValueError("search_terms: one at least")
    focused = " ".join(own)
    searched, found = [focused], readers.scan_meetings(turns, focused, since, limit=TOOL_MEETINGS, cache=cache).rows
    if len(own) > 1 and found.isEmpty():
        for term in own:
            rows = readers.scan_meetings(turns, term, since, limit=TOOL_MEETINGS, cache=cache).rows
            found = found.unionByName(rows.join(found.select("issue_id").distinct(), "issue_id", "left_anti"))
            searched.append(term)
        found = staged(found)
    pairs = staged(tool_pairs(found, own))
    order = [F.desc("relevance"), F.desc("date"), F.asc("issue_id"), F.asc("ord")]
    return Assignments(pairs.orderBy(*order).limit(TOOL_CANDIDATES), pairs.count(), found.select("issue_id").distinct().count(), focused, searched)


@dataclass
class Analysis:
    """Shares of agencies (ministry, percent, n), the most similar pairs, how many questions they are of, and the words searched."""

    shares: DataFrame
    evidence: DataFrame
    questions: int
    searched: list[str]


def analyze(turns: DataFrame | GramIndex, question: str, segment: Segmenter, cache: SourceCache | None = None) -> Analysis:
    """Which agencies answered questions like this one: a question's weight is its similarity, split between those who answered it.

    The two longest words are searched one after the other, until one has meetings; words of one length stay in their order.
    """
    text = (question or "").strip()
    if not ROUTE_QUESTION[0] <= len(text) <= ROUTE_QUESTION[1]:
        raise ValueError(f"question: {ROUTE_QUESTION[0]} to {ROUTE_QUESTION[1]} characters")
    words = terms(text, segment, rules.ROUTE_STOPWORDS)
    if not words:
        raise ValueError("question: no word to search for")
    searched: list[str] = []
    for word in sorted(words, key=len, reverse=True)[:ROUTE_KEYWORDS]:
        searched.append(word)
        found = readers.scan_meetings(turns, word, SINCE, limit=ROUTE_MEETINGS, cache=cache).rows
        if not found.isEmpty():
            break
    pairs = staged(route_pairs(found, words))
    case = [F.coalesce(c, F.lit("")).alias(c) for c in ("date", "meeting", "question")]
    own = pairs.select(*case, "ministry", "score", "ord")
    counts = own.select("date", "meeting", "question", "ministry").distinct().groupBy("ministry").agg(F.count("*").alias("n"))
    shares = weighted_shares(own, ["date", "meeting", "question"], "ministry", "score", "ord").join(counts, "ministry").select("ministry", "percent", "n")
    evidence = pairs.orderBy(F.desc("score"), "issue_id", "ord").limit(ROUTE_EVIDENCE)
    return Analysis(shares, evidence, own.select("date", "meeting", "question").distinct().count(), searched)
