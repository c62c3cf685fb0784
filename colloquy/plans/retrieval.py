"""Retrieval: which turns and meetings of a corpus a plan looks at, within a budget of scans.

The loop runs on the driver and only decides from counts and short lists; every scan, pairing and ranking is a Spark job. Turns may
be a table or a written index, and a cache of scans may be given.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import rules
from colloquy.caches import SourceCache
from colloquy.operators import roles
from colloquy.operators.passages import best_recall
from colloquy.operators.ranking import diversified, keep_last, meeting_ranks
from colloquy.operators.shares import fractional_shares
from colloquy.operators.turns import contiguous_runs, held_for_context, recall_pairs, strict_pairs
from colloquy.plans.plan import Plan, Segmenter
from colloquy.sources import readers
from colloquy.sources.grams import GramIndex
from colloquy.staging import staged

FAST_SCANS, FAST_ROWS, YEARLY_SCANS = 3, 96, 14
ENOUGH_CASES, ENOUGH_MEETINGS, STRONG = 12, 3, 0.75


@dataclass
class Retrieval:
    candidates: DataFrame | None = None
    pairs: DataFrame | None = None
    shares: DataFrame | None = None
    searched: list[tuple[str, str, str]] = field(default_factory=list)
    scans: int = 0
    hits: int = 0
    meetings: list[str] = field(default_factory=list)
    search_limited: bool = False
    historical_only: bool = False
    recent_since: str = ""


def recent_since(year: int) -> str:
    return f"{year - 2}-01-01"


def evidence(strong: DataFrame, case: Column, meeting: Column, cases: int = ENOUGH_CASES, meetings: int = ENOUGH_MEETINGS) -> DataFrame:
    """One row: how many different cases and meetings there are, and whether that is enough."""
    own = strong.agg(F.count_distinct(case).alias("cases"), F.count_distinct(meeting).alias("meetings"))
    return own.withColumn("enough", (F.col("cases") >= cases) & (F.col("meetings") >= meetings))


def sufficient(candidates: DataFrame) -> bool:
    """Enough different cases and meetings among strong candidates that aren't held back."""
    strong = candidates.where((F.col("retrieval_score") >= STRONG) & ~held_for_context(candidates))
    return evidence(strong, F.col("case_id"), F.split("case_id", ":")[0]).first()["enough"]


def only_old(date: Column, since: str) -> Column:
    """Are all dates of a group known and before a day? Null where there are none to tell by."""
    return F.bool_and((date != "") & (date < since))


def historical_only(candidates: DataFrame, since: str) -> bool:
    row = candidates.agg(F.count("*").alias("n"), only_old(F.col("date"), since).alias("old")).first()
    return bool(row["n"] and row["old"])


def recall_ranks(turns: DataFrame, plan: Plan, limit: int = 4, runs: dict | None = None, counts: bool = True) -> DataFrame:
    """Meetings ranked by their matching questions and answers."""
    args = (F.col("speaker_role"), F.col("speaker_position"), F.col("speech"))
    own = turns.where(F.coalesce("issue_id", F.lit("")) != "").where(F.coalesce("speech_id", F.lit("")) != "").where(~roles.is_chair(*args))
    own = own.withColumn("asks", roles.is_questioner(F.col("speaker_group"), *args))
    own = own.where(F.col("asks") | roles.answering_agency(F.col("speaker_position"), F.col("speech")).isNotNull())
    best = best_recall(own, ["issue_id", "speech_id", "asks"], "speech", plan, runs)
    return meeting_ranks(best, "issue_id", "speech_id", F.col("asks"), F.col("score"), limit, counts)


def _diverse(pairs: DataFrame, limit: int) -> DataFrame:
    bucket = F.coalesce(F.nullif(F.split("case_id", ":")[0], F.lit("")), F.nullif("meeting", F.lit("")), F.nullif("date", F.lit("")), F.lit("unknown"))
    return diversified(pairs.withColumn("bucket", bucket), limit, score="retrieval_score", date="date").drop("bucket", "ord")


def latest(scans: list[DataFrame]) -> DataFrame:
    """The rows of some scans; of those of one turn the last one found, at the place of the first. Turns without an id all count."""
    parts = [s.withColumn("_found", F.struct(F.lit(i).alias("scan"), "ord")) for i, s in enumerate(scans)]
    rows = reduce(DataFrame.unionByName, parts)
    named = F.coalesce("speech_id", F.lit("")) != ""
    return keep_last(rows.where(named), ["speech_id"], "_found").unionByName(rows.where(~named)).drop("_found")


def retrieve_fast(turns: DataFrame | GramIndex, plan: Plan, year: int, since: str = "2001-01-01", max_scans: int = FAST_SCANS, excluded: list[str] | None = None, runs: dict | None = None, cache: SourceCache | None = None) -> Retrieval:
    """Turn scans with the plan's first two queries, each widened by whole meetings of the committees that rank best, until there
    are enough candidates. Whole meetings take the place of the runs of single turns found of them. turns: normalized."""
    out, budget = Retrieval(recent_since=recent_since(year)), max(0, min(FAST_SCANS, max_scans))
    pool: DataFrame | None = None
    full: DataFrame | None = None
    made: dict[int, DataFrame] = {}
    queries, done = list(dict.fromkeys(plan.queries))[:2], 0

    def sample() -> DataFrame:
        """The candidates of what has been scanned so far, worked out once for every number of scans."""
        if out.scans not in made:
            made[out.scans] = staged(candidates())
        return made[out.scans]

    def candidates() -> DataFrame:
        own = contiguous_runs(pool, "issue_id", "speech_id", "speech_order", "ord").withColumn("issue_run", F.concat_ws("#", "issue_id", F.col("run").cast("string"))).drop("run")
        if full is not None:
            own = own.join(full.select("issue_id").distinct(), "issue_id", "left_anti").unionByName(full.withColumn("issue_run", F.col("issue_id")))
        # an exchange may not bridge a gap, so a run counts as a meeting of its own; its cases keep the meeting's id
        pairs = recall_pairs(own.withColumn("issue_id", F.col("issue_run")).drop("issue_run"), plan, runs, nfkc=False)
        return _diverse(pairs.withColumn("case_id", F.regexp_replace("case_id", r"#\d+(?=:)", "")), FAST_ROWS)

    enough = False
    for query in queries:
        if enough or out.scans >= budget:
            break
        scan = readers.scan_turns(turns, query, since, f"{year}-12-31", excluded=excluded, cache=cache)
        out.scans, out.hits, out.search_limited, done = out.scans + 1, out.hits + scan.hits, out.search_limited or scan.truncated, done + 1
        out.searched.append((query, since, f"{year}-12-31"))
        pool = scan.rows if pool is None else pool.unionByName(scan.rows)
        enough = sufficient(sample())
        if not enough and out.scans < budget and not scan.rows.isEmpty():
            ranked = recall_ranks(scan.rows, plan, 20, runs).join(scan.rows.groupBy("issue_id").agg(F.min("meeting").alias("meeting"), F.min(F.nullif("date", F.lit(""))).alias("date")), "issue_id").collect()
            ranked.sort(key=lambda r: (-r["has_question"], -(r["question_matches"] + min(r["answer_matches"], 4)), -r["score"], r["issue_id"]))
            committees = list(dict.fromkeys(r["meeting"] for r in ranked if r["meeting"] and r["meeting"] != rules.PLENARY))[:3]
            first = scan.rows.agg(F.min(F.nullif("date", F.lit("")))).first()[0]
            wide = readers.scan_meetings(turns, query, max(filter(None, (first, since))), f"{year}-12-31", meetings=committees or None, excluded=excluded, cache=cache)
            out.scans, out.search_limited = out.scans + 1, out.search_limited or wide.truncated
            full = wide.rows if full is None else full.unionByName(wide.rows.join(full.select("issue_id").distinct(), "issue_id", "left_anti"))
            enough = sufficient(sample())
    if pool is not None:
        out.candidates = sample()
        out.search_limited |= out.scans >= budget and not enough and len(queries) > done
        out.historical_only = historical_only(out.candidates, out.recent_since)
    if full is not None:
        out.meetings = [r[0] for r in full.select("issue_id").distinct().orderBy("issue_id").collect()]
    return out


def retrieve_yearly(turns: DataFrame | GramIndex, plan: Plan, year: int, since: str = "2020-01-01", max_scans: int = YEARLY_SCANS, excluded: list[str] | None = None, include_older: bool = False, runs: dict | None = None, segment: Segmenter | None = None, cache: SourceCache | None = None) -> Retrieval:
    """A scan for each of the last three years and query, then four whole meetings: the best of each year before the best of the
    rest. Without candidates the years before are searched once."""
    out, budget = Retrieval(recent_since=recent_since(year)), max(0, min(YEARLY_SCANS, max_scans))
    recent = [(max(since, f"{y}-01-01"), f"{y}-12-31") for y in range(year, year - 3, -1) if since <= f"{y}-12-31"]
    older = [(since, f"{year - 3}-12-31")] if since < out.recent_since else []
    chosen: dict[str, None] = {}

    def search(periods: list[tuple[str, str]]) -> None:
        most = min(8 if any(a >= out.recent_since for a, _ in periods) else 10, max(0, budget - 1))
        second = plan.queries[1:2] if plan.recall_groups else [plan.groups[1].text] if len(plan.groups) > 1 else list(plan.queries[-1:])
        first = list(dict.fromkeys([*plan.queries[:1], *second]))
        pools: dict[tuple[str, str], list[DataFrame]] = {}

        def scan(queries: list[str]) -> None:
            for query in queries:
                for period in periods:
                    if out.scans >= most:
                        out.search_limited = True
                        return
                    got = readers.scan_turns(turns, query, *period, excluded=excluded, cache=cache)
                    out.scans, out.hits, out.search_limited = out.scans + 1, out.hits + got.hits, out.search_limited or got.truncated
                    out.searched.append((query, *period))
                    pools.setdefault(period, []).append(got.rows)

        def rank() -> list[list]:
            return [recall_ranks(latest(pools[p]), plan, 4, runs).collect() for p in periods if p in pools]

        scan(first)
        ranked = rank()
        if not any(ranked):
            scan([q for q in plan.queries if q not in first])
            ranked = rank()
        own = {r[0]["issue_id"]: None for r in ranked if r}
        rest = sorted((r for rows in ranked for r in rows), key=lambda r: (-r["has_question"], -r["score"], r["issue_id"]))
        for r in rest:
            if len(own) < 4:
                own.setdefault(r["issue_id"])
        out.search_limited |= any(r["issue_id"] not in own for r in rest)
        for issue in own:
            if out.scans >= budget:
                out.search_limited = True
                break
            out.scans += 1
            chosen[issue] = None

    made: dict[tuple[str, ...], tuple[DataFrame, DataFrame]] = {}

    def found() -> tuple[DataFrame, DataFrame]:
        """The turns of the chosen meetings, read once, and their candidates."""
        if tuple(chosen) not in made:
            own = staged(readers.meetings_by_id(turns, list(chosen)))
            made[tuple(chosen)] = own, staged(_diverse(recall_pairs(own, plan, runs, nfkc=False), 12))
        return made[tuple(chosen)]

    search(recent + older if include_older else recent)
    if not include_older and older and out.scans < min(10, budget - 1) and (not chosen or found()[1].isEmpty()):
        search(older)
        out.historical_only = True
    if chosen:
        own, out.candidates = found()
        out.pairs = strict_pairs(own, plan, runs, nfkc=False, segment=segment)
        out.shares = fractional_shares(out.pairs, "case_id", "ministry")
        out.historical_only &= not out.candidates.isEmpty()
    out.meetings = list(chosen)
    return out
