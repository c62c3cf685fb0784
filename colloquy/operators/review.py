"""Reviews of candidates: validated, reconciled with the candidates and their sources, and counted.

A reviewer (a language model, say) is a callback on batches of candidates; what it says is checked here and never trusted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import rules
from colloquy.operators.ranking import keep_last, numbered
from colloquy.staging import staged

FIELDS = ("id", "beneficiary", "activity", "relation", "comparison", "decision", "q", "a")
MOST_COMPARISON = 300
MOST_SCOPE_CHECKS = 8
PRECEDENCE = ("verified", "pending", "rejected")


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def repaired(reviews: DataFrame) -> DataFrame:
    """An explicit reject or uncertain may leave its references out; nothing else is mended."""
    free = F.col("decision").isin("reject", "uncertain")
    return reviews.withColumns({c: F.when(F.col(c).isNull() & free, F.lit("")).otherwise(F.col(c)) for c in ("q", "a")})


def failure(known: Column, nth: Column) -> Column:
    """Why a review row is invalid, the first reason that holds; null for a valid one. nth: its number among rows of its id."""
    semantic = F.col("beneficiary").isNull() | F.col("activity").isNull() | F.col("relation").isNull() | F.col("comparison").isNull() | F.col("decision").isNull()
    return (
        F.when(semantic, "missing_semantic_field")
        .when((F.col("decision") == "accept") & (F.col("q").isNull() | F.col("a").isNull()), "accepted_without_reference")
        .when(F.col("q").isNull() | F.col("a").isNull() | F.col("id").isNull(), "invalid_row")
        .when(~known, "unknown_id")
        .when(nth > 1, "duplicate_id")
        .when(~F.col("decision").isin(*rules.DECISIONS), "invalid_decision")
        .when(blank(F.col("comparison")), "blank_comparison")
        .when(F.length("comparison") > MOST_COMPARISON, "long_comparison")
        .when(~F.col("relation").isin(*rules.RELATIONS), "invalid_relation")
        .when((F.col("decision") == "accept") & (F.col("relation") == "same") & (blank(F.col("beneficiary")) | blank(F.col("activity"))), "accepted_without_roles")
        .when((F.col("decision") == "accept") & (F.col("relation") == "same") & (blank(F.col("q")) | blank(F.col("a"))), "accepted_without_reference")
    )


def decide(decision: Column, relation: Column) -> Column:
    """What a valid row says: an unclear relation, or an accept of anything but the same, is uncertain."""
    unclear = (relation == "unclear") | ((decision == "accept") & (relation != "same"))
    return F.when(unclear, "uncertain").when(relation != "same", "reject").otherwise(decision)


def checked(reviews: DataFrame, candidates: DataFrame, ord_: str = "ord") -> DataFrame:
    """reviews with nth (of its id) and reason (why it is invalid). candidates: (id)."""
    own = repaired(reviews).withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(ord_)))
    ids = candidates.select(F.col("id").alias("_id")).distinct().withColumn("_known", F.lit(True))
    own = own.join(ids, F.col("id") == F.col("_id"), "left")
    return own.withColumn("reason", failure(F.coalesce("_known", F.lit(False)), F.col("nth"))).drop("_id", "_known")


def reconcile(candidates: DataFrame, reviews: DataFrame, parts: DataFrame, ord_: str = "ord", strict: bool = False) -> DataFrame:
    """(id, decision, reason, completed, question_evidence, answer_evidence) for every candidate.

    parts: (id, part_id, text), the sentences a candidate may cite. A candidate without a valid row, with two rows, or that cites
    a part which isn't its own is uncertain. strict, the earliest rule: any invalid row or missing candidate voids the batch.
    """
    own = checked(reviews, candidates, ord_)
    twice = own.groupBy("id").agg((F.count("*") > 1).alias("_twice")).withColumnRenamed("id", "_of")
    valid = own.where("reason is null").select("id", "q", "a", decide(F.col("decision"), F.col("relation")).alias("said"))
    q, a = (parts.select(F.col("id").alias(f"_{n}id"), F.col("part_id").alias(f"_{n}part"), F.col("text").alias(f"{n}_text")) for n in "qa")
    valid = valid.join(q, (F.col("id") == F.col("_qid")) & (F.col("q") == F.col("_qpart")), "left").join(a, (F.col("id") == F.col("_aid")) & (F.col("a") == F.col("_apart")), "left")
    valid = valid.select(F.col("id").alias("_vid"), "said", "q_text", "a_text")
    out = candidates.select("id").join(valid, F.col("id") == F.col("_vid"), "left").join(twice, F.col("id") == F.col("_of"), "left")
    foreign = (F.col("said") == "accept") & (F.col("q_text").isNull() | F.col("a_text").isNull())
    void = F.coalesce("_twice", F.lit(False))
    done = F.col("said").isNotNull() & ~void & ~F.coalesce(foreign, F.lit(False))
    reason = F.when(F.col("said").isNull() & ~void, "missing").when(void, "duplicate_id").when(foreign, "foreign_reference")
    out = out.select("id", F.when(done, F.col("said")).otherwise("uncertain").alias("decision"), reason.alias("reason"), done.alias("completed"), F.when(done, F.col("q_text")).alias("question_evidence"), F.when(done, F.col("a_text")).alias("answer_evidence"))
    if not strict:
        return out
    bad = own.agg((F.count_if(F.col("reason").isNotNull()) > 0).alias("_bad")).join(out.agg((F.count_if(F.col("reason") == "missing") > 0).alias("_short")))
    out = out.join(F.broadcast(bad))
    failed = F.col("_bad") | F.col("_short")
    cleared = {c: F.when(~failed, F.col(c)) for c in ("question_evidence", "answer_evidence")}
    return out.withColumns({**cleared, "decision": F.when(failed, "uncertain").otherwise(F.col("decision")), "completed": F.col("completed") & ~failed, "reason": F.when(failed, "batch_failed").otherwise(F.col("reason"))}).drop("_bad", "_short")


def failure_counts(checked_rows: DataFrame) -> DataFrame:
    return checked_rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def outcome_counts(reviewed: DataFrame, decision: str = "decision") -> DataFrame:
    """One row: accepted, rejected, uncertain, completed."""
    counts = {"accepted": f"{decision} = 'accept'", "rejected": f"{decision} = 'reject'", "uncertain": f"{decision} = 'uncertain'"}
    return reviewed.agg(*[F.count_if(F.expr(e)).alias(n) for n, e in counts.items()], F.count_if(F.col("completed")).alias("completed"))


def usage_totals(usage: DataFrame) -> DataFrame:
    """Sums of token counts that are whole numbers and not negative."""
    good = lambda c: F.sum(F.when((F.col(c) >= 0) & (F.col(c) == F.floor(c)) & (F.col(c) <= (1 << 53) - 1), F.col(c)).otherwise(F.lit(0)))
    return usage.agg(good("input_tokens").alias("input_tokens"), good("output_tokens").alias("output_tokens"))


def question_dictionary(candidates: DataFrame, question: str, ord_: str) -> DataFrame:
    """candidates with question_id; the first of those with one question carries its text, the others only refer to it.

    ord_ names a row. The first places are found by a grouped minimum, so a question that many rows share is in no single task.
    """
    own = candidates.withColumn("question_id", F.sha2(F.col(question), 256))
    first = staged(own.groupBy("question_id").agg(F.min(ord_).alias("_first")).withColumnRenamed("question_id", "_of"))
    own = own.join(first, F.col("question_id").eqNullSafe(F.col("_of")), "left")
    return own.withColumn(question, F.when(F.col(ord_) == F.col("_first"), F.col(question))).drop("_of", "_first")


def needs_scope_check(anchor: str, text: Column, evidence: Column, roles: Column) -> Column:
    """An accepted row whose anchor is missing from its text, the evidence cited or the roles."""
    has = lambda c: F.contains(F.coalesce(c, F.lit("")), F.lit(anchor))
    return ~has(text) | ~has(evidence) | ~has(roles)


def scope_budget(accepted: DataFrame, ambiguous: Column, order: list[str], budget: int = MOST_SCOPE_CHECKS) -> DataFrame:
    """accepted with scope: clear, check (the first `budget` ambiguous rows, batch after batch in order) or overflow (then uncertain).

    A row of which it isn't known whether it is ambiguous counts as ambiguous.
    """
    known = F.coalesce(ambiguous, F.lit(True))
    unsure = numbered(accepted.where(known), order, "_nth")
    unsure = unsure.withColumn("scope", F.when(F.col("_nth") < budget, "check").otherwise("overflow")).drop("_nth")
    return accepted.where(~known).withColumn("scope", F.lit("clear")).unionByName(unsure)


def merge_scope(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """rows (case_id, ministry) with outcome: verified before pending before rejected; a row without one is rejected."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PRECEDENCE]), F.col("outcome"))
    best = outcomes.groupBy("case_id", "ministry").agg(F.min_by("outcome", rank).alias("outcome"))
    return rows.join(best, ["case_id", "ministry"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("rejected")))


def accepted_unique(rows: DataFrame) -> DataFrame:
    """For each case and agency the last accepted row, at the place of the first."""
    return keep_last(rows, ["case_id", "ministry"], "ord")


class NotNow(RuntimeError):
    """What a reviewer raises where trying again is no use: a quota is used up, or the model is busy."""


def run_reviewer(candidates: DataFrame, reviewer: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch: str = "batch", parallel: int = 3, split: int | None = None) -> DataFrame:
    """Reviews of numbered batches of candidates, at most `parallel` at a time. A batch that fails is tried once more. split: a batch
    of so many that fails twice is then halved, and each half reviewed on its own, as the earlier policy did with four. What still
    fails gives no rows, so its candidates end as uncertain; NotNow isn't tried again."""

    def attempt(own: pd.DataFrame) -> pd.DataFrame | None:
        for _ in range(2):
            try:
                return reviewer(own)
            except NotNow:
                return None
            except (TimeoutError, ConnectionError, ValueError):
                continue
        if split and len(own) == split and split > 1:
            found = [f for f in (attempt(own.iloc[: split // 2]), attempt(own.iloc[split // 2 :])) if f is not None]
            return pd.concat(found) if found else None
        return None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [p for p in parts if len(p)]
        if every:
            for _, own in pd.concat(every).groupby(batch, sort=True):
                found = attempt(own)
                if found is not None:
                    yield found

    return candidates.repartition(parallel, batch).mapInPandas(run, schema)
