"""Ranks, keep policies and top-k. Every order ends in a column that names the row, so ties are settled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.staging import staged


def keep_max(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_nth = 1").drop("_nth")


def keep_first(rows: DataFrame, key: list[str], ord_: str) -> DataFrame:
    return keep_max(rows, key, [F.asc(ord_)])


def keep_last(rows: DataFrame, key: list[str], ord_: str) -> DataFrame:
    """The last row of each key, at the place (ord_) of the first."""
    own = Window.partitionBy(*key)
    return keep_max(rows.withColumn("_first", F.min(ord_).over(own)), key, [F.desc(ord_)]).drop(ord_).withColumnRenamed("_first", ord_)


def union_with_precedence(parts: list[DataFrame], key: list[str], ord_: str) -> DataFrame:
    """All rows of the parts; for each key the first of the earliest part that has it."""
    numbered = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = numbered[0]
    for p in numbered[1:]:
        out = out.unionByName(p)
    return keep_max(out, key, [F.asc("_part"), F.asc(ord_)]).drop("_part")


def variants(rows: DataFrame, key: list[str], value: str, ord_: str, most: int = 4) -> DataFrame:
    """For each key its first `most` rows: the first is the representative, `value` of all of them is a list."""
    ranked = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(ord_))).where(F.col("_nth") <= most)
    lists = ranked.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", value))), lambda s: s[value]).alias("variants"))
    return ranked.where("_nth = 1").drop("_nth").join(lists, key)


def top_per_group(rows: DataFrame, key: list[str], order: list[Column], n: int = 4) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("nth") <= n)


def batches(rows: DataFrame, order: list[str], size: int = 8, prefix: str = "c") -> DataFrame:
    """rows with batch (from 0), id (c1, c2, ... over all) and batch_id (from 1 in each batch)."""
    own = numbered(rows, order, "_n").withColumn("batch", F.floor(F.col("_n") / size)).withColumn("id", F.concat(F.lit(prefix), (F.col("_n") + 1).cast("string")))
    return own.withColumn("batch_id", F.concat(F.lit(prefix), (F.col("_n") % size + 1).cast("string"))).drop("_n")


def named_in(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """The rows whose key is one of those allowed."""
    return rows.join(allowed.select(key), key, "left_semi")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place (from 0) in a total order, without sorting all of them in one task.

    A range sort is written once, each row with its task and its number in it; what stands before a task is a sum over the tasks
    before it, of which there is one row each. Both sides read what was written, so no plan can deal the rows anew.
    """
    dealt = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_rid", F.monotonically_increasing_id()))
    part, within = F.shiftright("_rid", 33), F.col("_rid").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(part.alias("_part")).count()
    sizes = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(sizes), part == F.col("_part")).withColumn(name, F.col("_before") + within).drop("_rid", "_part", "_before")


def meeting_ranks(hits: DataFrame, meeting: str, turn: str, asks: Column, score: Column, limit: int = 4, counts: bool = True) -> DataFrame:
    """Meetings by whether a question matched, how many questions and (up to four) answers did, and the best score.

    counts=False is the earlier order: whether a question matched, then the score.
    """
    own = hits.withColumn("_asks", asks).withColumn("_score", score)
    per = own.groupBy(meeting).agg(
        F.max("_score").alias("score"), F.bool_or("_asks").alias("has_question"),
        F.count_distinct(F.when(F.col("_asks"), F.col(turn))).alias("question_matches"), F.count_distinct(F.when(~F.col("_asks"), F.col(turn))).alias("answer_matches"),
    )
    strength = [F.desc(F.col("question_matches") + F.least(F.col("answer_matches"), F.lit(4)))] if counts else []
    return per.orderBy(F.desc("has_question"), *strength, F.desc("score"), meeting).limit(limit)


def best_meetings(hits: DataFrame, meeting: str, turn: str, score: str, limit: int = 4, per_meeting: int = 4) -> DataFrame:
    """Meetings by their best turn, each with the ids of its best turns."""
    best = top_per_group(keep_max(hits, [meeting, turn], [F.desc(score)]), [meeting], [F.desc(score), F.asc(turn)], per_meeting)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("nth", turn))), lambda s: s[turn])
    return best.groupBy(meeting).agg(F.max(score).alias("score"), ids.alias("turn_ids")).orderBy(F.desc("score"), meeting).limit(limit)


def reserve_per_group(rows: DataFrame, group: str, order: list[Column], limit: int = 4) -> DataFrame:
    """The first row of each group, then the best of the rest, up to the limit."""
    own = rows.withColumn("reserved", F.row_number().over(Window.partitionBy(group).orderBy(*order)) == 1)
    return own.orderBy(F.desc("reserved"), *order).limit(limit)


#: What a meeting's row gains while none of that meeting has been chosen; half of it after the first, a third after two.
BONUS = 0.15


def greedy(rows: list[tuple[str, float, tuple]], limit: int) -> list[int]:
    """Which of rows (meeting, score, case), given in order, are chosen one after the other: first of new cases, then of any."""
    queue: dict[str, list[int]] = {}
    for i, (meeting, _, _) in enumerate(rows):
        queue.setdefault(meeting, []).append(i)
    taken, chosen, cases, used = dict.fromkeys(queue, 0), [], set(), set()
    for new_cases in (True, False):
        at = dict.fromkeys(queue, 0)
        while len(chosen) < limit:
            best = None
            for meeting, own in queue.items():
                while at[meeting] < len(own) and (own[at[meeting]] in used or (new_cases and rows[own[at[meeting]]][2] in cases)):
                    at[meeting] += 1
                if at[meeting] < len(own):
                    rank = rows[own[at[meeting]]][1] + BONUS / (1 + taken[meeting])
                    if best is None or rank > best[0]:
                        best = rank, meeting
            if best is None:
                break
            i = queue[best[1]][at[best[1]]]
            chosen.append(i)
            used.add(i)
            cases.add(rows[i][2])
            taken[best[1]] += 1
    return chosen


def diversified(rows: DataFrame, limit: int = 24, case: str = "case_id", ministry: str = "ministry", url: str = "url", meeting: str = "bucket", score: str = "score", ord_: str = "ord", date: str | None = None) -> DataFrame:
    """rows with selection, from 1: the best row again and again, where meetings taken from less get a bonus.

    The order is score, newest date, meeting, ord; meetings compete in the order of their first rows. Of rows with one case,
    ministry and url the first counts; a case belongs to one meeting. A null meeting is one of its own, a null score is 0.
    A meeting can give at most `limit` rows in either pass, so Spark first keeps its best `limit` cases and its best `limit` rows,
    and of these meetings the `limit` best by their first row; only limit * limit * 2 rows at most reach the sequential choice.
    """
    rows = rows.withColumn("_score", F.coalesce(F.col(score).cast("double"), F.lit(0.0))).withColumn("_meeting", F.coalesce(F.col(meeting).cast("string"), F.lit("")))
    order = [F.desc("_score"), *([F.desc(date)] if date else []), F.asc("_meeting"), F.asc(ord_)]
    rows = keep_max(rows, [case, ministry, url], order)
    fresh = keep_max(rows, ["_meeting", case, ministry], order)
    fresh = top_per_group(fresh, ["_meeting"], order, limit).drop("nth")
    most = top_per_group(rows, ["_meeting"], order, limit).drop("nth")
    kept = keep_max(fresh.unionByName(most), [case, ministry, url], order)
    heads = keep_max(kept, ["_meeting"], order).orderBy(*order).limit(limit)
    kept = kept.join(heads.select("_meeting"), "_meeting", "left_semi").select(*rows.columns)
    kept = staged(kept.withColumn("_nth", F.row_number().over(Window.orderBy(*order))))

    def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [p for p in parts if not p.empty]
        if every:
            every = pd.concat(every, ignore_index=True).sort_values("_nth", ignore_index=True)
            cases = zip(every[case], every[ministry], strict=True)
            chosen = greedy(list(zip(every["_meeting"], every["_score"], cases, strict=True)), limit)
            yield every.loc[chosen, ["_nth"]].assign(selection=range(1, len(chosen) + 1))

    # Only what decides goes to Python; texts and the rest are taken from what was written.
    chosen = kept.select("_nth", "_meeting", "_score", case, ministry).repartition(1).mapInPandas(choose, "_nth int, selection int")
    return kept.join(F.broadcast(chosen), "_nth").drop("_score", "_meeting", "_nth")
