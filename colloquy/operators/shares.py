"""How cases are shared between agencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import js_round


def fractional_shares(pairs: DataFrame, case: str, agency: str, name: str = "ministry") -> DataFrame:
    """(name, percent, n): each case counts 1, split equally between its distinct agencies.

    Percents are rounded half up; the first by percent and name takes what is missing to 100 and keeps its place.
    """
    own = pairs.select(F.col(case).alias("_case"), F.col(agency).alias(name)).where(F.col("_case").isNotNull() & F.col(name).isNotNull()).distinct()
    per_case = own.groupBy("_case").agg(F.count("*").alias("_n"), F.collect_set(name).alias("_names"))
    weight = per_case.select(F.explode("_names").alias(name), (1 / F.col("_n")).alias("_w"))
    per = weight.groupBy(name).agg(F.sum("_w").alias("_w"), F.count("*").alias("n"))
    cases = per_case.agg(F.count("*").alias("_cases"))
    per = per.join(F.broadcast(cases)).withColumn("percent", js_round(F.col("_w") / F.col("_cases") * 100))
    return _with_remainder(per, name, [F.desc("percent"), F.asc(name)]).select(name, "percent", "n")


def _with_remainder(per: DataFrame, name: str, order: list[Column], percent: str = "percent") -> DataFrame:
    """One row takes what is missing to 100. per has one row for each agency."""
    every = Window.partitionBy()
    first = F.row_number().over(Window.orderBy(*order)) == 1
    own = per.withColumn("_first", first).withColumn("_rest", 100 - F.sum(percent).over(every))
    return own.withColumn(percent, F.col(percent) + F.when(F.col("_first"), F.col("_rest")).otherwise(F.lit(0)))


def weighted_shares(pairs: DataFrame, case: list[str], agency: str, score: str, ord_: str, name: str = "ministry", least: float = 0.05) -> DataFrame:
    """(name, percent): a case weighs its first row's score, at least `least`, split between its distinct agencies; ties by name."""
    own = pairs.groupBy(*case).agg(F.greatest(F.min_by(score, ord_), F.lit(least)).alias("_w"), F.collect_set(agency).alias("_names"))
    per = own.select(F.explode("_names").alias(name), (F.col("_w") / F.size("_names")).alias("_w")).groupBy(name).agg(F.sum("_w").alias("_w"))
    per = per.withColumn("percent", js_round(F.col("_w") / F.sum("_w").over(Window.partitionBy()) * 100))
    return _with_remainder(per, name, [F.desc("percent"), F.asc(name)]).select(name, "percent")


def score_shares(scores: DataFrame, name: str, score: str, topn: int = 5, keep_tail: bool = True) -> DataFrame:
    """(name, score, percent): the topn scores as shares of the sum over all names, to one decimal (halves to even).

    keep_tail: the first also takes the share of the names that were left out (the earliest rule), else it stays out.
    """
    own = scores.where(F.col(score) > 0).withColumn("percent", F.bround(F.col(score) / F.sum(score).over(Window.partitionBy()) * 100, 1))
    own = own.orderBy(F.desc(score), name).limit(topn)
    if keep_tail:
        own = _with_remainder(own, name, [F.desc(score), F.asc(name)]).withColumn("percent", F.bround("percent", 1))
    return own.select(name, score, "percent")
