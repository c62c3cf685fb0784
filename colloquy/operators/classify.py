"""The centroid classifier: bags of tokens for each label, cosine, shares, and how well it does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import bag, tokenize
from colloquy.operators.scoring import bag_cosine
from colloquy.operators.shares import score_shares
from colloquy.staging import staged

#: Rows of the centroids, of their commonest tokens, that meet every row's bag by a broadcast.
MOST_COMMON = 262_144


def split(rows: DataFrame, place: Column, ratio: float = 0.8) -> DataFrame:
    """rows with is_train: of every ten places the first int(ratio * 10)."""
    return rows.withColumn("is_train", place % 10 < int(ratio * 10))


def token_counts(rows: DataFrame, key: list[str], tokens: Column) -> DataFrame:
    """(key, token, n) of an array of tokens."""
    return rows.select(*key, F.explode(tokens).alias("token")).groupBy(*key, "token").agg(F.count("*").alias("n"))


def train_centroids(rows: DataFrame, label: str = "ministry", text: str | None = None, tokens: Column | None = None) -> DataFrame:
    """(label, token, n) over the rows of each label."""
    return token_counts(rows, [label], tokens if tokens is not None else tokenize(F.col(text or "question")))


def _common(centroids: DataFrame, most: int) -> DataFrame:
    """The centroids' rows of their commonest tokens, about `most` of them: those that some label has often enough.

    How often that is comes from how many rows there are of each count, which are few; no rows are sorted or cut off within a count.
    """
    counts = centroids.groupBy("n").agg(F.count("*").alias("_rows"))
    down = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    least = counts.withColumn("_so_far", F.sum("_rows").over(down)).where(F.col("_so_far") <= most).agg(F.min("n")).first()[0]
    often = centroids.where(F.col("n") >= least if least is not None else F.lit(False)).select("token").distinct()
    return centroids.join(F.broadcast(often), "token", "left_semi")


def similarities(rows: DataFrame, key: str, centroids: DataFrame, label: str = "ministry", text: str | None = None, tokens: Column | None = None, most: int = MOST_COMMON) -> DataFrame:
    """(key, label, cosine) for rows and labels that share a token. Rows with one key are one text; those without are left out.

    A row's bag is counted where the row is and meets the commonest tokens of the centroids there, which are broadcast and bounded by
    `most`, so nearly all of it ends as sums for each key and label. Only what is left, rare tokens, is shuffled to the rest of the
    centroids; how much is sent doesn't jump where a vocabulary outgrows a broadcast. Lengths of rows that share a key, which aren't
    sums, come from their tokens put together.
    """
    rows, centroids = rows.where(F.col(key).isNotNull()), staged(centroids.select(label, "token", "n"))
    tokens = tokens if tokens is not None else tokenize(F.col(text or "question"))
    square = F.aggregate("_bag", F.lit(0).cast("long"), lambda a, t: a + t["n"] * t["n"])
    own = rows.select(key, bag(tokens).alias("_bag")).select(key, F.explode(F.array(F.struct("_bag", square.alias("_square")))).alias("_own"))
    own = own.select(key, "_own._square", F.inline("_own._bag").alias("token", "_n"))
    common = staged(_common(centroids, most))
    met = own.join(F.broadcast(common.withColumn("_met", F.lit(True))), "token", "left").withColumn("_rare", F.when(F.col("_met").isNull(), F.col("token")))
    met = staged(met.groupBy(key, label, "_rare").agg(F.sum(F.col("_n") * F.coalesce("n", F.lit(1))).alias("_sum"), F.max("_square").alias("_square")))
    rest = centroids.join(F.broadcast(common.select("token").distinct()), "token", "left_anti").withColumnRenamed("token", "_rare")
    rare = met.where("_rare is not null").drop(label).join(rest, "_rare").select(key, label, (F.col("_sum") * F.col("n")).alias("_sum"), "_square")
    dots = met.where("_rare is null").drop("_rare").unionByName(rare).groupBy(key, label).agg(F.sum("_sum").alias("_dot"), F.max("_square").alias("_square"))
    again = staged(rows.groupBy(key).count().where("count > 1").select(key))
    merged = token_counts(rows.join(again, key, "left_semi"), [key], tokens).groupBy(key).agg(F.sum(F.col("n") * F.col("n")).alias("_merged"))
    lengths = centroids.groupBy(label).agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("_length"))
    found = dots.join(staged(merged), key, "left").join(staged(lengths), label)
    return found.select(key, label, (F.col("_dot") / (F.sqrt(F.coalesce("_merged", "_square").cast("double")) * F.col("_length"))).alias("cosine"))


def predictions(scores: DataFrame, key: str, label: str = "ministry") -> DataFrame:
    """(key, predicted, cosine): the label with the highest cosine, compared to 9 digits; ties by name. A row without any has no prediction."""
    best = Window.partitionBy(key).orderBy(F.desc(F.round("cosine", 9)), label)
    return scores.where("cosine > 0").withColumn("_nth", F.row_number().over(best)).where("_nth = 1").select(key, F.col(label).alias("predicted"), "cosine")


def question_shares(scores: DataFrame, label: str = "ministry", topn: int = 5) -> DataFrame:
    """Shares of the labels for one question's scores."""
    return score_shares(scores, label, "cosine", topn)


def similar_rows(rows: DataFrame, key: str, question: DataFrame, question_key: str, text: str = "question", n: int = 8) -> DataFrame:
    """The n rows with the highest positive cosine to a question."""
    bags = token_counts(rows, [key], tokenize(F.col(text)))
    own = token_counts(question, [question_key], tokenize(F.col(text)))
    found = bag_cosine(bags, key, own, question_key).where("cosine > 0").orderBy(F.desc("cosine"), key).limit(n)
    return rows.join(F.broadcast(found), key).orderBy(F.desc("cosine"), key)


def evaluation(rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row: total, covered, correct, coverage and accuracy over the covered rows (null if there are none)."""
    own = rows.agg(F.count("*").alias("total"), F.count(predicted).alias("covered"), F.count_if(F.col(actual) == F.col(predicted)).alias("correct"))
    return own.withColumn("coverage", F.when(F.col("total") > 0, F.round(F.col("covered") / F.col("total"), 4))).withColumn("accuracy", F.when(F.col("covered") > 0, F.round(F.col("correct") / F.col("covered"), 4)))


def confusion_top(rows: DataFrame, actual: str = "actual", predicted: str = "predicted", n: int = 12) -> DataFrame:
    """Of the n most common (actual, predicted) those that differ, so there may be fewer than n."""
    own = rows.where(F.col(predicted).isNotNull()).groupBy(actual, predicted).agg(F.count("*").alias("n"))
    return own.orderBy(F.desc("n"), actual, predicted).limit(n).where(F.col(actual) != F.col(predicted))
