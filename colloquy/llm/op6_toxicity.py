"""Toxicity classifier on bags of subword vectors averaged into a linear softmax.

Features are the lower-cased words (runs of letters and digits) and runs of 3 to 5 bytes of each word, so a misspelling that was
never seen shares vectors with the word it stands for. Vectors are averaged over passages of 64 words, a word said again at once
counting once, and a document's score is that of its likeliest passage: a few such words are found in a text of any length.
Vectors and softmax are trained together by numpy gradient descent on a bounded sample of labelled rows (MOST of label 1, twice
as many of label 0, the first by a hash of doc_id), never on held-out rows; a fifth of the sample calibrates the odds.

Scores use the text alone. Nulls and empty texts have no features and get the score of the bias; a null doc_id is scored and is
not held out. Repeated rows are scored each. Without usable labels the score is 0.5 for every row, and `without_toxic` then keeps
all rows. Extra columns are kept by `without_toxic` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORDS
from .subword import Model, Shape, below, fit, held_out, sample, scored

SHAPE = Shape(words=ALNUM_WORDS, lower=True, passage=64, pairs=False, once=True, least=400)
MOST = 1600
THRESHOLD = 0.3
PARTS, PART = 4, 2


def toxicity_model(docs: DataFrame, labels: DataFrame, most: int = MOST, shape: Shape = SHAPE) -> Model:
    return fit(sample(docs, labels, "toxic", ~held_out(F.col("doc_id"), PARTS, PART), {0: 2 * most, 1: most}), shape)


def toxicity_scores(docs: DataFrame, model: Model, shape: Shape = SHAPE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text)."""
    found = scored(docs, model, shape)
    return found.select("doc_id", held_out(F.col("doc_id"), PARTS, PART).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, shape: Shape = SHAPE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold; the columns stay. An untrained model rejects nothing."""
    return below(docs, model, shape, threshold) if model.weight.any() else docs


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity_scores(docs, toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
