"""Quality classifier on supervised subword embeddings.

Features are the words as they stand (split at white space, case and symbols kept), pairs of neighbouring words (a word said
again at once is one feature, whichever word it is) and runs of 3 to 5 bytes of each word. Their vectors are averaged over the
whole text into a softmax of two labels; vectors and softmax are trained together by numpy gradient descent on a bounded sample
of labelled rows (MOST of label 0, twice as many of label 1, the first by a hash of doc_id), never on held-out rows. A fifth of
the sample calibrates the odds.

Scores use the text alone. Nulls and empty texts have no features and get the score of the bias; a null doc_id is scored and is
not held out. Repeated rows are scored each. Without usable labels the score is 0.5 for every row. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORDS
from .subword import Model, Shape, fit, held_out, sample, scored

SHAPE = Shape(words=SPACE_WORDS, lower=False, passage=0, pairs=True, steps=600)
MOST = 1600
THRESHOLD = 0.3
PARTS, PART = 5, 0


def quality_model(docs: DataFrame, labels: DataFrame, most: int = MOST, shape: Shape = SHAPE) -> Model:
    return fit(sample(docs, labels, "quality", ~held_out(F.col("doc_id"), PARTS, PART), {0: most, 1: 2 * most}), shape)


def quality_scores(docs: DataFrame, model: Model, shape: Shape = SHAPE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text)."""
    found = scored(docs, model, shape)
    return found.select("doc_id", held_out(F.col("doc_id"), PARTS, PART).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_scores(docs, quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
