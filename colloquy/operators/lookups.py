"""Lookups by title and by law, and the kinds of a provider's errors."""

from __future__ import annotations

import regex as re
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from colloquy import rules
from colloquy.operators.ranking import numbered
from colloquy.staging import staged

MOST_LAWS = 1000
TERM = r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}々ー・]{2,30}"


def law_titles(spark: SparkSession) -> DataFrame:
    """(title, ministry) of the laws that set up an agency."""
    own = [(f"{name}{kind}", name) for name in rules.DEPARTMENTS for kind in rules.LAW_KINDS]
    return spark.createDataFrame(own + [(title, rules.CABINET) for title in rules.CABINET_LAWS], "title string, ministry string")


def _plain(item: Column) -> Column:
    """The sentences of a law without marks."""
    return F.transform(F.coalesce(item["sentences"], F.array()), lambda s: F.trim(F.regexp_replace(F.coalesce(s["text"], F.lit("")), "<[^>]*>", "")))


def _matches(items: DataFrame) -> DataFrame:
    """(ministry, title, snippet, url, truncated) of items (i, plain, truncated) whose title is one of law_titles (a fixed table)."""
    each = items.select(F.col("i.revision_info.law_title").alias("title"), F.col("i.law_info.law_id").alias("law_id"), "plain", "truncated")
    about = F.get(F.filter("plain", lambda s: F.contains(s, F.lit(rules.LAW_CUE))), 0)
    snippet = F.left(F.coalesce(about, F.get("plain", 0), F.lit("")), F.lit(260))
    return each.join(F.broadcast(law_titles(items.sparkSession)), "title").select("ministry", "title", snippet.alias("snippet"), F.concat(F.lit(rules.LAW_URL), "law_id").alias("url"), "truncated")


def jurisdiction(laws: DataFrame, term: str | None = None) -> DataFrame:
    """(ministry, title, snippet, url, truncated) of the answers of a law search whose title is one of law_titles.

    The snippet is the first sentence about a field of work, else the first. laws has schema.LAWS_JSON.
    """
    each = laws.select(F.explode("items").alias("i"), F.col("next_offset").isNotNull().alias("truncated")).withColumn("plain", _plain(F.col("i")))
    return _matches(each.where(F.exists("plain", lambda s: F.contains(s, F.lit(term)))) if term else each)


def law_search(pages: DataFrame, term: str, types: tuple[str, ...] = rules.LAW_TYPES, limit: int = MOST_LAWS) -> tuple[DataFrame, bool, int]:
    """(items, truncated, hits): the first `limit` laws of these types of which a sentence holds the term.

    pages (schema.LAWS_JSON) are a corpus cut by offset: each but the last says where the next begins, which is where its own laws'
    numbers end. They may come in any order; each is searched where it is, and only numbers and hits are dealt. items: at (its number
    in the corpus), i, plain. truncated: there are more hits, or the corpus goes on after the last page. A law without a type counts
    as one of those asked for. ValueError names what is wrong with the search.
    """
    wrong = [] if re.fullmatch(TERM, term) else ["term: 2 to 30 characters of Han, Hiragana, Katakana, 々, ー and ・"]
    wrong += [] if types and set(types) <= set(rules.LAW_TYPES) else [f"law_type: some of {', '.join(rules.LAW_TYPES)}"]
    wrong += [] if 1 <= limit <= MOST_LAWS else [f"limit: 1 to {MOST_LAWS}"]
    if wrong:
        raise ValueError("; ".join(wrong))
    name = "_page"
    own = staged(pages.select(F.col("items"), "next_offset", F.monotonically_increasing_id().alias(name)))
    ends = numbered(own.select(name, F.coalesce("next_offset", F.lit((1 << 63) - 1)).alias("end")), ["end", name], "nth")
    begins = ends.select((F.col("nth") + 1).alias("nth"), F.col("end").alias("begin"))
    starts = ends.join(begins, "nth", "left").select(F.col(name).alias("of"), F.coalesce("begin", F.lit(0)).alias("begin"))
    hits = own.select(name, F.posexplode("items").alias("pos", "i")).where(F.coalesce(F.col("i.law_info.law_type").isin(*types), F.lit(True)))
    hits = hits.withColumn("plain", _plain(F.col("i"))).where(F.exists("plain", lambda s: F.contains(s, F.lit(term))))
    seen = Observation()
    found = hits.join(starts, F.col(name) == F.col("of")).select((F.col("begin") + F.col("pos")).alias("at"), "i", "plain").observe(seen, F.count(F.lit(1)).alias("n"))
    kept = staged(found.orderBy("at").limit(limit))
    open_end = own.agg(F.count_if(F.col("next_offset").isNull()).alias("last"), F.count("*").alias("n")).first()
    n = seen.get["n"]
    return kept, n > limit or open_end["n"] > 0 and open_end["last"] == 0, n


def law_jurisdiction(pages: DataFrame, term: str, types: tuple[str, ...] = rules.LAW_TYPES, limit: int = MOST_LAWS) -> DataFrame:
    """(ministry, title, snippet, url, truncated) of a law search over pages."""
    items, truncated, _ = law_search(pages, term, types, limit)
    return _matches(items.withColumn("truncated", F.lit(truncated)))


def valid_law_term(term: Column) -> Column:
    return term.rlike(r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}々ー・]{2,30}$")


def error_code(code: Column, message: Column) -> Column:
    """The reported code if it is known, else the first known code named in the message."""
    named = F.get(F.filter(F.array(*[F.lit(c) for c in rules.KNOWN_CODES]), lambda c: F.regexp_like(F.lower(message), F.concat(F.lit(r"\b"), c.cast("string"), F.lit(r"\b")))), 0)
    return F.when(code.isin(*rules.KNOWN_CODES), code).otherwise(named)


def error_kind(code: Column, message: Column, status: Column, name: Column | None = None) -> Column:
    """The kind of an error: quota, busy, input size, timeout, access, or unclassified; the first that holds."""
    said, known = F.lower(F.coalesce(message, F.lit(""))), error_code(code, F.coalesce(message, F.lit("")))
    has = lambda codes: F.coalesce(known.isin(*codes), F.lit(False))
    timed = F.coalesce(name == "TimeoutError", F.lit(False)) if name is not None else F.lit(False)
    return (
        F.when(has(rules.QUOTA_CODES) | said.rlike(rules.QUOTA_WORDS), "quota_exhausted")
        .when(has(rules.BUSY_CODES) | F.coalesce(status == 429, F.lit(False)) | said.rlike(rules.BUSY_WORDS), "model_busy")
        .when(has(rules.INPUT_CODES) | said.rlike(rules.INPUT_WORDS), "model_input_limit")
        .when(has(rules.TIMEOUT_CODES) | timed | said.rlike(rules.TIMEOUT_WORDS), "model_timeout")
        .when(has(rules.ACCESS_CODES), "model_access_denied")
        .otherwise("model_request_failed")
    )


def allowed_url(url: Column, host: str) -> Column:
    """An https address on the source's host."""
    return F.coalesce(F.parse_url(url, F.lit("HOST")) == host, F.lit(False)) & F.startswith(url, F.lit("https://"))
