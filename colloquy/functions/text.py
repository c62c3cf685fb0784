"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import rules


def js_round(x: Column) -> Column:
    """Rounds halves up."""
    return F.floor(x + F.lit(0.5))


def round3(x: Column) -> Column:
    return js_round(x * 1000) / 1000


def squeeze(text: Column) -> Column:
    """White space collapsed to one blank and trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


#: Letters that NFKC leaves alone beside each other: ASCII, Western and Cyrillic letters, kana, Han and their marks.
PLAIN = r"\x00-\x7F\u00C0-\u00FF\u0400-\u045F\u25CB\u3001-\u3003\u3005-\u3029\u3041-\u3096\u30A1-\u30FE\u4E00-\u9FFF\uFFFD"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normal_form(text: Column) -> Column:
    """Only texts with letters that normalization may change go to Python; of others a null does."""
    return F.coalesce(_nfkc(F.when(text.rlike(f"[^{PLAIN}]"), text)), text)


def normalize(text: Column, nfkc: bool = True) -> Column:
    """NFKC, then squeeze. False for text that is known to be in this form, which keeps the plan free of Python."""
    text = F.coalesce(text, F.lit(""))
    return squeeze(normal_form(text) if nfkc else text)


def occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def word_tokens(text: Column, stopwords: tuple[str, ...] = rules.TRAINING_STOPWORDS, pattern: str = rules.TOKEN) -> Column:
    """Words that are neither stopwords nor digits, in order with repeats."""
    return F.filter(occurrences(squeeze(text), pattern), lambda w: ~w.isin(*stopwords) & ~w.rlike(f"^{rules.DIGITS}$"))


def char_ngrams(text: Column, sizes: tuple[int, ...] = (2, 3), stopwords: tuple[str, ...] = rules.TRAINING_STOPWORDS) -> Column:
    """All runs of so many characters of the text without white space, minus stopwords and digits.

    The characters are bound to a lambda's variable, so a text is cut once and not for each of its runs.
    """
    chars = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""), ""), lambda c: c != "")

    def grams(chars: Column, n: int) -> Column:
        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))

    every = F.flatten(F.transform(F.array(chars), lambda c: F.concat(*[grams(c, n) for n in sizes])))
    return F.filter(every, lambda g: ~g.isin(*stopwords) & ~g.rlike(f"^{rules.DIGITS}$"))


def tokenize(text: Column) -> Column:
    """Words and the runs of two and three characters: a bag with repeats."""
    return F.concat(word_tokens(text), char_ngrams(text))


def bag(tokens: Column) -> Column:
    """array<struct<token, n>>: how often each of a row's tokens is there. Sorted once and cut where the token changes."""
    none = F.array().cast("array<int>")

    def cut(words: Column) -> Column:
        ends = F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: ~F.get(words, i).eqNullSafe(F.get(words, i + 1)))).otherwise(none)
        count = lambda own: F.transform(own, lambda e, j: F.struct(F.get(words, e).alias("token"), (e - F.coalesce(F.get(own, j - 1), F.lit(-1))).cast("long").alias("n")))
        return F.flatten(F.transform(F.array(ends), count))

    return F.flatten(F.transform(F.array(F.sort_array(tokens)), cut))


def token_set(text: Column, stopwords: tuple[str, ...] = rules.TOOL_STOPWORDS) -> Column:
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.array_distinct(F.filter(occurrences(F.coalesce(text, F.lit("")), rules.TOKEN), lambda w: ~F.array_contains(stop, w)))


def sentence_parts(text: Column, prefix: str, sentence: str = rules.PART_SENTENCE, skip: tuple[str, ...] = rules.GREETINGS, header: str = rules.SPEAKER_HEADER) -> Column:
    """Map from part id (prefix and number from 1) to sentence; greetings and announcements aren't offered as parts."""
    parts = F.transform(occurrences(text, sentence), lambda s: F.trim(F.regexp_replace(s, header, "")))
    if skip:
        parts = F.filter(parts, lambda s: ~s.rlike("|".join(f"(?:{p})" for p in skip)))
    parts = F.filter(parts, lambda s: s != "")
    return F.map_from_entries(F.transform(parts, lambda s, i: F.struct(F.concat(F.lit(prefix), (i + 1).cast("string")), s)))


def excerpt(text: Column, start: Column, lead: int = 140, size: int = 400) -> Column:
    """size characters from lead before start (null: from the beginning), with ellipses where text is left out."""
    begin = F.greatest(F.coalesce(start, F.lit(0)) - lead, F.lit(0))
    more = F.when(begin + size < F.length(text), F.lit("…")).otherwise(F.lit(""))
    return F.concat(F.when(begin > 0, F.lit("…")).otherwise(F.lit("")), F.substring(text, begin + 1, F.lit(size)), more)


def context_clip(text: Column, start: Column, end: Column, most: int, after: int, before: int = 300) -> Column:
    """The whole text if it is short enough, else what stands around a span."""
    begin = F.greatest(F.coalesce(start, F.lit(0)) - before, F.lit(0))
    upto = F.least(F.length(text), F.coalesce(end, F.lit(0)) + after)
    return F.when(F.length(text) <= most, text).otherwise(F.substring(F.substring(text, begin + 1, upto - begin), F.lit(1), F.lit(most)))


def quote_with_context(text: Column, quote: Column, sentence: str = rules.PART_SENTENCE, short: int = 40) -> Column:
    """A short quote is extended by the two sentences after it."""
    at = F.instr(text, quote)
    tail = F.substring(text, at + F.length(quote), F.length(text))
    longer = F.concat(quote, F.array_join(F.slice(occurrences(tail, sentence), 1, 2), ""))
    return F.when((F.length(quote) < short) & (F.length(quote) > 0) & (at > 0), longer).otherwise(quote)


def grounded(source: Column, quote: Column, most: int = 180) -> Column:
    """The quote if it stands in the source, as it is or without one pair of quotation marks around it; else null."""
    pairs = (("「", "」"), ("『", "』"), ('"', '"'), ("“", "”"), ("‘", "’"))
    inner = F.substring(quote, F.lit(2), F.length(quote) - 2)
    fits = lambda q: F.length(q).between(1, most) & F.contains(source, q)
    wrapped = F.lit(False)
    for a, b in pairs:
        wrapped = wrapped | ((F.length(quote) > 2) & F.startswith(quote, F.lit(a)) & F.endswith(quote, F.lit(b)))
    return F.when(fits(quote), quote).when(wrapped & fits(inner), inner)


def html_snippet(html: Column, size: int = 260) -> Column:
    return F.left(F.trim(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", "")), F.lit(size))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def and_rewrite(query: Column) -> Column:
    return F.regexp_replace(query, r"\s+AND\s+", " ")


def case_id(issue_id: Column, date: Column, speech_id: Column, order: Column, index: Column) -> Column:
    """meeting:turn, where an empty id gives way to the date, and an empty turn id to its order or place."""
    some = lambda c: F.nullif(c.cast("string"), F.lit(""))
    return F.concat_ws(":", F.coalesce(some(issue_id), some(date), F.lit("undefined")), F.coalesce(some(speech_id), F.nullif(some(order), F.lit("0")), some(index)))


def digest_key(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)
