"""License scans by diagonal voting.

Every document is cut into words (A-Z lower-cased), and the hash of every pair of neighbouring words is joined with the word
pairs of the license templates; where hashes are equal, the words themselves are compared. A pair at word i of the document and
word j of the template votes for the diagonal i - j, where a copy of the template would start. Votes are gathered for each document, template and diagonal as a bit set of the j seen.

A phrase stands where its diagonal has all votes. For the longer templates, a stretch of the document of at most STRETCH times
the template's length must hold at least COVER of its pairs, on diagonals with two votes or more that lie no further apart than
that length allows, so words put in or left out do no harm. Every diagonal is the lowest of its own stretch: a complete copy
counts whatever stands beside it, and copies are never joined into one that is too long.

OP1_SQL says the same rule with joins of votes in place of bit sets.

Everything is Spark's own expressions: arrays of words, explode, a broadcast join with the fixed templates, grouped bit sets (a
table in the shared folder, as phrases and spans both read it) and a window over the diagonals of one document. A document's votes are bounded by its length, and documents don't meet.

Nulls: a null text has no words. A null doc_id is returned as it is. Repeated rows each get the same result. A text without words
has 0 words and no labels; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.staging import staged

#: Words of a folded text: what isn't in \x00-\x2F, \x3A-\x60 or \x7B-\x7F, said without a negation, which Java's patterns take ten
#: times as long for.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
COVER = 0.8
STRETCH = 1.5
# The phrases whose exact places count, and wording by which licenses and notices are known.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved"),
)


def folded(text: Column) -> Column:
    """A-Z lower-cased. lower() does this and folds two further letters into ASCII, so these are first made others."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é"))
    return F.lower(F.replace(text, F.lit("İ"), F.lit("é")))


def template_pairs(spark: SparkSession) -> DataFrame:
    """(template, label, phrase, pairs, words, first, second, at): every word pair of the fixed templates."""
    rows = []
    for n, (label, text) in enumerate(PHRASES + TEMPLATES):
        w = text.split()
        rows += [(n, label, n < len(PHRASES), len(w) - 1, len(w), w[j], w[j + 1], j) for j in range(len(w) - 1)]
    return spark.createDataFrame(rows, "template int, label string, phrase boolean, pairs int, words int, first string, second string, at int")


def votes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, template..., start, seen): bit j of seen says that the template's pair j votes for this start."""
    words = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.regexp_extract_all(folded(F.col("text")), F.lit(WORD), F.lit(0)).alias("w"))
    pairs = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.struct(F.xxhash64(a, b).alias("pair"), a.alias("a"), b.alias("b")))
    each = words.select("doc_id", "text_key", F.posexplode(pairs).alias("i", "p")).select("doc_id", "text_key", "i", "p.*")
    own = template_pairs(docs.sparkSession).withColumn("of_pair", F.xxhash64("first", "second"))
    same = (F.col("pair") == F.col("of_pair")) & (F.col("a") == F.col("first")) & (F.col("b") == F.col("second"))
    hits = each.join(F.broadcast(own), same).withColumn("start", F.col("i") - F.col("at"))
    return hits.groupBy("doc_id", "text_key", "template", "label", "phrase", "pairs", "words", "start").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("seen"))


def license_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, label, phrase, start, end, score): places of the phrases and verified stretches of the templates, of which
    those of one copy may overlap."""
    key = ["doc_id", "text_key", "label", "phrase"]
    found = staged(votes(docs))
    exact = found.where("phrase and bit_count(seen) = pairs")
    exact = exact.select(*key, F.col("start").cast("long").alias("start"), (F.col("start") + F.col("words")).cast("long").alias("end"), F.lit(1.0).alias("score"))
    # Templates have at most 62 pairs, so votes are bits of a long and shifts stay below 64.
    far = int(max(len(t.split()) for _, t in TEMPLATES) * (STRETCH - 1))
    along = Window.partitionBy("doc_id", "text_key", "template").orderBy("start").rangeBetween(0, far)
    near = found.where("not phrase and bit_count(seen) > 1")
    near = near.withColumn("all", F.bit_or("seen").over(along)).withColumn("ds", F.collect_list(F.struct("start", "seen")).over(along))
    near = near.where(F.bit_count("all") / F.col("pairs") >= COVER)
    near = near.withColumn("ds", F.expr(f"filter(ds, d -> d.start <= start + floor(words * {STRETCH - 1}))"))
    # The votes of diagonal d within the stretch that begins at word lo.
    last = f"cast(lo + floor(words * {STRETCH}) - 2 - d.start as int)"
    held = f"if({last} < 0, 0L, shiftleft(shiftright(d.seen & (shiftleft(1L, least({last}, 61) + 1) - 1), greatest(lo - d.start, 0)), greatest(lo - d.start, 0)))"
    near = near.withColumn("los", F.expr("transform(ds, d -> cast(d.start + bit_count((d.seen & -d.seen) - 1) as int))"))
    near = near.withColumn("best", F.expr(f"array_max(transform(sequence(array_min(los), array_max(los)), lo -> struct(bit_count(aggregate(ds, 0L, (m, d) -> m | {held})) as n, lo as lo)))"))
    near = near.withColumn("score", F.col("best.n") / F.col("pairs")).where(F.col("score") >= COVER).withColumn("lo", F.col("best.lo"))
    near = near.withColumn("end", F.expr(f"array_max(transform(ds, d -> if({held} = 0, 0, d.start + length(bin({held})) + 1)))"))
    return exact.union(near.select(*key, F.col("lo").cast("long").alias("start"), F.col("end").cast("long"), "score"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for every row of docs (doc_id, text): word count, exact phrase places, labels and score."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    base = F.when(F.col("phrase"), F.col("start"))
    per = license_spans(docs).groupBy("doc_id", "text_key").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        joined(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("score").alias("score"),
    )
    per = per.withColumnsRenamed({"doc_id": "of", "text_key": "of_key"})
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.regexp_count(folded(F.col("text")), F.lit(WORD)).cast("long").alias("n_words"))
    rows = rows.join(per, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")), "left")
    zero = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return rows.select("doc_id", "n_words", *[F.coalesce(c, zero[c]).alias(c) if c in zero else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _template_values() -> str:
    rows = []
    for n, (label, text) in enumerate(PHRASES + TEMPLATES):
        w = text.split()
        rows += [f"({n}, '{label}', {n < len(PHRASES)}, {len(w) - 1}, {len(w)}, '{w[j]} {w[j + 1]}', {j})" for j in range(len(w) - 1)]
    return ", ".join(rows)


OP1_SQL = f"""
WITH t(template, label, phrase, pairs, words, pair, pos) AS (VALUES {_template_values()}),
w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), p AS (
  SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] AS pair FROM (SELECT doc_id, w, unnest(range(0, len(w) - 1)) AS i FROM w)
), v AS (
  SELECT DISTINCT doc_id, template, label, phrase, pairs, words, i - pos AS start, pos FROM p JOIN t ON p.pair = t.pair
), d AS (
  SELECT doc_id, template, start, count(*) AS n FROM v GROUP BY ALL
), exact AS (
  SELECT v.doc_id, label, v.start FROM v JOIN d USING (doc_id, template, start) WHERE phrase AND n = pairs AND pos = 0
), near AS (
  SELECT v.* FROM v JOIN d USING (doc_id, template, start) WHERE NOT phrase AND n > 1
), base AS (
  SELECT DISTINCT doc_id, template, start AS base FROM near
), lo AS (
  SELECT DISTINCT doc_id, template, base, start + pos AS lo FROM base JOIN near USING (doc_id, template) WHERE start BETWEEN base AND base + floor(words * {STRETCH - 1})
), merged AS (
  SELECT doc_id, label, count(DISTINCT pos) / pairs::DOUBLE AS score FROM lo JOIN near USING (doc_id, template)
  WHERE start BETWEEN base AND base + floor(words * {STRETCH - 1}) AND start + pos >= lo AND start + pos + 2 <= lo + floor(words * {STRETCH})
  GROUP BY doc_id, template, label, pairs, base, lo HAVING count(DISTINCT pos) / pairs::DOUBLE >= {COVER}
), b AS (
  SELECT doc_id, count(*) AS n, min(start) AS lo, max(start) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM exact GROUP BY doc_id
), a AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM (SELECT doc_id, label, 1.0::DOUBLE AS score FROM exact UNION ALL SELECT doc_id, label, score FROM merged) GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, coalesce(a.score, 0)::DOUBLE AS score
FROM w LEFT JOIN b ON w.doc_id = b.doc_id LEFT JOIN a ON w.doc_id = a.doc_id
"""
