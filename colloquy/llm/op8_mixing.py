"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A source whose target is e times its size first gives floor(e) whole copies of each
document for certain. What is left of the target is a sample without replacement in which documents have unequal inclusion
probabilities: the odds of a document are the odds of the share s = e - floor(e) times sqrt(mean length of its source / its
length), between 1 / TILT and TILT, so the words that are left go to more documents than if all had the probability s. Documents
are ranked by the Pareto variable, random odds divided by inclusion odds: (u / (1 - u)) / (p / (1 - p)), with u uniform and fixed
by a hash of seed, doc_id and text. The sample takes the smallest ranks until the words left for the source are used up; the
document on the edge is in if that comes nearer, so a source is off its target by at most half a document.

No source is ever sorted as a whole: ranks are counted in bins, a running sum over a source's bins names the bin in which the
edge falls, and only the distinct documents of that bin are sorted. Rows that repeat doc_id and text tie; they are counted, and
where the edge falls among them as many are taken as come nearest, the first in the order in which they were staged. The result
for a source is one row, which every document is then compared with. A source or a repeated row that makes up a third of all rows
is spread like any other.

Nulls: text counts 0 words, a null source is a source of its own (last in order), a null doc_id draws u from the word "null" and
its text. Repeated rows count and are drawn like any others; which of the rows with one doc_id and text is taken doesn't show in
these columns. A very long text is one document of its length. An empty table gives no rows. Extra columns are ignored by `mixed`
and kept by `mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.staging import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BINS = 4096
SEED = 8
#: By how much the inclusion odds of a document may differ from those of its source's share.
TILT = 8.0
#: Stands for a null doc_id in comparisons.
NO_ID = -(1 << 63)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def draw(doc_id: Column, digest: Column, seed: int) -> Column:
    """Uniform in (0, 1) from 52 bits of an MD5 digest."""
    own = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), digest).cast("binary"))
    return (F.conv(F.substring(own, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def sizes_of(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, source, size, bytes, digest) of every row, staged, so that rid stays."""
    text = F.coalesce("text", F.lit(""))
    return staged(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "source", n_words(text).alias("size"), F.octet_length(text).cast("long").alias("bytes"), text_digest(text).alias("digest")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, mean, target) from (source, size, bytes): one row for each source; mean is its documents' mean length.

    Weights repeat over the sources in code-point order, null last. Sources reach their cap of `most` times their size in
    the order of cap / weight, so the final level follows from running sums over that order.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), (F.sum("bytes").cast("double") / F.count("*")).alias("mean"))
    at = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (at + 1).cast("int")).cast("long"))
    order = Window.orderBy((F.col("source_size") * most).cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("nth", F.row_number().over(order))
        .withColumn("given", F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.sum("source_size").over(every) - F.col("given")).cast("double") / (F.sum("weight").over(every) - F.col("used")))
        .withColumn("open", F.col("source_size") * most > F.col("weight") * F.col("level"))
        .withColumn("final", F.min_by("level", F.when(F.col("open"), F.col("nth"))).over(every))
    )
    cap = (F.col("source_size") * most).cast("double")
    target = F.when(F.col("final").isNull(), cap).otherwise(F.least(cap, F.col("weight") * F.col("final")))
    return per.select("source", "source_size", "mean", target.alias("target"))


def ranked(share: Column, mean: Column, doc_id: Column, digest: Column, length: Column, seed: int) -> Column:
    """The Pareto variable of a document; null where nothing is left to draw."""
    u = draw(doc_id, digest, seed)
    tilt = F.least(F.lit(TILT), F.greatest(F.lit(1 / TILT), F.sqrt(mean / F.greatest(length, F.lit(1)))))
    return F.when(share > 0, (u / (1 - u)) / (share / (1 - share) * tilt))


def bin_of(rank: Column, bins: Column) -> Column:
    return F.floor(rank / (1 + rank) * bins)


def first_rids(rows: DataFrame, key: str, most: str) -> DataFrame:
    """(key, last_rid) such that so many rows (key, rid, most) of each key have a rid up to last_rid. No key is sorted as a whole:
    rows are counted by the partition that staged them, and only one partition's rows are numbered."""
    part = F.shiftright("rid", 33)
    per = rows.groupBy(key, most, part.alias("part")).agg(F.count("*").alias("n"))
    run = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    at = per.withColumn("upto", F.sum("n").over(run)).where(F.col("upto") >= F.col(most)).groupBy(key, most).agg(F.min_by(F.struct("part", (F.col("upto") - F.col("n")).alias("before")), "part").alias("at"))
    at = at.select(F.col(key).alias("at_key"), "at.part", (F.col(most) - F.col("at.before")).alias("quota"))
    own = rows.withColumn("row_part", part).join(at, F.col(key).eqNullSafe(F.col("at_key")) & (F.col("row_part") == F.col("part")))
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy(key, "row_part").orderBy("rid"))).where(F.col("nth") <= F.col("quota"))
    return own.groupBy(key).agg(F.max("rid").alias("last_rid"))


def mix_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, bins: int = BINS) -> DataFrame:
    """One row for each source of sizes_of's columns: source_size, target, whole copies, share of the rest, and the edge, which is
    the last document taken (rank, id, digest) and how many of the rows that repeat it are (of how many)."""
    targets = source_targets(sizes, weights, most)
    e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(e)).withColumn("share", e - F.floor(e)).withColumn("left", F.col("target") - F.floor(e) * F.col("source_size"))
    targets = staged(targets.withColumnRenamed("source", "of"))
    docs = sizes.join(targets, F.col("source").eqNullSafe(F.col("of")))
    docs = docs.withColumn("rank", ranked(F.col("share"), F.col("mean"), F.col("doc_id"), F.col("digest"), F.col("bytes"), seed)).where("rank is not null")
    docs = docs.withColumn("bin", bin_of(F.col("rank"), F.lit(bins)))
    per_bin = docs.groupBy("of", "left", "bin").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("of").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = per_bin.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    edge = per_bin.where("before <= left").groupBy("of").agg(F.max("bin").alias("edge_bin"), F.max_by("before", "bin").alias("edge_before"))
    edge = staged(edge.withColumnRenamed("of", "edge_of"))
    inside = docs.join(edge, F.col("of").eqNullSafe(F.col("edge_of")) & (F.col("bin") == F.col("edge_bin")))
    key = [F.col("rank"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("digest")]
    inside = inside.groupBy("of", "left", "edge_before", *key, "size").agg(F.count("*").alias("n"))
    one = Window.partitionBy("of").orderBy("rank", "id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("n")).over(one), F.lit(0)) + F.col("edge_before"))
    fits = lambda m: F.col("before") + m * F.col("size") - F.col("size") / 2 <= F.col("left")
    near = F.when(F.col("size") > 0, F.floor((F.col("left") - F.col("before")) / F.col("size") + 0.5)).otherwise(F.col("n"))
    near = F.least(F.greatest(near, F.lit(0)), F.col("n"))
    taken = F.when(fits(F.lit(1)), F.when((near < F.col("n")) & fits(near + 1), near + 1).when((near > 0) & ~fits(near), near - 1).otherwise(near)).otherwise(F.lit(0))
    inside = inside.withColumn("m", taken.cast("long")).where("m > 0")
    last = inside.groupBy("of").agg(F.max(F.struct("rank", "id", "digest", "m", "n")).alias("last"))
    edge = edge.join(last.withColumnRenamed("of", "last_of"), F.col("edge_of").eqNullSafe(F.col("last_of")), "left")
    edge = edge.select("edge_of", "edge_bin", F.col("last.rank").alias("last_rank"), F.col("last.id").alias("last_id"), F.col("last.digest").alias("last_digest"), F.col("last.m").alias("last_m"), F.col("last.n").alias("last_n"))
    out = targets.join(edge, F.col("of").eqNullSafe(F.col("edge_of")), "left").drop("edge_of")
    return staged(out.withColumn("bins", F.lit(bins)))


class Place:
    """Where a document stands to its source's edge; columns of the plan have this prefix."""

    def __init__(self, seed: int, doc_id: Column, digest: Column, length: Column, prefix: str = "") -> None:
        of = {c: F.col(prefix + c) for c in ("whole", "share", "mean", "bins", "edge_bin", "last_rank", "last_id", "last_digest", "last_m", "last_n")}
        rank = ranked(of["share"], of["mean"], doc_id, digest, length, seed)
        own, last = F.struct(rank, F.coalesce(doc_id, F.lit(NO_ID)), digest), F.struct(of["last_rank"], of["last_id"], of["last_digest"])
        some = of["last_rank"].isNotNull()
        self.split = F.coalesce(some & (own == last) & (of["last_m"] < of["last_n"]), F.lit(False))
        self.inside = F.coalesce((bin_of(rank, of["bins"]) < of["edge_bin"]) | (some & (own <= last)), F.lit(False))
        self.whole = of["whole"]


def split_rows(plan: DataFrame) -> bool:
    """Does the edge of a source fall among rows that repeat each other? plan has one row for each source."""
    return not plan.where("last_m < last_n").isEmpty()


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of docs (doc_id, text, source)."""
    sizes = sizes_of(docs)
    plan = mix_plan(sizes, weights, most, seed)
    both = sizes.join(plan, F.col("source").eqNullSafe(F.col("of")))
    place = Place(seed, F.col("doc_id"), F.col("digest"), F.col("bytes"))
    inside = place.inside
    if split_rows(plan):
        last = staged(first_rids(both.where(place.split).select("of", "rid", "last_m"), "of", "last_m"))
        both = both.join(last.withColumnRenamed("of", "rid_of"), F.col("of").eqNullSafe(F.col("rid_of")), "left")
        inside = inside & (~place.split | (F.col("rid") <= F.col("last_rid")))
    both = both.withColumn("copies", (place.whole + inside.cast("long")).cast("long"))
    return both.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it; the columns stay. Only one row for each source is joined."""
    plan = mix_plan(sizes_of(docs), weights, most, seed)
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    named = plan.select([F.col(c).alias(prefix + c) for c in plan.columns])
    both = docs.join(named, F.col("source").eqNullSafe(F.col(prefix + "of")))
    text = F.coalesce("text", F.lit(""))
    place = Place(seed, F.col("doc_id").cast("long"), text_digest(text), F.octet_length(text).cast("long"), prefix)
    n, of, rid = prefix + "n", prefix + "of", prefix + "rid"
    out = both.withColumn(n, place.whole + (place.inside & ~place.split).cast("long")) if (split := split_rows(plan)) else both.withColumn(n, place.whole + place.inside.cast("long"))
    out = out.where(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)
    if split:
        rows = staged(both.where(place.split).select(*docs.columns, of, F.col(prefix + "last_m"), F.monotonically_increasing_id().alias(rid)))
        last = first_rids(rows.select(F.col(of).alias("of"), F.col(rid).alias("rid"), F.col(prefix + "last_m").alias("m")), "of", "m").select(F.col("of").alias(prefix + "x"), F.col("last_rid").alias(prefix + "y"))
        out = out.union(rows.join(last, F.col(of).eqNullSafe(F.col(prefix + "x")) & (F.col(rid) <= F.col(prefix + "y"))).select(*docs.columns))
    return out


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, strlen(coalesce(text, '')) AS bytes, md5(coalesce(text, '')) AS digest FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS s, sum(bytes)::DOUBLE / count(*) AS mean, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CASE pos % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per
), levels AS (
  SELECT *, row_number() OVER o AS nth,
    ((sum(s) OVER ())::BIGINT - coalesce(sum(3 * s) OVER b, 0)::BIGINT)::DOUBLE / ((sum(w) OVER ()) - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM weighed
  WINDOW o AS (ORDER BY (3 * s)::DOUBLE / w, source NULLS LAST), b AS (ORDER BY (3 * s)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), final AS (SELECT arg_min(level, nth) AS level FROM levels WHERE 3 * s > w * level),
targets AS (
  SELECT l.source, l.s, l.mean, CASE WHEN f.level IS NULL THEN (3 * l.s)::DOUBLE ELSE least((3 * l.s)::DOUBLE, l.w * f.level) END AS target FROM levels l, final f
), shares AS (
  SELECT *, CASE WHEN s > 0 THEN target / s ELSE 0 END AS e FROM targets
), drawn AS (
  SELECT d.doc_id, d.source, d.size, d.digest, t.s, t.target, least({TILT}, greatest({1 / TILT}, sqrt(t.mean / greatest(d.bytes, 1)))) AS tilt, floor(t.e) AS whole, t.e - floor(t.e) AS p, t.target - floor(t.e) * t.s AS rest,
    (('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || d.digest), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM sizes d JOIN shares t ON d.source IS NOT DISTINCT FROM t.source
), ranks AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p) * tilt) END AS r FROM drawn
), runs AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY r NULLS LAST, doc_id NULLS FIRST, digest ROWS UNBOUNDED PRECEDING) AS upto FROM ranks
)
SELECT doc_id, size, s AS source_size, target,
  (whole + CASE WHEN r IS NOT NULL AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END)::BIGINT AS copies,
  ((whole + CASE WHEN r IS NOT NULL AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM runs
"""
