"""What a reviewer answers, as text: read without trust, checked row by row, and given to the variant of an answer that it cites.

A response holds one batch: {"reviews": [...]}, one object a candidate. Nothing in a response can fail a job; what can't be read
leaves its candidates uncertain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import rules
from colloquy.functions import text as tx
from colloquy.operators.lookups import allowed_url
from colloquy.operators.ranking import keep_first
from colloquy.operators.review import MOST_COMPARISON, decide
from colloquy.staging import staged

SEMANTIC = ("id", "beneficiary", "activity", "relation", "comparison", "decision")
REFERENCES = ("q", "a")
MOST_VARIANTS = 4
EARLY_CANDIDATES, EARLY_BATCH, EARLY_WHOLE = 8, 4, 6
EARLY_FIELDS = ("id", "decision", "reason", "question_evidence", "answer_evidence")
MOST_EVIDENCE, MOST_FEEDBACK = 8, 6

_text = lambda v: F.try_variant_get(v, "$", "string")
_kind = lambda v: F.schema_of_variant(v)
_bare = lambda c: F.regexp_replace(c, r"(?U)^[\s\ufeff]+|[\s\ufeff]+$", "")


def read_json(text: Column) -> Column:
    """A model's output as an object: as it is, or from a string that holds one; null for anything else."""
    outer = F.try_parse_json(text)
    inner = F.when(_kind(outer) == "STRING", F.try_parse_json(_text(outer))).otherwise(outer)
    return F.when(F.startswith(_kind(inner), F.lit("OBJECT")), inner)


def read_reviews(responses: DataFrame, text: str = "response") -> DataFrame:
    """(batch, readable, reviews) of responses (batch, text): the objects under "reviews"; unreadable where there is no such list alone."""
    own = responses.select("batch", F.try_variant_get(read_json(F.col(text)), "$", "map<string,variant>").alias("_o"))
    only = (F.size("_o") == 1) & F.map_contains_key("_o", F.lit("reviews"))
    listed = F.when(only & F.startswith(_kind(F.element_at("_o", F.lit("reviews"))), F.lit("ARRAY")), F.try_variant_get(F.element_at("_o", F.lit("reviews")), "$", "array<variant>"))
    return own.select("batch", listed.alias("reviews")).select("batch", F.col("reviews").isNotNull().alias("readable"), "reviews")


def review_rows(read: DataFrame) -> DataFrame:
    """One row a review: batch, place, the eight fields, omitted (unused references left out) and shape (why it can't be used; null if it can).

    A reject or uncertain that is complete but for its references gets empty ones. Nothing else is mended.
    """
    rows = read.select("batch", F.posexplode("reviews").alias("place", "_v"))
    rows = rows.withColumn("_object", F.coalesce(F.startswith(_kind(F.col("_v")), F.lit("OBJECT")), F.lit(False)))
    rows = rows.withColumn("_m", F.when(F.col("_object"), F.try_variant_get("_v", "$", "map<string,variant>")).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))))
    allowed = F.array(*[F.lit(c) for c in (*SEMANTIC, *REFERENCES)])
    has = lambda c: F.map_contains_key("_m", F.lit(c))
    is_text = lambda v: F.coalesce(_kind(v) == "STRING", F.lit(False))
    every = lambda cs: F.forall(F.array(*[F.lit(c) for c in cs]), lambda c: F.map_contains_key("_m", c))
    known = F.forall(F.map_keys("_m"), lambda k: F.array_contains(allowed, k))
    texts = F.forall(F.map_values("_m"), is_text)
    rows = rows.withColumns({"_semantic": every(SEMANTIC), "_known": known, "_texts": texts, "_full": has("q") & has("a")})
    value = lambda c: _text(F.element_at("_m", F.lit(c)))
    free = value("decision").isin("reject", "uncertain") & F.col("_semantic") & F.col("_known") & F.col("_texts") & ~F.col("_full")
    rows = rows.withColumn("omitted", F.coalesce(free, F.lit(False)))
    shape = (
        F.when(~F.col("_object"), "invalid_row")
        .when(~F.col("_semantic"), "missing_semantic_fields")
        .when(~F.col("_known"), "unknown_fields")
        .when(~F.col("_texts"), "non_string_fields")
        .when(~F.col("_full") & (value("decision") == "accept"), "missing_accepted_refs")
        .when(~F.col("_full") & ~F.col("omitted"), "invalid_row")
    )
    fields = [value(c).alias(c) for c in SEMANTIC] + [F.when(F.col("omitted"), F.coalesce(value(c), F.lit(""))).otherwise(value(c)).alias(c) for c in REFERENCES]
    return rows.select("batch", "place", *fields, "omitted", shape.alias("shape"))


def relation_kind(relation: Column) -> Column:
    """What an invalid relation looks like: blank, with spaces around it, in other letter case, a decision, or anything else."""
    own = _bare(relation)
    return F.when(own == "", "blank").when(own.isin(*rules.RELATIONS), "surrounding_whitespace").when(F.lower(own).isin(*rules.RELATIONS), "letter_case").when(own.isin(*rules.DECISIONS), "decision_code").otherwise("other")


def _cited(accepted: DataFrame, parts: DataFrame) -> DataFrame:
    """The parts that some rows cite. Parts are read once, and meet by (batch, id) as they are dealt where answer_parts made them."""
    cites = F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("part_id")) for side in REFERENCES])
    wanted = accepted.select("batch", "id", F.explode(cites).alias("_cite")).groupBy("batch", "id").agg(F.collect_set("_cite").alias("_cites"))
    return parts.join(wanted, ["batch", "id"]).where(F.array_contains("_cites", F.struct("side", "part_id"))).drop("_cites")


def checked_rows(rows: DataFrame, candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """rows with reason (null: valid), kind (of an invalid relation), said, and the evidence and owner of an accepted row.

    candidates: (batch, id). parts: (batch, id, side, part_id, text, owner), what a candidate may cite; side is q or a, owner the
    variant that said it. The first row of a candidate whose fields are good counts; any later one of it is a duplicate.
    """
    ids = candidates.select("batch", "id").distinct().withColumn("_is", F.lit(True))
    own = rows.join(ids, ["batch", "id"], "left").withColumn("said", decide(F.col("decision"), F.col("relation")))
    accepted = F.col("said") == "accept"
    fields = (
        F.when(~F.col("decision").isin(*rules.DECISIONS), "invalid_decision")
        .when((_bare(F.col("comparison")) == ""), "blank_comparison")
        .when(F.length("comparison") > MOST_COMPARISON, "long_comparison")
        .when(~F.col("relation").isin(*rules.RELATIONS), "invalid_relation")
        .when(accepted & ((_bare(F.col("beneficiary")) == "") | (_bare(F.col("activity")) == "") | (F.col("q") == "") | (F.col("a") == "")), "blank_accepted_roles_or_refs")
    )
    own = own.withColumn("_reason", F.coalesce("shape", F.when(F.col("_is").isNull(), "unknown_id"), fields))
    first = F.min(F.when(F.col("_reason").isNull(), F.col("place"))).over(Window.partitionBy("batch", "id"))
    own = staged(own.withColumn("_late", F.col("shape").isNull() & F.col("_is").isNotNull() & F.coalesce(F.col("place") > first, F.lit(False))))
    found = staged(_cited(own.where(accepted), parts))
    for side in REFERENCES:
        cited = found.where(F.col("side") == side).select("batch", "id", F.col("part_id").alias(side), F.col("text").alias(f"{side}_text"), F.col("owner").alias(f"{side}_owner"))
        own = own.join(cited, ["batch", "id", side], "left")
    foreign = accepted & (F.col("q_text").isNull() | F.col("a_text").isNull())
    reason = F.when(F.col("_late"), "duplicate_id").otherwise(F.coalesce("_reason", F.when(foreign, "unknown_accepted_refs")))
    kind = F.when(reason == "invalid_relation", relation_kind(F.col("relation")))
    good = reason.isNull() & accepted
    return own.select("batch", "place", "id", "said", "comparison", "omitted", reason.alias("reason"), kind.alias("kind"), *[F.when(good, F.col(c)).alias(n) for c, n in (("q_text", "question_evidence"), ("a_text", "answer_evidence"), ("a_owner", "owner"))])


def batch_counters(read: DataFrame, checked: DataFrame) -> DataFrame:
    """(batch, counter, n): how many rows came back, had unused references left out, and failed for each reason and kind of relation."""
    returned = read.where("readable").select("batch", F.lit("returned").alias("counter"), F.size("reviews").cast("long").alias("n")).where("n > 0")
    broken = read.where("not readable").select("batch", F.lit("invalid_review").alias("counter"), F.lit(1).cast("long").alias("n"))
    names = F.array_compact(F.array(F.when(F.col("omitted"), F.lit("omitted_unused_refs")), F.col("reason"), F.concat(F.lit("relation_"), F.col("kind"))))
    return returned.union(broken).union(checked.select("batch", F.explode(names).alias("counter")).groupBy("batch", "counter").agg(F.count("*").alias("n")))


def settled(candidates: DataFrame, checked: DataFrame) -> DataFrame:
    """(batch, id, decision, completed, comparison, question_evidence, answer_evidence, owner) for every candidate.

    owner is the variant whose answer was cited, so an accepted case carries the date and the address of that one. A candidate
    without a valid row, with two, or that cites what isn't its own is uncertain and not completed.
    """
    late = checked.groupBy("batch", "id").agg(F.max(F.col("reason") == "duplicate_id").alias("_late"))
    valid = checked.where("reason is null").select("batch", "id", "said", "comparison", "question_evidence", "answer_evidence", "owner")
    out = candidates.select("batch", "id").join(valid, ["batch", "id"], "left").join(late, ["batch", "id"], "left")
    done = F.col("said").isNotNull() & ~F.coalesce("_late", F.lit(False))
    kept = [F.when(done, F.col(c)).alias(c) for c in ("comparison", "question_evidence", "answer_evidence", "owner")]
    return out.select("batch", "id", F.when(done, F.col("said")).otherwise("uncertain").alias("decision"), done.alias("completed"), *kept)


def answer_parts(rows: DataFrame, key: list[str], ord_: str, owner: str, most: int = MOST_VARIANTS, question: str = "question", answer: str = "answer", **sentence: object) -> DataFrame:
    """(key, side, part_id, text, owner) of rows (key, question, answer; which may be one column): the first row's question, and the answers of the first `most`."""
    ranked = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(ord_))).where(F.col("_nth") <= most)
    numbered = F.transform_keys(tx.sentence_parts(F.col(answer), "a", **sentence), lambda k, _: F.concat(F.lit("v"), F.col("_nth").cast("string"), k))
    sides = F.array(F.struct(F.lit("a").alias("side"), numbered.alias("parts")), F.struct(F.lit("q").alias("side"), F.when(F.col("_nth") == 1, tx.sentence_parts(F.col(question), "q", **sentence)).alias("parts")))
    out = ranked.select(*key, F.col(owner).alias("owner"), F.explode(sides).alias("_s"))
    return out.select(*key, F.col("_s.side").alias("side"), F.explode("_s.parts").alias("part_id", "text"), "owner")


# --- the earlier policy ----------------------------------------------------------------------------


def early_candidates(rows: DataFrame, host: str, ord_: str = "ord") -> DataFrame:
    """The earlier policy's candidates with id (c1 to c8) and batch: the first of each case, agency and address, eight at most.

    More than six go in batches of four, fewer in one. rows: case_id, ministry, question, answer, url; incomplete ones are left out.
    """
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    usable = rows.where(some("case_id") & some("ministry") & F.col("question").isNotNull() & F.col("answer").isNotNull() & allowed_url(F.col("url"), host))
    first = keep_first(usable, ["case_id", "ministry", "url"], ord_).orderBy(ord_, "case_id", "ministry", "url").limit(EARLY_CANDIDATES)
    place, n = F.row_number().over(Window.orderBy(ord_, "case_id", "ministry", "url")) - 1, F.count("*").over(Window.partitionBy())
    out = first.withColumns({"_n": place, "_all": n})
    batch = F.when(F.col("_all") > EARLY_WHOLE, F.floor(F.col("_n") / EARLY_BATCH)).otherwise(0).cast("int")
    return out.withColumns({"id": F.concat(F.lit("c"), (F.col("_n") + 1).cast("string")), "batch": batch}).drop("_n", "_all")


def early_reviewed(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """candidates with screening, review_reason and the quotes of their reviews (EARLY_FIELDS); no rows if any review is invalid.

    Here one bad row voids the lot: a candidate without a review or with two, an unknown one, a decision outside the set, a reason
    that is blank or longer than 300 characters, or a quote that isn't text. An accept whose quotes don't stand in the sources is
    uncertain. Candidates are at most eight, so the check of the lot is one small group.
    """
    own = reviews.select(*EARLY_FIELDS).withColumn("_got", F.lit(True))
    met = candidates.withColumn("_want", F.lit(True)).join(own, "id", "full")
    sound = F.col("_want").isNotNull() & F.col("_got").isNotNull() & F.col("decision").isin(*rules.DECISIONS) & (_bare(F.col("reason")) != "") & (F.length("reason") <= MOST_COMPARISON) & F.col("question_evidence").isNotNull() & F.col("answer_evidence").isNotNull()
    everything, each = Window.partitionBy(F.lit(1)), Window.partitionBy("id")
    met = met.withColumn("_sound", F.coalesce(sound, F.lit(False)) & (F.count("*").over(each) == 1)).withColumn("_sound", F.min("_sound").over(everything)).where("_sound")
    q, a = (tx.grounded(tx.normalize(F.col(c)), tx.normalize(F.col(f"{c}_evidence"))) for c in ("question", "answer"))
    met = met.withColumns({"_q": q, "_a": a})
    held = (F.col("decision") == "accept") & (F.col("_q").isNull() | F.col("_a").isNull())
    quote = {"question_evidence": F.when(~held, F.coalesce(tx.quote_with_context(F.col("question"), F.col("_q")), F.lit(""))).otherwise(""), "answer_evidence": F.when(~held, F.coalesce("_a", F.lit(""))).otherwise("")}
    out = met.withColumns({**quote, "screening": F.when(held, "uncertain").otherwise(F.col("decision")), "review_reason": F.when(~held, tx.normalize(F.col("reason")))})
    return out.select(*candidates.columns, "screening", "review_reason", "question_evidence", "answer_evidence")


def early_evidence(unique: DataFrame, ord_: str = "ord") -> DataFrame:
    """The first eight of the accepted cases, as shown."""
    return unique.orderBy(ord_).limit(MOST_EVIDENCE)


def early_feedback(reviewed: DataFrame, ord_: str = "ord") -> DataFrame:
    """Reasons of the first six rejects, which guide another search."""
    return reviewed.where("screening = 'reject'").orderBy(ord_).limit(MOST_FEEDBACK).select("review_reason")
