"""Turns of a meeting: islands, exchanges, pairs of questions and replies, and what was said before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import rules
from colloquy.functions import text as tx
from colloquy.functions.hits import concept_hit, set_similarity, term_share
from colloquy.functions.segment import icu_segmenter
from colloquy.operators import roles
from colloquy.operators.bridge import bridged_answers
from colloquy.operators.passages import best_question, best_recall, best_supported, first_window
from colloquy.operators.ranking import keep_max, named_in
from colloquy.operators.scoring import nearest_span, relevance, retrieval_score
from colloquy.plans.plan import Plan, Segmenter
from colloquy.staging import staged


def contiguous_runs(turns: DataFrame, meeting: str, turn_id: str | None, order: str, ord_: str | None = None) -> DataFrame:
    """turns with run, from 1 in each meeting: a new one begins wherever the order isn't the one before plus one.

    Of turns with one id the last (by ord_) counts. Turns without an order (or id) belong to no run and go.
    """
    own = turns.where(F.col(order).isNotNull())
    if turn_id:
        last = Window.partitionBy(meeting, turn_id).orderBy(F.desc(ord_ or order))
        own = own.where(F.col(turn_id).isNotNull()).withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")
    along = Window.partitionBy(meeting).orderBy(order, *([ord_] if ord_ else []))
    breaks = (~F.coalesce(F.col(order) == F.lag(order).over(along) + 1, F.lit(False))).cast("long")
    return own.withColumn("run", F.sum(breaks).over(along.rowsBetween(Window.unboundedPreceding, 0)))


def exchanges(turns: DataFrame, meeting: str, order: list[str], opens: Column) -> DataFrame:
    """turns with exchange: how many turns that open one there have been. Every such turn closes the exchange before it."""
    along = Window.partitionBy(meeting).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("exchange", F.sum(opens.cast("long")).over(along))


def ask_reply_pairs(turns: DataFrame, meeting: str, order: list[str], asks: Column, replies: Column, ask: dict[str, str], reply: dict[str, str]) -> DataFrame:
    """Each asking turn beside every replying turn of its exchange: one window and one equi-join on (meeting, exchange).

    ask and reply: output name -> column.
    """
    own = exchanges(turns, meeting, order, asks).withColumn("_asks", asks).withColumn("_replies", replies)
    left = own.where("_asks").select(F.col(meeting), "exchange", *[F.col(c).alias(n) for n, c in ask.items()])
    right = own.where("_replies and not _asks and exchange > 0").select(F.col(meeting), "exchange", *[F.col(c).alias(n) for n, c in reply.items()])
    return left.join(right, [meeting, "exchange"])


def lag_context(turns: DataFrame, meeting: str, order: list[str], text: str, n: int = 2, size: int = 350, usable: Column | None = None) -> DataFrame:
    """turns with previous_context: the last `size` characters of each of the n turns before, leaving out those not usable."""
    along = Window.partitionBy(meeting).orderBy(*order)
    kept = F.when(usable if usable is not None else F.lit(True), F.right(F.col(text), F.lit(size)))
    return turns.withColumn("_tail", kept).withColumn("previous_context", F.concat_ws(" ", *[F.lag("_tail", i).over(along) for i in range(n, 0, -1)])).drop("_tail")


def asof_previous(rows: DataFrame, key: list[str], order: list[str], same: Column, value: Column, n: int = 5) -> DataFrame:
    """rows with previous: value of the newest of the n rows before for which same(then) equals same(now)."""
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(-n, -1)
    own = rows.withColumn("_now", same).withColumn("_before", F.collect_list(F.struct(same.alias("same"), value.alias("value"))).over(before))
    match = F.filter("_before", lambda b: b["same"].eqNullSafe(F.col("_now")))
    return own.withColumn("previous", F.try_element_at(match, F.lit(-1))["value"]).drop("_now", "_before")


def _prepared(turns: DataFrame, nfkc: bool) -> DataFrame:
    """turns in order, with normalized text, roles, exchange and the turn's place; one pass and one shuffle by meeting."""
    place = Window.partitionBy("issue_id").orderBy(F.coalesce("speech_order", F.lit(0)), "ord")
    own = turns.withColumn("text", tx.normalize(F.col("speech"), nfkc)).withColumn("place", F.row_number().over(place) - 1)
    args = (F.col("speaker_role"), F.col("speaker_position"), F.col("text"))
    own = own.withColumn("chair", roles.is_chair(*args)).withColumn("asks", roles.is_questioner(F.col("speaker_group"), *args))
    own = exchanges(own, "issue_id", ["place"], F.col("asks"))
    return own.withColumn("case_id", tx.case_id(F.col("issue_id"), F.col("date"), F.col("speech_id"), F.col("speech_order"), F.col("place")))


def strict_pairs(turns: DataFrame, plan: Plan, runs: dict | None = None, nfkc: bool = True, allowed: DataFrame | None = None, segment: Segmenter | None = None) -> DataFrame:
    """Pairs of a question that supports every concept and a reply that does, or is linked to it through its words or its brevity
    (see bridge.py), one for each case and agency: the most relevant.

    The previous answer of the same speaker in the same office, among the five turns before the question, helps to settle the
    agency if it was about the first concept. allowed: (speech_id) of questions to look at.
    """
    own = _prepared(turns, nfkc)
    first = concept_hit(F.col("text"), plan.groups[0], runs)["coverage"] >= 0.66
    before = Window.partitionBy("issue_id").orderBy("place").rowsBetween(-5, -1)
    useful = F.when(~F.col("asks") & ~F.col("chair") & first, F.struct("speaker", "speaker_position", "text"))
    own = own.withColumn("earlier", F.collect_list(useful).over(before))
    asks = own.where("asks and length(text) >= 8")
    if allowed is not None:
        asks = named_in(asks, allowed, "speech_id")
    best = best_question(asks, ["issue_id", "place"], "text", plan, runs)
    best = best.select("issue_id", "place", F.col("passage").alias("question"), F.col("start").alias("question_start"), F.col("end").alias("question_end"), "coverage")
    asks = asks.join(best, ["issue_id", "place"]).select("issue_id", "exchange", "case_id", "question", "question_start", "question_end", F.col("text").alias("question_text"), "coverage", "earlier", F.col("speech_url").alias("question_url"))
    replies = own.where("not asks and not chair and exchange > 0 and coalesce(speech_url, '') <> ''")
    aligned = best_supported(replies, ["issue_id", "place"], "text", plan, runs).select("issue_id", "place", F.col("passage").alias("answer"), F.col("score").alias("answer_score"))
    replies = replies.join(aligned, ["issue_id", "place"], "left")
    both = asks.join(replies.select("issue_id", "exchange", "place", "speaker", "speaker_position", "date", "meeting", "speech_url", "text", "answer", "answer_score"), ["issue_id", "exchange"])
    match = F.filter("earlier", lambda e: e["speaker"].eqNullSafe(F.col("speaker")) & e["speaker_position"].eqNullSafe(F.col("speaker_position")))
    both = both.withColumn("ministry", roles.answering_agency(tx.normalize(F.col("speaker_position"), nfkc), F.col("text"), F.try_element_at(match, F.lit(-1))["text"])).where("ministry is not null")
    both = staged(both.withColumn("pair", F.monotonically_increasing_id()))
    open_ = both.where("answer is null").select("pair", "question", "question_start", "question_end", "question_text", F.col("text").alias("answer_text"))
    linked = bridged_answers(open_, plan, segment or icu_segmenter(turns.sparkSession), runs)
    linked = both.drop("answer", "answer_score").join(linked, "pair").select(*both.columns, "context")
    both = both.where("answer is not null").withColumn("context", F.lit("answer")).unionByName(linked)
    both = both.withColumn("relevance", relevance(F.col("coverage"), F.col("answer_score")))
    out = both.select(
        "case_id", "ministry", "question", "answer", F.coalesce("speaker", F.lit(rules.UNNAMED)).alias("speaker"), F.coalesce("speaker_position", F.lit("")).alias("position"),
        F.coalesce("speaker_position", F.lit("")).alias("speaker_title"), F.coalesce("date", F.lit("")).alias("date"), F.coalesce("meeting", F.lit("")).alias("meeting"),
        F.col("speech_url").alias("url"), F.coalesce("question_url", F.lit("")).alias("question_url"), "context", "relevance", "place",
    )
    return keep_max(out, ["case_id", "ministry"], [F.desc("relevance"), F.asc("place")]).drop("place").orderBy(F.desc("relevance"), F.desc("date"), "case_id", "ministry")


def recall_pairs(turns: DataFrame, plan: Plan, runs: dict | None = None, nfkc: bool = True, blend: bool = True) -> DataFrame:
    """Pairs for a reviewer: replies of which the question or the reply itself touches the subjects, with clipped context.

    retrieval_score is .75 of the better and .25 of the weaker of both matches (blend=False, the earlier rule: the question's if
    it matched, else the reply's). One row for each case, agency and reply.
    """
    key = ["issue_id", "place"]
    own = _prepared(turns, nfkc)
    own = lag_context(own, "issue_id", ["place"], "text", usable=~F.col("chair"))
    usable = "not asks and not chair and exchange > 0 and coalesce(speech_url, '') <> '' and length(text) >= 8"
    both = own.where(f"asks or ({usable})").where(~(~F.col("asks") & (F.length("text") < 120) & F.col("text").rlike(rules.NO_ANSWER)))
    match = best_recall(both, key, "text", plan, runs).select(*key, F.struct("start", "end", "score").alias("match"))
    both = both.join(match, key, "left")
    asks = both.where("asks").select(
        "issue_id", "exchange", "case_id", F.col("text").alias("question_text"), F.col("match").alias("q"), F.col("speech_url").alias("question_url"), "previous_context")
    replies = both.where("not asks").select("issue_id", "exchange", "place", "speech_id", "speaker", "speaker_position", "date", "meeting", "speech_url", F.col("text").alias("answer_text"), F.col("match").alias("a"))
    rows = asks.join(replies, ["issue_id", "exchange"]).where("q is not null or a is not null")
    rows = rows.withColumn("ministry", roles.answering_agency(tx.normalize(F.col("speaker_position"), nfkc), F.col("answer_text"))).where("ministry is not null")
    q, a = F.coalesce("q.score", F.lit(0.0)), F.coalesce("a.score", F.lit(0.0))
    score = retrieval_score(q, a) if blend else tx.round3(F.when(F.col("q").isNotNull(), q).otherwise(a))
    first = F.when(F.length("answer_text") > 2000, first_window(F.col("answer_text")))
    rows = rows.withColumn("shown", F.when(F.col("a").isNull(), first).otherwise(F.struct("a.start", "a.end")))
    rows = rows.select(
        "case_id", "ministry", tx.context_clip(F.col("question_text"), F.col("q.start"), F.col("q.end"), 1600, 1000).alias("question"),
        tx.context_clip(F.col("answer_text"), F.col("shown.start"), F.col("shown.end"), 2000, 1100).alias("answer"),
        F.when(F.col("q").isNull(), F.col("previous_context")).otherwise(F.lit("")).alias("previous_context"),
        F.coalesce("speaker", F.lit(rules.UNNAMED)).alias("speaker"), F.coalesce("speaker_position", F.lit("")).alias("position"), F.coalesce("date", F.lit("")).alias("date"),
        F.coalesce("meeting", F.lit("")).alias("meeting"), F.col("speech_url").alias("url"), F.coalesce("question_url", F.lit("")).alias("question_url"),
        F.lit("unverified").alias("screening"), score.alias("retrieval_score"), "place", "question_text", "answer_text",
        F.coalesce(F.nullif("speech_id", F.lit("")), "speech_url").alias("_reply"),
    )
    rows = rows.withColumn("question_truncated", F.length("question") < F.length("question_text")).withColumn("answer_truncated", F.length("answer") < F.length("answer_text"))
    rows = keep_max(rows, ["case_id", "ministry", "_reply"], [F.desc("retrieval_score"), F.asc("place")])
    return rows.drop("question_text", "answer_text", "_reply").withColumnRenamed("place", "ord")


def held_for_context(rows: DataFrame) -> Column:
    """A clipped plenary answer of the prime minister is held until the whole is there."""
    return (F.col("meeting") == rules.PLENARY) & F.col("position").contains(rules.PRIME_MINISTER) & (F.col("question_truncated") | F.col("answer_truncated"))


def labeled_pairs(turns: DataFrame) -> DataFrame:
    """Training pairs by the earliest rules: question-like turns of lawmakers and every reply with an agency's title."""
    lawmaker = roles.is_lawmaker(F.col("speaker_group"), F.col("speaker_role"), F.col("speaker_position"))
    own = turns.withColumn("text", tx.squeeze(F.col("speech"))).withColumn("_lawmaker", lawmaker).withColumn("ministry", roles.first_rule(F.col("speaker_position")))
    own = own.withColumn("_order", F.coalesce("speech_order", F.lit(0)))
    pairs = ask_reply_pairs(
        own, "issue_id", ["_order", "ord"], F.col("_lawmaker"), F.col("ministry").isNotNull(), {"question": "text"},
        {"answer": "text", "ministry": "ministry", "speaker": "speaker", "position": "speaker_position", "date": "date", "meeting": "meeting", "url": "speech_url", "ord": "ord"},
    )
    pairs = pairs.where(roles.is_question_like(F.col("question")))
    names = ("question", "answer", "ministry", "speaker", "position", "date", "meeting", "url")
    return pairs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in names], "ord")


def tool_pairs(turns: DataFrame, terms: list[str]) -> DataFrame:
    """Pairs by the tool's rules: the terms stand near each other in the question or the reply. A question has 20 letters at least, and a
    reply counts once for its agency: of rows with one meeting, id and agency the first."""
    lawmaker = roles.is_lawmaker(F.col("speaker_group"), F.col("speaker_role"), F.col("speaker_position"))
    own = turns.withColumn("text", tx.squeeze(F.col("speech"))).withColumn("_lawmaker", lawmaker).withColumn("ministry", roles.first_rule(F.col("speaker_position")))
    own = own.withColumn("span", nearest_span(F.col("text"), terms)).withColumn("_order", F.coalesce("speech_order", F.lit(0))).withColumn("hit", term_share(F.col("text"), terms))
    pairs = ask_reply_pairs(
        own, "issue_id", ["_order", "ord"], F.col("_lawmaker"), F.col("ministry").isNotNull(),
        {"question_text": "text", "question_span": "span", "question_hit": "hit", "question_id": "speech_id", "question_order": "speech_order"},
        {"answer_text": "text", "answer_span": "span", "answer_hit": "hit", "ministry": "ministry", "speaker": "speaker", "position": "speaker_position", "date": "date", "meeting": "meeting", "url": "speech_url", "ord": "ord", "answer_id": "speech_id", "_order": "_order"},
    )
    near = pairs.where("length(question_text) >= 20 and answer_text <> ''").where("(question_span is not null or answer_span is not null) and (length(question_text) <= 1000 or answer_span is not null)")
    near = near.withColumn("relevance", F.round(F.greatest("question_hit", "answer_hit"), 3))
    near = near.withColumn("question", tx.excerpt(F.col("question_text"), F.col("question_span.start"))).withColumn("answer", tx.excerpt(F.col("answer_text"), F.col("answer_span.start")))
    first = keep_max(near.withColumn("answer_id", F.coalesce("answer_id", F.lit(""))), ["issue_id", "answer_id", "ministry"], [F.asc("_order"), F.asc("ord")])
    first = first.withColumn("context_match", F.when(F.col("answer_span").isNotNull(), "answer").otherwise("question"))
    named = F.coalesce(F.nullif("question_id", F.lit("")), F.col("question_order").cast("string"), F.lit(""))
    first = first.withColumn("case_id", F.concat_ws(":", F.coalesce(F.nullif("issue_id", F.lit("")), F.col("date"), F.lit("")), named))
    return first.drop("question_text", "answer_text", "question_span", "answer_span", "question_hit", "answer_hit", "exchange", "question_order", "answer_id", "_order")


def route_pairs(turns: DataFrame, words: list[str], least: float = 0.055, limit: int = 25) -> DataFrame:
    """Pairs by the starter route's rules: question-like turns similar enough to the question's words, and every reply with an
    agency's title; the most similar ones, cut short. Words of a turn are runs of letters, as rows aren't segmented."""
    own = turns.withColumn("text", F.coalesce("speech", F.lit(""))).withColumn("ministry", roles.first_rule(F.col("speaker_position"))).withColumn("_order", F.coalesce("speech_order", F.lit(0)))
    own = own.withColumn("score", set_similarity(words, F.col("text"), tx.word_tokens(F.col("text"), rules.ROUTE_STOPWORDS)))
    pairs = ask_reply_pairs(
        own, "issue_id", ["_order", "ord"], roles.is_route_legislator(F.col("speaker_group"), F.col("speaker_role"), F.col("speaker_position")), F.col("ministry").isNotNull() & (F.trim("text") != ""),
        {"question": "text", "score": "score"}, {"answer": "text", "ministry": "ministry", "speaker": "speaker", "position": "speaker_position", "date": "date", "meeting": "meeting", "url": "speech_url", "ord": "ord"},
    )
    pairs = pairs.where(roles.is_question_like(F.col("question")) & (F.col("score") >= least))
    pairs = pairs.withColumns({"question": F.left("question", F.lit(260)), "answer": F.left("answer", F.lit(220)), "speaker": F.coalesce("speaker", F.lit(rules.UNNAMED))})
    return pairs.drop("exchange").orderBy(F.desc("score"), "issue_id", "ord").limit(limit)
