"""Sentences, windows of up to five of them, and the best window of a text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import rules
from colloquy.functions.hits import coverages, held, mask_coverages, may_hit, supported, terms_of, weighted_coverage
from colloquy.functions.text import occurrences
from colloquy.plans.plan import Concept, Plan

MOST, LONGEST = 5, 800


def sentence_list(text: Column, ends: str = rules.SENTENCE_END) -> Column:
    """The sentences of a text, which together are the text. A sentence ends after a match of `ends`."""
    return F.filter(occurrences(text, rf"(?s).*?(?:{ends})|(?s).+$"), lambda s: s != "")


def sentences(df: DataFrame, text: str, ends: str = rules.SENTENCE_END) -> DataFrame:
    """df with a row for each sentence: sentence_no from 0, sentence."""
    return df.select("*", F.posexplode(sentence_list(F.col(text), ends)).alias("sentence_no", "sentence"))


def passage_windows(df: DataFrame, key: list[str], text: str, ends: str = rules.SENTENCE_END, shift: str = rules.TOPIC_SHIFT, most: int = MOST, longest: int = LONGEST) -> DataFrame:
    """(key, window_no, n_sentences, start, end, passage): runs of 1 to `most` sentences, start-major, of at most `longest` characters.

    A run never goes on into a sentence that opens a new topic. key must name a row.
    """
    order = Window.partitionBy(*key).orderBy("sentence_no")
    cut = sentences(df.select(*key, F.col(text).alias("text")), "text", ends)
    cut = cut.withColumn("start", F.coalesce(F.sum(F.length("sentence")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ahead = F.collect_list(F.struct("sentence", F.col("sentence").rlike(shift).alias("opens"))).over(order.rowsBetween(0, most - 1))
    cut = cut.select(*key, "sentence_no", "start", ahead.alias("ahead"))
    each = cut.withColumn("n_sentences", F.explode(F.sequence(F.lit(1), F.size("ahead")))).withColumn("own", F.slice("ahead", F.lit(1), F.col("n_sentences")))
    each = each.where(~F.exists(F.slice("own", F.lit(2), F.lit(most)), lambda s: s["opens"]))
    each = each.withColumn("passage", F.array_join(F.transform("own", lambda s: s["sentence"]), "")).where(F.length("passage") <= longest)
    return each.select(*key, (F.col("sentence_no") * most + F.col("n_sentences") - 1).alias("window_no"), "n_sentences", "start", (F.col("start") + F.length("passage")).alias("end"), "passage")


def best_windows(windows: DataFrame, key: list[str], score: Column, *then: Column) -> DataFrame:
    """The window of each text with the highest score; ties go by `then`, at last to the first window."""
    rank = Window.partitionBy(*key).orderBy(F.desc("score"), *then, "window_no")
    return windows.withColumn("score", score).where("score is not null").withColumn("rank", F.row_number().over(rank)).where("rank = 1").drop("rank")


def question_windows(windows: DataFrame, key: list[str], plan: Plan, runs: dict | None = None) -> DataFrame:
    """The window that asks best: all concepts supported, an interrogative cue counts .02, length counts against it."""
    cover = windows.withColumn("cover", coverages(F.col("passage"), list(plan.groups), runs))
    cover = cover.where(supported(F.col("cover"))).where(~(F.col("passage").rlike(rules.ASKS_NOT) & ~F.col("passage").rlike(rules.ASKS_ANYWAY)))
    cover = cover.withColumn("coverage", weighted_coverage(F.col("cover")))
    cue = F.when(F.col("passage").rlike(rules.ASKS), F.lit(0.02)).otherwise(F.lit(0.0))
    return best_windows(cover, key, F.col("coverage") + cue - F.length("passage") / 5000).drop("cover")


def recall_windows(windows: DataFrame, key: list[str], plan: Plan, runs: dict | None = None) -> DataFrame:
    """The window with the highest mean coverage of the subjects, of which one at least is half covered; then the shortest."""
    cover = windows.withColumn("cover", coverages(F.col("passage"), plan.subjects, runs)).where(half_covered(F.col("cover")))
    return best_windows(cover, key, weighted_coverage(F.col("cover")), F.length("passage")).drop("cover")


def first_window(text: Column, ends: str = rules.SENTENCE_END, longest: int = LONGEST) -> Column:
    """struct(start, end) of a text's first window: its first sentence that isn't too long; null if there is none."""

    def place(sizes: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x)
        at = F.filter(F.transform(sizes, lambda n, i: F.when(n <= longest, i)), lambda i: i.isNotNull())
        return F.get(F.transform(F.slice(at, 1, 1), lambda i: F.struct(before(i).alias("start"), (before(i) + F.get(sizes, i)).alias("end"))), 0)

    return F.get(F.transform(F.array(F.transform(sentence_list(text, ends), lambda s: F.length(s))), place), 0)


def half_covered(cover: Column) -> Column:
    return F.exists(cover, lambda c: c >= 0.5)


# --- the best window of a text, within its row ------------------------------------------------------


def best_window(text: Column, concepts: list[Concept], runs: dict | None, keep: Callable[[Column], Column], score: Callable[[Column], Column], shorter: bool, asks: bool, ends: str, shift: str) -> Column:
    """struct(score, window_no, n_sentences, start, end, passage, coverage) of a text's best window; null if none is kept.

    Concepts are looked for once in each sentence, as sets of bits that windows join; scores are then numbers alone, and only the
    best window is put together. keep and score are given a window: cover, size (in characters), asks, refuses. Nothing is
    exploded or shuffled, and steps are bound to lambda variables so that each is done once. Only for concepts that can't lie
    across the end of a sentence.
    """
    add = lambda a, x: a + x
    own_flags = lambda s: [F.when(s.rlike(p), F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate((rules.ASKS, rules.ASKS_NOT, rules.ASKS_ANYWAY))]
    flags = lambda s: sum(own_flags(s), F.lit(0)).cast("long") if asks else F.lit(0).cast("long")
    cut = lambda s: F.struct(F.length(s).alias("size"), s.rlike(shift).alias("opens"), F.array(*[held(s, c, runs) for c in concepts], flags(s)).alias("bits"))
    none = F.array(*[F.lit(0).cast("long")] * (len(concepts) + 1))
    kind = "array<struct<i:int,n:int,size:int,bits:array<bigint>>>"

    def windows(all_cut: Column, i: Column) -> Column:
        """The windows that begin at sentence i, each one sentence longer than the last."""
        begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(True).alias("fits"), none.alias("bits"), F.array().cast(kind).alias("out"))

        def longer(w: Column, t: Column) -> Column:
            fits = w["fits"] & ((w["n"] == 0) | ~t["opens"]) & (w["size"] + t["size"] <= LONGEST)
            bits = F.zip_with(w["bits"], t["bits"], lambda x, y: x.bitwiseOR(y))
            grown = F.struct((w["n"] + 1).alias("n"), (w["size"] + t["size"]).alias("size"), fits.alias("fits"), bits.alias("bits"), w["out"].alias("out"))
            own = lambda g: F.struct(i.alias("i"), g["n"].alias("n"), g["size"].alias("size"), g["bits"].alias("bits"))
            put = lambda g: F.struct(g["n"].alias("n"), g["size"].alias("size"), g["fits"].alias("fits"), g["bits"].alias("bits"), F.array_append(g["out"], own(g)).alias("out"))
            return F.when(fits, F.get(F.transform(F.array(grown), put), 0)).otherwise(F.struct(w["n"].alias("n"), w["size"].alias("size"), F.lit(False).alias("fits"), w["bits"].alias("bits"), w["out"].alias("out")))

        return F.aggregate(F.slice(all_cut, i + 1, MOST), begin, longer, lambda w: w["out"])

    def scored(w: Column) -> Column:
        cover, said = mask_coverages(w["bits"], concepts), F.element_at(w["bits"], -1)
        has = lambda i: said.bitwiseAND(F.lit(1 << i)) != 0
        return F.struct(cover.alias("cover"), w["size"].alias("size"), w["i"].alias("i"), w["n"].alias("n"), has(0).alias("asks"), (has(1) & ~has(2)).alias("refuses"))

    def ranked(w: Column) -> Column:
        by = F.struct(score(w).alias("score"), (-w["size"] if shorter else F.lit(0)).alias("shorter"), (-(w["i"] * MOST + w["n"] - 1)).alias("first"))
        return F.struct(by.alias("by"), w["i"].alias("i"), w["n"].alias("n"), w["size"].alias("size"), weighted_coverage(w["cover"]).alias("coverage"))

    def best(s: Column) -> Column:
        # a window that begins with a sentence that holds nothing is beaten by the one without it
        at = F.filter(F.sequence(F.lit(0), F.size(s["cut"]) - 1), lambda i: F.exists(F.get(s["cut"], i)["bits"], lambda b: b != 0))
        fit = F.transform(F.flatten(F.transform(at, lambda i: windows(s["cut"], i))), scored)
        top = F.array_max(F.transform(F.filter(fit, keep), ranked))
        return F.struct(s["said"].alias("said"), s["cut"].alias("cut"), top.alias("top"))

    def found(b: Column) -> Column:
        top = b["top"]
        start = F.aggregate(F.transform(F.slice(b["cut"], 1, top["i"]), lambda s: s["size"]), F.lit(0), add)
        passage = F.array_join(F.slice(b["said"], top["i"] + 1, top["n"]), "")
        whole = F.struct(top["by"]["score"].alias("score"), (-top["by"]["first"]).alias("window_no"), top["n"].alias("n_sentences"), start.alias("start"), (start + top["size"]).alias("end"), passage.alias("passage"), top["coverage"].alias("coverage"))
        return F.when(top.isNotNull(), whole)

    said = F.filter(F.array(sentence_list(text, ends)), lambda s: F.size(s) > 0)
    steps = F.transform(F.transform(said, lambda s: F.struct(s.alias("said"), F.transform(s, cut).alias("cut"))), best)
    return F.get(F.transform(steps, found), 0)


def _best(df: DataFrame, text: str, concepts: list[Concept], runs: dict | None, name: str, **how) -> DataFrame:  # noqa: ANN003
    """df's rows with name: their best window; rows without one go. Only texts that hold a term are cut at all."""
    own = df.where(may_hit(F.col(text), concepts))
    return own.select("*", F.explode(F.array_compact(F.array(best_window(F.col(text), concepts, runs, **how)))).alias(name))


def crosses(concepts: list[Concept], ends: str) -> bool:
    """May a term of the concepts lie across the end of a sentence?"""
    return any(re.search(ends, t) for c in concepts for t in terms_of(c))


def _rows(df: DataFrame, key: list[str], text: str, concepts: list[Concept], runs: dict | None, ends: str, shift: str, slow: Callable[[DataFrame], DataFrame], columns: list[str], **how) -> DataFrame:  # noqa: ANN003
    if crosses(concepts, ends):
        return slow(passage_windows(df, key, text, ends, shift)).select(*key, *columns)
    return _best(df.select(*key, F.col(text).alias("_text")), "_text", concepts, runs, "_w", ends=ends, shift=shift, **how).select(*key, *[F.col(f"_w.{c}").alias(c) for c in columns])


def best_recall(df: DataFrame, key: list[str], text: str, plan: Plan, runs: dict | None = None, ends: str = rules.SENTENCE_END, shift: str = rules.TOPIC_SHIFT) -> DataFrame:
    """(key, start, end, passage, score): recall_windows of each text of df, without a shuffle. key must name a row."""
    how = {"keep": lambda w: half_covered(w["cover"]), "score": lambda w: weighted_coverage(w["cover"]), "shorter": True, "asks": False}
    return _rows(df, key, text, plan.subjects, runs, ends, shift, lambda w: recall_windows(w, key, plan, runs), ["start", "end", "passage", "score"], **how)


def best_question(df: DataFrame, key: list[str], text: str, plan: Plan, runs: dict | None = None, ends: str = rules.SENTENCE_END, shift: str = rules.TOPIC_SHIFT) -> DataFrame:
    """(key, start, end, passage, coverage, score): question_windows of each text of df, without a shuffle."""
    cue = lambda w: F.when(w["asks"], F.lit(0.02)).otherwise(F.lit(0.0))
    how = {"keep": lambda w: supported(w["cover"]) & ~w["refuses"], "score": lambda w: weighted_coverage(w["cover"]) + cue(w) - w["size"] / 5000, "shorter": False, "asks": True}
    return _rows(df, key, text, list(plan.groups), runs, ends, shift, lambda w: question_windows(w, key, plan, runs), ["start", "end", "passage", "coverage", "score"], **how)


def best_supported(df: DataFrame, key: list[str], text: str, plan: Plan, runs: dict | None = None, ends: str = rules.SENTENCE_END, shift: str = rules.TOPIC_SHIFT) -> DataFrame:
    """(key, start, end, passage, score): of the windows that support all concepts the one that covers most, then the shortest."""

    def slow(windows: DataFrame) -> DataFrame:
        cover = windows.withColumn("cover", coverages(F.col("passage"), list(plan.groups), runs)).where(supported(F.col("cover")))
        return best_windows(cover, key, weighted_coverage(F.col("cover")), F.length("passage"))

    how = {"keep": lambda w: supported(w["cover"]), "score": lambda w: weighted_coverage(w["cover"]), "shorter": True, "asks": False}
    return _rows(df, key, text, list(plan.groups), runs, ends, shift, slow, ["start", "end", "passage", "score"], **how)
