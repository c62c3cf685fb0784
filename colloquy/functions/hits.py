"""Where a concept is found in a text, and how much of a plan a text covers: column expressions over literal concepts."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import rules
from colloquy.plans.plan import Concept, is_katakana, stems


def literal_pattern(term: str, runs: dict[str, list[int]] | None = None) -> str:
    """A pattern for the valid places of a term.

    A place is no hit if the term stands inside the name of a body or law: two Han letters or more right before it and a suffix
    of such names after it. A Katakana term that touches more Katakana is a hit only at word borders of that whole run; `runs`
    has for each such run the offsets at which the term is made of whole words (a run that isn't listed has none).
    """
    own = re.escape(term) if term.isascii() else "".join(re.escape(c) if c.isascii() else c for c in term)
    outside = rf"(?:(?<!\p{{IsHan}}\p{{IsHan}}){own}|{own}(?!{rules.ENTITY_SUFFIX}))"
    if not is_katakana(term):
        return outside
    alone = rf"(?<!{rules.KATAKANA}){outside}(?!{rules.KATAKANA})"
    more = []
    for run, offsets in sorted((runs or {}).items()):
        for at in offsets:
            head, tail = run[:at], run[at + len(term) :]
            more.append(rf"(?<=(?<!{rules.KATAKANA}){head}){outside}(?={tail}(?!{rules.KATAKANA}))")
    return "|".join([alone, *more])


def first_place(text: Column, term: str, runs: dict[str, list[int]] | None = None) -> Column:
    """Offset of the first valid place of a term, from 0; null if there is none. The pattern is only tried where the first place
    may be none."""
    at = F.instr(text, F.lit(term))
    plain = ~F.substring(text, F.greatest(at - 2, F.lit(1)), F.lit(2)).rlike(r"^\p{IsHan}{2}$")
    if is_katakana(term):
        plain = plain & ~F.concat(F.substring(text, at - 1, F.when(at > 1, 1).otherwise(0)), F.substring(text, at + len(term), F.lit(1))).rlike(rules.KATAKANA)
    found = F.regexp_instr(text, F.lit(literal_pattern(term, runs)))
    return F.when(at == 0, F.lit(None).cast("int")).when(plain, at - 1).when(found > 0, found - 1)


def concept_hit(text: Column, concept: Concept, runs: dict[str, dict[str, list[int]]] | None = None) -> Column:
    """struct(coverage, start, end): 1 for the whole concept, else the share of its parts found and the span they make."""
    own = lambda t: (runs or {}).get(t)
    whole = first_place(text, concept.text, own(concept.text))
    if concept.parts == (concept.text,) and len(stems(concept.text)) == 1:
        return F.struct(F.when(whole.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0)).alias("coverage"), whole.alias("start"), (whole + len(concept.text)).alias("end"))
    starts, ends = [], []
    for part in concept.parts:
        at, to = F.lit(None).cast("int"), F.lit(None).cast("int")
        for stem in reversed([s for s in stems(part) if s != concept.text]):
            place = first_place(text, stem, own(stem))
            at, to = F.coalesce(place, at), F.coalesce(place + len(stem), to)
        starts.append(at)
        ends.append(to)
    count = sum((s.isNotNull().cast("int") for s in starts), F.lit(0))
    partial = F.struct((count / len(concept.parts)).alias("coverage"), F.array_min(F.array(*starts)).alias("start"), F.array_max(F.array(*ends)).alias("end"))
    exact = F.struct(F.lit(1.0).alias("coverage"), whole.alias("start"), (whole + len(concept.text)).alias("end"))
    return F.when(whole.isNotNull(), exact).otherwise(partial)


def is_whole(concept: Concept) -> bool:
    """Is the concept found whole or not at all?"""
    return concept.parts == (concept.text,) and len(stems(concept.text)) == 1


def terms_of(concept: Concept) -> list[str]:
    return [concept.text, *(s for p in concept.parts for s in stems(p))]


def may_hit(text: Column, concepts: list[Concept]) -> Column:
    """Does a text hold any term of the concepts, valid or not? A plain search, to leave most texts out early."""
    out = F.lit(False)
    for term in dict.fromkeys(t for c in concepts for t in terms_of(c)):
        out = out | F.contains(text, F.lit(term))
    return out


def held(text: Column, concept: Concept, runs: dict[str, dict[str, list[int]]] | None = None) -> Column:
    """What of a concept a text holds, as bits: bit 0 for the whole, bit i for its part i. A concept has fewer than 63 parts, as it
    has at most 80 letters."""
    own = lambda t: first_place(text, t, (runs or {}).get(t)).isNotNull()
    out = F.when(own(concept.text), F.lit(1)).otherwise(F.lit(0)).cast("long")
    if not is_whole(concept):
        for i, part in enumerate(concept.parts):
            found = F.lit(False)
            for stem in [s for s in stems(part) if s != concept.text]:
                found = found | own(stem)
            out = out.bitwiseOR(F.when(found, F.lit(2 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def mask_coverages(bits: Column, concepts: list[Concept]) -> Column:
    """coverages from an array of what is held of each concept."""
    one = lambda i, c: F.when(F.get(bits, i).bitwiseAND(F.lit(1)) == 1, F.lit(1.0)).otherwise(F.lit(0.0) if is_whole(c) else F.bit_count(F.shiftright(F.get(bits, i), 1)) / len(c.parts))
    return F.array(*[one(i, c) for i, c in enumerate(concepts)])


def coverages(text: Column, concepts: list[Concept], runs: dict[str, dict[str, list[int]]] | None = None) -> Column:
    return F.array(*[concept_hit(text, c, runs)["coverage"] for c in concepts]) if concepts else F.array().cast("array<double>")


def weighted_coverage(cover: Column, weights: list[float] | None = None) -> Column:
    """Weighted mean of an array of coverages; without weights (or documents to take them from) the plain mean."""
    add = lambda a, x: a + x
    if weights is None:
        return F.aggregate(cover, F.lit(0.0), add) / F.greatest(F.size(cover), F.lit(1))
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(cover, w, lambda c, x: c * x), F.lit(0.0), add) / (math.fsum(weights) or 1.0)


def supported(cover: Column, least: float = 0.66) -> Column:
    return (F.size(cover) > 0) & F.forall(cover, lambda c: c >= least)


def rarity_weight(documents: Column, having: Column) -> Column:
    return 1 + F.log(1 + (documents + 1) / (having + 1))


def term_share(text: Column, terms: list[str]) -> Column:
    """Share of the terms that a text holds."""
    own = [t for t in terms if t]
    if not own:
        return F.lit(0.0)
    return F.when(F.length(text) > 0, sum((F.contains(text, F.lit(t)).cast("int") for t in own), F.lit(0)) / len(own)).otherwise(F.lit(0.0))


def set_similarity(query: list[str], text: Column, tokens: Column) -> Column:
    """Hits over the root of both sizes, where a query word hits if it is a token or stands anywhere in the text."""
    words = F.array(*[F.lit(w) for w in query]) if query else F.array().cast("array<string>")
    hits = F.size(F.filter(words, lambda w: F.array_contains(tokens, w) | F.contains(text, w)))
    return hits / F.sqrt(F.lit(float(max(len(query), 1))) * F.greatest(F.size(F.array_distinct(tokens)), F.lit(1)))
