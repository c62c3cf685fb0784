"""Who speaks, and for which agency: column expressions over the fields of a turn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import rules


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def office(role: Column, position: Column) -> Column:
    return F.concat_ws(" ", _some(role), _some(position))


def is_chair(role: Column, position: Column, text: Column) -> Column:
    """A chair by office, or by the speaker's name at the head of the (normalized) text."""
    return office(role, position).rlike(rules.CHAIR) | _some(text).rlike(rules.CHAIR_HEADER)


def is_questioner(group: Column, role: Column, position: Column, text: Column) -> Column:
    return (_some(group) != "") & ~is_chair(role, position, text) & ~office(role, position).rlike(rules.GOVERNMENT)


def is_lawmaker(group: Column, role: Column, position: Column, chair: str = rules.EARLY_CHAIR, government: str = rules.EARLY_GOVERNMENT) -> Column:
    """The earlier rule, by office alone; board members count as chairs."""
    return (_some(group) != "") & ~office(role, position).rlike(chair) & ~office(role, position).rlike(government)


def is_route_legislator(group: Column, role: Column, position: Column) -> Column:
    return (_some(group) != "") & ~office(role, position).rlike(rules.ROUTE_NOT_LEGISLATOR)


def is_question_like(text: Column, pattern: str = rules.QUESTION_LIKE, least: int = 35) -> Column:
    return (F.length(text) >= least) & text.rlike(pattern)


def first_rule(title: Column, table: tuple[tuple[str, str], ...] = rules.EARLY_TITLE_RULES) -> Column:
    """The name of the first rule whose pattern is found; null if none is."""
    out = None
    for pattern, name in table:
        hit = _some(title).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def title_candidates(title: Column, table: tuple[tuple[str, str], ...] = rules.TITLE_RULES) -> Column:
    """Names of all rules found, by where they are found."""
    found = [F.struct(F.regexp_instr(_some(title), F.lit(pattern)).alias("at"), F.lit(i).alias("no"), F.lit(name).alias("name")) for i, (pattern, name) in enumerate(table)]
    return F.transform(F.array_sort(F.filter(F.array(*found), lambda r: r["at"] > 0)), lambda r: r["name"])


def speaks_as(name: str, text: Column) -> Column:
    """Does the (normalized) text say in its first 900 characters that it is given in the capacity of `name`?

    What stands before the name decides: a first-person phrase, the beginning, or the end of a sentence or word; a phrase that
    speaks of somebody else does not.
    """
    return _claims(F.substring(_some(text), F.lit(1), F.lit(900)), name)


def _claims(head: Column, name: str) -> Column:
    """speaks_as for a text's head. The pattern is only tried where the name stands at all."""
    others = rf"(?<!{rules.CAPACITY_OF_OTHERS})(?<!{rules.CAPACITY_OF_OTHERS}\s)"
    return F.contains(head, F.lit(name)) & head.rlike(rf"(?:^|(?<=[。 ])|(?<={rules.CAPACITY_OF_SELF}\s{{0,4}})){others}{name}{rules.CAPACITY}")


def answering_agency(title: Column, answer: Column, previous: Column | None = None, table: tuple[tuple[str, str], ...] = rules.TITLE_RULES, cabinet: str = rules.CABINET) -> Column:
    """The agency that an answer is given for; null when the title and the texts don't settle it.

    Candidates come from the title. One of them that the answer claims alone wins; of several, one that the previous answer claims
    alone; a title of the cabinet's offices yields to the one other agency that the answer claims. Otherwise a single specific
    candidate beats the cabinet, and two or more specific ones are left open.
    """
    names = list(dict.fromkeys(n for _, n in table))

    def claims(text: Column) -> Column:
        own = lambda head: F.filter(F.array(*[F.when(_claims(head, n), F.lit(n)) for n in names]), lambda n: n.isNotNull())
        return F.get(F.transform(F.array(F.substring(_some(text), F.lit(1), F.lit(900))), own), 0)

    def settled(s: Column) -> Column:
        given, claimed, now = s["given"], s["claimed"], s["now"]
        others = F.array_except(claimed, F.array(F.lit(cabinet)))
        specific = F.array_except(given, F.array(F.lit(cabinet)))
        before = F.array_intersect(given, claims(previous)) if previous is not None else F.array().cast("array<string>")
        return (
            F.when(F.size(now) == 1, F.get(now, 0))
            .when((F.size(given) > 1) & (F.size(before) == 1), F.get(before, 0))
            .when((F.size(given) == 1) & (F.get(given, 0) == cabinet) & (F.size(others) == 1), F.get(others, 0))
            .when(F.size(specific) > 1, F.lit(None))
            .otherwise(F.coalesce(F.get(specific, 0), F.get(given, 0)))
        )

    # Bound to lambda variables, so that the title and the texts are searched once and not for each use of what is found.
    found = F.transform(F.array(title_candidates(title, table)), lambda g: F.struct(g.alias("given"), F.when(F.size(g) > 0, claims(answer)).otherwise(F.array().cast("array<string>")).alias("claimed")))
    found = F.transform(found, lambda s: F.struct(s["given"].alias("given"), s["claimed"].alias("claimed"), F.array_intersect(s["given"], s["claimed"]).alias("now")))
    return F.get(F.transform(found, settled), 0)
