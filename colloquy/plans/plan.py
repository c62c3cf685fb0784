"""The plan of a draft question: its concepts, and the queries that look for them. Made on the driver; plans are small."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

from colloquy import rules

Segment = tuple[str, bool]
Segmenter = Callable[[str], list[Segment]]

_KATAKANA = re.compile("[ァ-ヺヽ-ヿㇰ-ㇿ]")
_KATAKANA_RUN = re.compile("[ァ-ヺー-ヿㇰ-ㇿ]+")
_HAN = re.compile(f"[{rules.HAN}]")
MOST_CONCEPTS, LONGEST_CONCEPT, MOST_QUERIES = 12, 80, 5


@dataclass(frozen=True)
class Concept:
    text: str
    parts: tuple[str, ...]
    role: str | None = None


@dataclass(frozen=True)
class Plan:
    question: str
    groups: tuple[Concept, ...]
    queries: tuple[str, ...]
    recall_groups: tuple[Concept, ...] = field(default=())

    @property
    def subjects(self) -> list[Concept]:
        """What recall looks for: all concepts but the change asked for, and the hints."""
        return [*(g for g in self.groups if g.role != "requested_change"), *self.recall_groups]


def clean(text: str | None) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or "")).strip()


def is_katakana(term: str) -> bool:
    return bool(_KATAKANA_RUN.fullmatch(term))


def distinctive(word: str) -> bool:
    return len(word) >= 2 and word not in rules.FILLER and not re.fullmatch(r"\d+", word)


def stems(part: str) -> list[str]:
    return [part, part[:-1]] if part.endswith("化") and len(part) > 2 else [part]


class Noun:
    """A run of neighbouring segments that make one noun phrase."""

    def __init__(self) -> None:
        self.items: list[str] = []
        self.lead = ""

    def glue(self, letter: str) -> None:
        if self.items:
            self.items[-1] += letter
        else:
            self.lead = letter

    def push(self, word: str) -> None:
        self.items.append(self.lead + word)
        self.lead = ""

    def take(self) -> Concept | None:
        items, self.items, self.lead = self.items, [], ""
        text = "".join(items)
        parts = (text,) if is_katakana(text) else tuple(dict.fromkeys(i for i in items if distinctive(i)))
        return Concept(text, parts) if items and parts and len(text) <= LONGEST_CONCEPT else None


def concepts(text: str, segment: Segmenter) -> list[Concept]:
    """Noun phrases of a text, the first place of each and the last form of it."""
    noun, found = Noun(), []
    for raw, wordlike in segment(clean(text)):
        word = raw.strip()
        if noun.items and (word == "ー" or (len(word) == 1 and _KATAKANA.match(word))):
            noun.items[-1] += word
        elif wordlike and len(word) == 1 and _HAN.match(word) and word != "界":
            noun.glue(word)
        elif wordlike and word != "界" and distinctive(word):
            noun.push(word)
        else:
            found.append(noun.take())
    found.append(noun.take())
    return list({c.text: c for c in found if c}.values())[:MOST_CONCEPTS]


def phrases(text: str, segment: Segmenter, most: int = 3) -> list[str]:
    return [c.text for c in concepts(text, segment)[:most]]


def law_term(phrase: str, segment: Segmenter) -> str:
    """A Katakana phrase whole, else its first segment of three letters or more, else the phrase."""
    return phrase if is_katakana(phrase) else next((w for w, wordlike in segment(phrase) if wordlike and len(w) >= 3), phrase)


def terms(text: str, segment: Segmenter, stopwords: tuple[str, ...] = rules.ROUTE_STOPWORDS) -> list[str]:
    own = (w.strip() for w, wordlike in segment(text) if wordlike)
    return list(dict.fromkeys(w for w in own if len(w) >= 2 and w not in stopwords and not re.fullmatch(rules.DIGITS, w)))


def longest_terms(words: list[str], n: int = 2) -> list[str]:
    return sorted(words, key=len, reverse=True)[:n]


def requested_change(question: str) -> tuple[str, str]:
    """The question without its wrapping and with demands made neutral, and the change demanded last ('' if none)."""
    text = re.sub(rules.REQUEST_SUFFIX, "", clean(question))
    wanted = [m[1] for m in re.finditer(rules.SHOULD, text) if m[1] not in rules.SHOULD_GENERIC]
    return re.sub(rules.SHOULD, "を進めるべき", text), wanted[-1] if wanted else ""


def make_plan(question: str, segment: Segmenter, hints: tuple[str, ...] = ()) -> Plan:
    """Concepts of a question and up to five AND queries, from narrow to wide. Hints widen recall and never decide relevance."""
    text, change = requested_change(question)
    groups = concepts(text, segment)
    if change and all(g.text != change for g in groups):
        groups.append(Concept(change, (change,), "requested_change"))
    given = [h for h in map(clean, hints) if 2 <= len(h) <= LONGEST_CONCEPT]
    groups = groups or [Concept(h, (h,)) for h in given]
    anchors = [g.text if not i or is_katakana(g.text) else max(g.parts, key=len) for i, g in enumerate(groups)]
    subjects = [g for g in groups if g.role != "requested_change"]
    lists = [given, [g.text for g in subjects[:2]]]
    lists.append([subjects[1].text] if len(subjects) > 1 and len(subjects[1].parts) > 1 else anchors[:1])
    lists.append([g.text for g in subjects[:3]])
    lists.append([a for a, g in zip(anchors, groups, strict=True) if g.role != "requested_change"][:3])
    if len(groups) > 1:
        lists += [anchors[:2], [groups[1].text]]
    lists.append(anchors[:1])
    queries = list(dict.fromkeys(q for q in (" ".join(dict.fromkeys(t for t in own if t)) for own in lists) if q))
    if len(queries) > MOST_QUERIES:
        queries = [*queries[: MOST_QUERIES - 1], queries[-1]]
    recall = tuple(c for h in given for c in concepts(h, segment))
    return Plan(clean(question), tuple(groups), tuple(queries), recall)


def valid_query(query: str) -> bool:
    """A proposed query: 2 to 80 characters, letters and digits in words."""
    return 2 <= len(query) <= 80 and all(c.isalnum() or c in " ー々・" for c in query) and not query.isspace()


def widened(plan: Plan, propose: Callable[[str], list[str]], segment: Segmenter) -> Plan:
    """The plan with two to four AND queries from a callback (a language model, say) in place of its own."""
    own = list(dict.fromkeys(clean(re.sub(r"\s+AND\s+", " ", q)) for q in propose(plan.question)))
    own = [q for q in own if valid_query(q)][:4]
    if len(own) < 2:
        raise ValueError("need at least two valid queries")
    return Plan(plan.question, plan.groups, tuple(own), tuple(c for q in own for c in concepts(q, segment)))


def validate_request(question: str, since: str = "", search_terms: tuple[str, ...] = (), least: int = 8, most: int = 1200) -> str:
    """The clean question; ValueError for one of the wrong length, a date that isn't ISO, or terms of the wrong length."""
    question = clean(question)
    if not least <= len(question) <= most:
        raise ValueError(f"the question must have {least} to {most} characters")
    if since and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", since):
        raise ValueError("since must be a date as YYYY-MM-DD")
    if any(not 2 <= len(clean(t)) <= 30 for t in search_terms):
        raise ValueError("search terms must have 2 to 30 characters")
    return question
