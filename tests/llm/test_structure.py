"""Structure repair against a search over all edits, conversation by conversation."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from colloquy.llm import op13_structure as op

sys.setrecursionlimit(10_000)
WS = " \t\n\v\f\r"
FOLLOW = {"": "u", "s": "u", "u": "a", "a": "u"}
KEPT = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
NAMES = {"u": "user", "a": "assistant"}


def best(rows):
    """(cost, edits) of the cheapest repair of rows (role, fault), the least string among equals."""

    @lru_cache(None)
    def ahead(i, state, puts):
        role, fault = rows[i] if i < len(rows) else (None, None)
        out = []
        if i == len(rows) and state in ("", "a"):
            out.append((0, ""))
        if puts < 3:
            c, e = ahead(i, FOLLOW[state], puts + 1)
            out.append((c + 3, "I" + e))
        if i < len(rows):
            c, e = ahead(i + 1, state, 0)
            out.append((c + 4, "D" + e))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if (state, role[:1]) in KEPT:
                    c, e = ahead(i + 1, role[:1], 0)
                    out.append((c + extra, "K" + e))
                c, e = ahead(i + 1, FOLLOW[state], 0)
                out.append((c + extra + 3, "R" + e))
        return min(out, default=(10**9, ""))

    return ahead(0, "", 0)


def repaired(rows, edits):
    out, state, i = [], "", 0
    for e in edits:
        if e == "D":
            i += 1
        elif e == "I":
            state = FOLLOW[state]
            out.append((NAMES[state], ""))
        else:
            role, text = rows[i]
            state = role[:1] if e == "K" else FOLLOW[state]
            out.append((role if e == "K" else NAMES[state], text))
            i += 1
    assert i == len(rows) and state in ("", "a")
    return out


def bare(text):
    return text.rstrip(WS)


def report(rows):
    """Everything but conv_id for rows (turn, role, text) in any order."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=key)
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append("blank" if not bare(text) else "duplicate" if (role, text) in seen else "truncated" if bare(text)[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1], b[1][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(rows, rows[1:]))
    cost, edits = best(tuple((r, f) for (_, r, _), f in zip(rows, faults)))
    text = "\n".join(f"{r}:{t}" for r, t in repaired([(r, t) for _, r, t in rows], edits))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest())


def hurt(rows):
    """Rows (conv_id, turn, role, text) after the damage."""
    out = []
    for conv, turn, role, text in rows:
        n = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{n(conv)}:{n(turn)}".encode()) % 20
        role, text = n(role), n(text)
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def want(rows, damage=True):
    ids = {r[0] for r in rows}
    by = defaultdict(list)
    for conv, *r in hurt(rows) if damage else rows:
        by[conv].append(r)
    return {c: report(by[c]) for c in ids}


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def conversations(rng, n, most=9):
    texts = ["Yes.", "No!", "Why?", "", " \n\t", None, "cut off", "cut \v\n", "Done. \r\n", ".", "é?", "word"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "User", "unknown", "s"]
    out = []
    for conv in range(n):
        turns = list(range(rng.randrange(1, most)))
        if rng.random() < 0.2:
            turns = [rng.choice([None, 2, 5, 9]) for _ in turns]
        out += [(conv if conv % 17 else None, t, rng.choice(roles[: 2 + rng.randrange(10)]) if rng.random() < 0.5 else ("user", "assistant")[(t or 0) % 2], rng.choice(texts) if rng.random() < 0.6 else f"t{conv} {t}.") for t in turns]
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", cost int, kind string").repartition(5)


def test_structure(spark):
    rows = conversations(random.Random(1), 700) + [(900, t, "user", f"{t}.") for t in range(40)] + [(901, 0, "user", "x " * 300_000), (902, 5, "assistant", "y.\n" * 90_000)]
    df = table(spark, rows)
    assert got(op.structure_rows(df)) == want(rows)
    plain = want(rows, damage=False)
    assert got(op.repair_reports(df)) == {c: r[1:] for c, r in plain.items()}
    assert got(op.turn_gaps(df)) == {c: r[:1] for c, r in plain.items()}


@pytest.mark.parametrize(("stretch", "chars"), [(3, 10**6), (1, 10**6), (10**6, 12)])
def test_long(spark, monkeypatch, stretch, chars):
    """Conversations cut into parts have the results of whole ones."""
    rows = conversations(random.Random(2), 120, 14) + [(900, t, ("user", "tool", "assistant")[t % 3], f"{t % 5}.") for t in range(150)]
    df = table(spark, rows)
    monkeypatch.setattr(op, "STRETCH", stretch)
    monkeypatch.setattr(op, "STRETCH_CHARS", chars)
    assert op.repaired_parts(df)[1].count() > 50
    assert got(op.structure_rows(df)) == want(rows)
    turns = defaultdict(list)
    for r in sorted(op.repaired_turns(df).collect(), key=lambda r: (r["part"], r["at"])):
        turns[r["conv_id"]].append((r["role"], r["text"]))
    own = {c: hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns[c]).encode()).hexdigest() for c in {r[0] for r in rows}}
    assert own == {c: r[-1] for c, r in want(rows, damage=False).items()}


def test_hot_conversation(spark, monkeypatch):
    """A third of all rows in one conversation: no task gets more of it than a part."""
    monkeypatch.setattr(op, "STRETCH", 100)
    rng = random.Random(5)
    rows = [(1000, t, rng.choice(["user", "assistant"]), rng.choice(["same.", f"{t}.", "cut"])) for t in range(400)] + conversations(rng, 150, 7)
    df = table(spark, rows)
    _, parts = op.repaired_parts(df)
    assert sorted(r["part"] for r in parts.select("part").collect()) == [0, 100, 200, 300]
    assert got(op.structure_rows(df)) == want(rows)


def test_small_tensors(spark, monkeypatch):
    """Results don't depend on how many turns are gathered or repaired at once."""
    for name, n in (("ROWS", 5), ("BYTES", 40), ("CELLS", 8)):
        monkeypatch.setattr(op, name, n)
    rows = conversations(random.Random(3), 150)
    assert got(op.structure_rows(table(spark, rows))) == want(rows)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = op.op13_structure(spark, sf)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got(df) == want(rows)


def test_nothing_left(spark):
    """A conversation whose rows are all dropped, and an empty table."""
    conv = next(i for i in range(10**4) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "Hi.")], SCHEMA)
    assert got(op.structure_rows(df)) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    empty = df.where("conv_id < 0")
    assert op.structure_rows(empty).collect() == [] and op.repaired_turns(empty).collect() == []


def test_ties():
    """Tensors against the search, on random turns of many lengths at once."""
    rng = np.random.default_rng(4)
    roles = np.array(["system", "user", "assistant", "tool"])
    length = rng.integers(1, 9, 400)
    kind, fault = rng.integers(0, 4, (8, 400)), rng.choice(["", "", "", "blank", "duplicate", "truncated"], (8, 400))
    bucket = op.Bucket(kind, np.isin(fault, ["blank", "duplicate"]), np.where(fault == "truncated", 3, 0), length)
    ahead = op.costs_ahead(bucket, np.broadcast_to(op._END, (400, 4)))
    letters, _, _ = op.traced(bucket, ahead, np.zeros(400, np.int64), np.ones(400, bool))
    for b in range(400):
        rows = tuple((str(roles[k]), str(f)) for k, f in zip(kind[: length[b], b], fault[: length[b], b]))
        assert (int(ahead[0, b, 0]), letters[:, b][letters[:, b] > 0].tobytes().decode()) == best(rows)
