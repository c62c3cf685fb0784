"""Stretches of license text against a plain version that tries every one."""

import random

import duckdb

from colloquy.llm import op1_licenses as op1


def plain_scores(text):
    """For each label the best share of a template's pairs in any stretch of words; every stretch is tried."""
    w, found = op1_words(text), {}
    for label, t in op1.TEMPLATES:
        t = t.split()
        votes = {}
        for i in range(len(w) - 1):
            for j in range(len(t) - 1):
                if w[i : i + 2] == t[j : j + 2]:
                    votes.setdefault(i - j, set()).add(j)
        votes = {d: js for d, js in votes.items() if len(js) > 1}
        for d0 in votes:
            for lo in range(len(w)):
                held = {j for d, js in votes.items() if d0 <= d <= d0 + int(len(t) * (op1.STRETCH - 1)) for j in js if lo <= d + j and d + j + 2 <= lo + int(len(t) * op1.STRETCH)}
                if len(held) / (len(t) - 1) >= op1.COVER:
                    found[label] = max(found.get(label, 0), len(held) / (len(t) - 1))
    return found


def op1_words(text):
    return "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()


def test_license_copies_beside_each_other(spark):
    mit = op1.TEMPLATES[1][1]
    longer = mit.replace("free of charge to", "free of charge by the copyright holder to")
    halves = " ".join(mit.split()[10:] + mit.split()[:10])
    texts = ["All rights reserved. All rights reserved.", "All rights reserved.\n" * 50, longer, f"{mit} {mit}", f"{longer} {longer}", halves, "rights reserved all rights", ""]
    labels = ["proprietary", "proprietary", "mit", "mit", "mit", "", "", ""]
    rng, near = random.Random(3), []
    for _ in range(300):
        own = []
        for _ in range(rng.randint(1, 4)):
            t = rng.choice(op1.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 2)] = ["x"] * rng.randint(0, 6)
                t = t or ["x"]
            own += t + ["y"] * rng.choice([0, 0, 1, 5])
        near.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in op1.scan_licenses(docs).collect()}
    assert [got[i]["labels"] for i in range(len(texts))] == labels
    for i, text in enumerate(texts + near):
        scores = plain_scores(text)
        assert set(filter(None, got[i]["labels"].split(","))) == set(scores) | set(filter(None, got[i]["base_labels"].split(","))), text
        assert got[i]["score"] == max([*scores.values(), *([1.0] if got[i]["n_base"] else [])], default=0), text


def test_license_sql(spark, tmp_path):
    """The query's SQL says the same of repeated lines, copies side by side, words put in and left out, halves, and texts without any."""
    rng = random.Random(8)
    mit = op1.TEMPLATES[1][1]
    texts = ["All rights reserved. All rights reserved.", "All rights reserved.\n" * 5, f"{mit} {mit}", mit.replace("to any", "by the copyright holder to any"), " ".join(mit.split()[10:] + mit.split()[:10]), "MIT License, mit-license. GNU General Public License", "", None, "rights reserved all rights reserved"]
    for _ in range(150):
        own = []
        for _ in range(rng.randint(1, 3)):
            t = rng.choice(op1.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 2)] = ["x"] * rng.randint(0, 6)
                t = t or ["x"]
            own += t + ["y"] * rng.choice([0, 0, 1, 5])
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    found = con.execute(op1.OP1_SQL)
    names = [d[0] for d in found.description]
    want = {r[names.index("doc_id")]: dict(zip(names, r)) for r in found.fetchall()}
    got = {r["doc_id"]: r.asDict() for r in op1.scan_licenses(docs).collect()}
    assert got == want and want[0]["labels"] == "proprietary" and sum(bool(r["labels"]) for r in want.values()) > 80


def test_words_are_compared(spark, monkeypatch):
    """Pairs whose hashes are all alike give no votes but those of the same words."""
    monkeypatch.setattr(op1.F, "xxhash64", lambda *c: op1.F.lit(1).cast("long"))
    docs = spark.createDataFrame([(1, "all rights reserved"), (2, "all wrongs reversed here")], "doc_id long, text string")
    got = {(r["doc_id"], r["label"]) for r in op1.votes(docs).collect()}
    assert got == {(1, "proprietary")}
