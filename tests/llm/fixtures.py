"""Documents with all the hard cases, and plain versions of what the operators compute."""

import random

import xxhash

WS = " \t\n\v\f\r"


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in WS:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return [*out, word] if word else out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, extra=True):
    """(doc_id, text, lang, source, n_chars, and columns whose names clash with what operators use)."""
    rng = random.Random(4)
    base = prose(rng, 120)
    passage = prose(rng, 60)
    texts = [base, base, base + " tail", base.upper(), None, "", "   \n\t ", "one", "one two", "a b " * 120, prose(rng, 3000), "é " + prose(rng, 50) + " ü x", passage]
    texts += [prose(rng, 40) + " " + passage + "\n" + prose(rng, 30) for _ in range(6)]
    texts += [prose(rng, 80) for _ in range(12)] + ["same words here"] * 5
    rows = [(i, t, "en", [None, "s1", "s2", "s3"][i % 4], len(t or ""), 1, "x", i, "y") for i, t in enumerate(texts)]
    rows += [rows[0], rows[9], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, text_key string, score long, rank string"
    df = spark.createDataFrame(rows, schema)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def simhash(text):
    w = words_of(lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
