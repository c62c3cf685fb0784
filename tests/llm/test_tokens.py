"""Token counts against the library itself, text by text."""

import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from fixtures import documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colloquy.llm import op11_tokens

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = ["don't we'll 's 'S it''s", "a  b   c\n\n d\t\te \r\n", "x<|endoftext|>y  <|endoftext|> z <|endoftext|>", "\x1c!\x1f a\x1cb", "日本語 の　文章。", "a\u00a0 b \u2003c\u2028 d\u3000\u3000e", "é è\u0301 ñ 👩‍👩‍👧 x", "12 345 6,789.0", "   ", "\n", " x", "x ", "<|endof", "text|>", "\u180e y\u200b z"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def plain(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab's \n\t\u00a0\u2003\u3000\x1cé語1.<|>!👩"), max_size=30) | st.text(max_size=12) | st.sampled_from(ODD), max_size=6))
def test_pieces(texts):
    """Any text, cut anywhere that is allowed, has as many tokens as whole."""
    library = Tokenizer.from_file(BYTES) if not hasattr(test_pieces, "own") else test_pieces.own
    test_pieces.own = library
    with open(BYTES, "rb") as file:
        lengths, cut = op11_tokens.encoder("json", file.read()) if not hasattr(test_pieces, "pair") else test_pieces.pair
    test_pieces.pair = lengths, cut
    assert cut
    for piece, batch, remembered in ((1_000_000, 2_000_000, 1000), (3, 40, 4)):
        counter = op11_tokens.Counter(lengths, cut, piece, batch, remembered)
        assert counter.counts(texts + texts).tolist() == [plain(library, t) for t in texts + texts]
        assert all(len(w) <= op11_tokens.REMEMBERED_CHARS for w in counter.memory)


def test_stretches():
    rng = random.Random(3)
    text = "".join(rng.choice(["ab", " ", "\n", "é", "'s", "\u2003"]) for _ in range(5000))
    for most in (1, 7, 100, 10_000):
        parts = list(op11_tokens.stretches(text, most))
        assert "".join(parts) == text and all(len(p) >= most for p in parts[:-1])
    assert list(op11_tokens.stretches("", 5)) == [""] and list(op11_tokens.stretches("x" * 50, 5)) == ["x" * 50]
    groups = list(op11_tokens.by_bytes(((i, t) for i, t in enumerate(["aa", "bbb", "c" * 20, "dd", "ee"])), 5))
    assert [g[0] for g in groups] == [[0, 1], [2], [3, 4]]


@pytest.mark.parametrize("path", [BYTES, WORDS, PIECES])
def test_token_counts(spark, path):
    """Nulls, empty and very long texts, repeated rows, odd characters and clashing columns; whole texts by the library."""
    rng = random.Random(8)
    long = " ".join(rng.choice(["the", "naïve", "x1", "don't", "語", "\n", "  ", "zq" * rng.randrange(1, 9)]) for _ in range(120_000))
    more = [*ODD, long, "no" * 100_000, " " * 50_000 + "x", "a\n" * 30_000]
    docs = documents(spark).select("doc_id", "text", "size", "score").union(spark.createDataFrame([(500 + i, t, 1, 2) for i, t in enumerate(more)], "doc_id long, text string, size int, score long"))
    docs = docs.withColumnRenamed("size", "n_tokens")
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t or ""))
    else:
        own = Tokenizer.from_file(path)
        count = lambda t: plain(own, t)
    got = op11_tokens.token_counts(docs, path)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), n := count(r["text"]), n > 1024) for r in docs.collect())
    assert Counter(tuple(r) for r in got.collect()) == want
    assert op11_tokens.token_counts(docs.where("doc_id = -1"), path).count() == 0


def test_query(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = op11_tokens.op11_tokens(spark, sf).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == Counter((r["doc_id"], len(r["text"].encode()), n := plain(library, r["text"]), n > 1024) for r in docs)


def test_vocabularies(tmp_path):
    """Texts are cut only where the vocabulary's file allows it, and a file of any size isn't sent."""
    base = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "added_tokens": [{"content": "<x>"}]}
    assert op11_tokens.cuts_at_white_space(base)
    odd = [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"added_tokens": [{"content": "<x>", "lstrip": True}]}, {"added_tokens": [{"content": "< x>"}]}, {"truncation": {}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}]
    assert not any(op11_tokens.cuts_at_white_space(base | x) for x in odd)
    big = tmp_path / "big.json"
    with open(big, "wb") as file:
        file.truncate(op11_tokens.MOST_BYTES + 1)
    with pytest.raises(ValueError):
        op11_tokens.vocabulary_bytes(str(big))


def test_batches():
    """Rows of one Arrow batch are cut by bytes, not by their number."""
    with open(BYTES, "rb") as file:
        blob = file.read()
    run = op11_tokens._counted("json", type("Shared", (), {"value": blob})())
    texts = ["word " * 200_000, None, "", "x y"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(12), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    got = [r for b in run(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert [r["n_tokens"] for r in got][:4] == [200_001, 0, 0, 2] and len(got) == 12
