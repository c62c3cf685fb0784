"""Token counts of whole texts: batches of equal bytes are encoded in Arrow functions that return lengths only.

A text is cut where no token can reach across: before white space that follows anything else, by the tokenizer's own idea of
white space. The byte-level pattern matches from left to right without looking back and never takes white space after another
character into one match, and no added token holds white space, so what stands between two such places has the same tokens alone as
in the text. Pieces are thus counted one by one: those of a batch that haven't been met lately are encoded together by the library,
once each, and long texts go through in stretches of PIECE characters, so what a task holds depends on neither the length of a text
nor the number of rows. Nothing is shuffled, and no ids leave the function.

The rule holds for byte-level vocabularies without a normalizer whose added tokens don't strip or look at their surroundings; the
vocabulary's file is asked, and texts for any other are encoded whole, in batches of equal bytes. The file is read on the driver and
sent as bytes (of the size of a vocabulary, at most MOST_BYTES), so workers need no folder in common with it.

Nulls: a null text is empty and has 0 bytes and tokens; null doc_ids are returned as they are. Strings of special tokens inside a
text count as the library counts them by default. A text without any white space is one piece, however long. Repeated rows are
counted each. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Characters of one text that are cut at once, and bytes that are encoded at once.
PIECE, BATCH_BYTES = 1_000_000, 2_000_000
#: Pieces whose lengths a task remembers, and the longest of them in characters. Results don't depend on these.
REMEMBERED, REMEMBERED_CHARS = 400_000, 48
#: Bytes of a vocabulary file at most.
MOST_BYTES = 64_000_000
#: The characters of Unicode's White_Space.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_BORDER = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")

Lengths = Callable[[list[str]], list[int]]


def cuts_at_white_space(vocabulary: dict) -> bool:
    """Are tokens of this vocabulary (a tokenizer's JSON) the same on either side of a cut before white space?"""
    split, added = vocabulary.get("pre_tokenizer") or {}, vocabulary.get("added_tokens") or []
    plain = vocabulary.get("normalizer") is None and vocabulary.get("truncation") is None and vocabulary.get("padding") is None
    byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    free = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(f"[{WHITE}]", t["content"]) for t in added)
    return plain and bool(byte_level) and free


def encoder(kind: str, blob: bytes) -> tuple[Lengths, bool]:
    """(texts to numbers of tokens, may texts be cut before white space?) for the bytes of a .json or .model file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if kind == "model":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=blob)
        return (lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]), False
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_buffer(blob)
    vocabulary.no_truncation()
    vocabulary.no_padding()
    return (lambda texts: [len(x) for x in vocabulary.encode_batch_fast(texts, add_special_tokens=False)]), cuts_at_white_space(json.loads(blob))


def stretches(text: str, most: int) -> Iterator[str]:
    """text in stretches that end at the first border from `most` characters on."""
    at = 0
    while len(text) - at > most and (m := _BORDER.search(text, at + most)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def by_bytes(items: Iterator[tuple[int, str]], most: int) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of items (row, text) of about `most` bytes; a larger one is a group of its own."""
    rows: list[int] = []
    texts: list[str] = []
    size = 0
    for row, text in items:
        n = len(text) if text.isascii() else 4 * len(text)
        if texts and size + n > most:
            yield rows, texts
            rows, texts, size = [], [], 0
        rows.append(row)
        texts.append(text)
        size += n
    if texts:
        yield rows, texts


class Counter:
    """Numbers of tokens of texts, with a bounded memory of the pieces met before."""

    def __init__(self, lengths: Lengths, cut: bool, piece: int = PIECE, batch: int = BATCH_BYTES, remembered: int = REMEMBERED) -> None:
        self.lengths, self.cut, self.piece, self.batch, self.remembered = lengths, cut, piece, batch, remembered
        self.memory: dict[str, int] = {}

    def encoded(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for _, own in by_bytes(((0, t) for t in texts), self.batch):
            out += self.lengths(own)
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """Numbers of tokens of the texts, each whole."""
        out = np.zeros(len(texts), np.int64)
        parts = ((i, s) for i, t in enumerate(texts) for s in (stretches(t, self.piece) if self.cut else (t,)))
        for rows, own in by_bytes(parts, self.batch):
            if not self.cut:
                np.add.at(out, rows, self.lengths(own))
                continue
            words = [_WORD.findall(s) for s in own]
            distinct = set().union(*words)
            if len(self.memory) + len(distinct) > self.remembered:
                self.memory = {}
            new = list(distinct.difference(self.memory))
            self.memory |= zip(new, self.encoded(new), strict=True)
            np.add.at(out, rows, [sum(map(self.memory.__getitem__, w)) for w in words])
            for w in [w for w in new if len(w) > REMEMBERED_CHARS]:
                del self.memory[w]
        return out


def _counted(kind: str, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(*encoder(kind, shared.value))
            text = batch.column(1).fill_null("")
            size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
            turn = np.cumsum(size) // BATCH_BYTES
            edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(size)]
            counts = [counter.counts(text.slice(a, b - a).to_pylist()) for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(np.concatenate(counts))], ["doc_id", "n_bytes", "n_tokens"])

    return run


def vocabulary_bytes(path: str) -> bytes:
    size = os.path.getsize(path)
    if size > MOST_BYTES:
        raise ValueError(f"{path} has {size} bytes; a vocabulary has at most {MOST_BYTES}")
    with open(path, "rb") as file:
        return file.read()


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text), by the tokenizer in this .json or .model file."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))
    kind = "model" if path.endswith(".model") else "json"
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_counted(kind, shared), "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))
