"""Bags of subword vectors averaged into a linear softmax; the models of the quality and toxicity operators.

A word gives its own hashed vector and one for each run of 3 to 5 bytes of it with its borders marked, so words not seen in
training share vectors with those that were. A passage is the average of its vectors; vectors and output layer are trained
together by stochastic gradient descent with one falling step size for all vectors, in units of the usual gradient. Everything is
done on arrays of all bytes of a slice of documents at once, or of a piece of a longer one; bags that are learnt from lie in a file.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spaced, text_slices, word_bytes, word_hashes, word_spans

GRAMS = (3, 4, 5)
#: Bytes of text that are taken apart at once, in training and scoring; what is learnt and found doesn't depend on it.
LEARN_BYTES = 500_000
#: A feature of a bag and its share of it, as they lie in the file.
BAG = np.dtype([("id", np.int32), ("share", np.float32)])
#: Bytes of text of each label that a model learns from at most, whole texts in the order of the sample.
SAMPLE_BYTES = 64_000_000


@dataclass(frozen=True)
class Shape:
    """How texts become features and how they are learnt."""

    words: int  # kind of words
    lower: bool
    passage: int  # words that are averaged together; 0: the whole text
    pairs: bool  # word pairs as well
    once: bool = False  # a word said again at once counts as said once
    least: int = 0  # vectors in an average; fewer are filled up with zeros
    buckets: int = 18  # bits
    width: int = 8
    rounds: int = 3
    steps: int = 2000  # at least so many batches, in more rounds if need be
    rate: float = 0.15
    batch: int = 64
    seed: int = 5


@dataclass(frozen=True)
class Model:
    """The trained layers folded into one number for each hashed feature, and the bias."""

    weight: np.ndarray
    bias: float


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int32)


def features(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """([(word index in rising order, feature)], index of each document's first word) over a slice of documents."""
    starts, ends, first = word_spans(data, offsets, shape.words)
    if not len(starts):
        return [], first
    text, starts, ends = spaced(data, starts, ends, shape.lower)
    codes = np.frombuffer(b" " + text, np.uint8)
    own = word_hashes(codes, starts + 1, ends + 1)
    if shape.once:
        new = np.append(True, own[1:] != own[:-1])
        new[first[:-1][first[:-1] < len(own)]] = True
        text, starts, ends = spaced(codes, starts[new] + 1, ends[new] + 1)
        codes, own, first = np.frombuffer(b" " + text, np.uint8), own[new], np.append(0, np.cumsum(new))[first]
    at = np.arange(len(own))
    out = [(at, _bucket(own, shape.buckets))]
    if shape.pairs and len(own) > 1:
        inside = np.ones(len(own), bool)
        inside[first[:-1][first[:-1] < len(own)]] = False
        pair = own[1:] + np.uint64(3) * own[:-1]
        pair[own[1:] == own[:-1]] = 1  # a word said again, whichever it is
        out.append((at[1:][inside[1:]], _bucket(pair[inside[1:]], shape.buckets)))
    # position p of codes belongs to the word whose border or letters start there
    word_at = np.repeat(at, ends - starts + 1)
    wide, gap = codes.astype(np.uint64), codes == 0x20
    packed, open_ = wide.copy(), np.ones(len(codes), bool)
    for n in range(2, max(GRAMS) + 1):
        packed = packed[:-1] | (wide[n - 1 :] << np.uint64(8 * (n - 1)))
        open_ = open_[:-1] & ~gap[n - 2 : len(gap) - 1] if n > 2 else open_[:-1]
        if n in GRAMS:
            p = np.flatnonzero(open_)
            out.append((word_at[p], _bucket(packed[p] + np.uint64(n), shape.buckets)))
    return out, first


def passages(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every passage (and the end), and the document of each."""
    n = np.diff(first)
    parts = np.minimum(n, 1) if size == 0 else -(-n // size)
    doc = np.repeat(np.arange(len(n)), parts)
    begin = np.concatenate([[0], np.cumsum(parts)])[:-1]
    return np.append(first[:-1][doc] + (np.arange(len(doc)) - begin[doc]) * size, first[-1]), doc


def taken_apart(data: np.ndarray, shape: Shape) -> Iterator[tuple[list[tuple[np.ndarray, np.ndarray]], int]]:
    """([(word index in rising order, feature)], number of words) of each piece of a text that has words, as in the whole text.

    A piece is put behind the last word of the one before, so pairs and words said again are found across cuts.
    """
    carried = data[:0]
    for piece in text_pieces(data, shape.words):
        old = min(1, len(carried))
        piece = np.concatenate([carried, piece]) if old else piece
        whole = np.array([0, len(piece)])
        found, first = features(piece, whole, shape)
        if not found:
            continue
        from_ = [int(np.searchsorted(w, old)) for w, _ in found]
        yield [(w[k:] - old, ids[k:]) for k, (w, ids) in zip(from_, found, strict=True)], int(first[-1]) - old
        starts, ends, _ = word_spans(piece, whole, shape.words)
        carried = piece[starts[-1] : ends[-1]]


def text_pieces(data: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """A text in pieces of about LEARN_BYTES that end before a byte outside words; a longer word is left whole."""
    inside, a = word_bytes(words), 0
    while a < len(data):
        b = min(a + LEARN_BYTES, len(data))
        while b < len(data) and inside[data[b : b + 4096]].all():
            b = min(b + 4096, len(data))
        b += int(np.argmin(inside[data[b : b + 4096]])) if b < len(data) else 0
        yield data[a:b]
        a = b


def bags(text: str | None, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, how often each) of every passage of a text, as scoring would find them. Passages are numbered over the whole text;
    the last of a piece may go on in the next one."""
    done, key, n = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for found, n_words in taken_apart(np.frombuffer((text or "").encode(), np.uint8), shape):
        if not n_words:
            continue
        at = np.concatenate([w for w, _ in found]).astype(np.int64) + done
        new, count = np.unique((at // shape.passage if shape.passage else at * 0) << 32 | np.concatenate([ids for _, ids in found]), return_counts=True)
        key, at = np.unique(np.concatenate([key, new]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, count])).astype(np.int64)
        whole = int(np.searchsorted(key, key[-1] >> 32 << 32))
        yield from _by_passage(key[:whole], n[:whole])
        key, n, done = key[whole:], n[whole:], done + n_words
    yield from _by_passage(key, n)


def _by_passage(key: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    cut = np.flatnonzero(np.diff(key >> 32, prepend=-1)).tolist()
    for a, b in zip(cut, [*cut[1:], len(key)], strict=False):
        yield (key[a:b] & 0xFFFFFFFF).astype(np.int32), n[a:b]


def text_bags(text: str | None, shape: Shape) -> list[tuple[np.ndarray, np.ndarray]]:
    """All bags of a text."""
    return list(bags(text, shape))


def scratch() -> BinaryIO:
    """A file without a name on a disk of Spark's; it goes with the task."""
    own = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=own if os.path.isdir(own) else None)


def stored(texts: list[str], shape: Shape, file: BinaryIO) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bags of all texts one after the other, mapped from the file; where each begins (and the end); and the text of each."""
    size, doc = [0], []
    for i, text in enumerate(texts):
        for ids, n in bags(text, shape):
            bag = np.empty(len(ids), BAG)
            bag["id"], bag["share"] = ids, n / max(n.sum(), shape.least)
            file.write(bag.tobytes())
            size.append(len(ids))
            doc.append(i)
    file.flush()
    begin = np.cumsum(size)
    kept = np.memmap(file, BAG, "r", shape=(int(begin[-1]),)).view(np.ndarray) if doc else np.zeros(0, BAG)
    return kept, begin, np.array(doc, dtype=np.int64)


def calibrated(model: Model, texts: list[str], labels: np.ndarray, shape: Shape) -> Model:
    """The model with its log-odds scaled and shifted to fit texts it wasn't trained on (Platt's method, by Newton steps)."""
    p = np.clip(scores(pa.array(texts, pa.string()), model, shape), 1e-15, 1 - 1e-15)
    x = np.stack([np.log(p / (1 - p)), np.ones(len(p))], 1)
    n = np.bincount(labels, minlength=2)
    want = np.where(labels == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    fit = np.array([1.0, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ fit, -50, 50)))
        bend = (x * (q * (1 - q) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        fit -= np.clip(np.linalg.solve(bend, x.T @ (q - want) + 1e-6 * fit), -2, 2)
    scale, shift = (fit[0], fit[1]) if fit[0] > 0.01 else (1.0, 0.0)
    return Model((model.weight * scale).astype(np.float32), float(model.bias * scale + shift))


def train(texts: list[str], labels: np.ndarray, shape: Shape) -> Model:
    """Fits a model on four fifths of the texts and calibrates it on the rest, if both labels are there in each part.

    A text with label 1 may hold passages that don't show it, so later rounds take those it is seen in.
    """
    aside = np.arange(len(texts)) % 5 == 4
    if len(set(labels[aside])) == 2 and len(set(labels[~aside])) == 2:
        part = [[t for t, x in zip(texts, aside, strict=True) if x == y] for y in (False, True)]
        return calibrated(_descend(part[0], labels[~aside], shape), part[1], labels[aside], shape)
    return _descend(texts, labels, shape)


def _descend(texts: list[str], labels: np.ndarray, shape: Shape) -> Model:
    with scratch() as file:
        return _descended(*stored(texts, shape, file), len(texts), labels, shape)


def _descended(kept: np.ndarray, begins: np.ndarray, doc: np.ndarray, n_texts: int, labels: np.ndarray, shape: Shape) -> Model:
    rng = np.random.default_rng(shape.seed)
    y = labels[doc].astype(np.int64) if len(doc) else np.zeros(0, np.int64)
    vectors = (rng.random((1 << shape.buckets, shape.width), np.float32) - 0.5) / shape.width
    out = np.zeros((shape.width, 2), np.float32)
    out[:, 1] = rng.random(shape.width, np.float32)
    out[:, 0] = -out[:, 1]
    bias = np.zeros(2, np.float32)
    seen_v, done, seen_o, seen_b = 1e-12, 0, np.full_like(out, 1e-6), np.full_like(bias, 1e-6)
    score = np.ones(len(doc), np.float32)
    rounds = max(shape.rounds, -(-shape.steps * shape.batch // max(1, len(doc))))
    for turn in range(rounds):
        use = np.ones(len(doc), bool)
        if turn > rounds // 3 and shape.passage:
            best = np.zeros(n_texts, np.float32)
            np.maximum.at(best, doc, score)
            use = (y == 0) | (score >= np.minimum(0.5, best[doc]))
        order = rng.permutation(np.flatnonzero(use))
        rate = shape.rate * (1 - turn / rounds)
        for a in range(0, len(order), shape.batch):
            pick = order[a : a + shape.batch]
            own = np.concatenate([kept[begins[i] : begins[i + 1]] for i in pick])
            ids, share = np.ascontiguousarray(own["id"]), np.ascontiguousarray(own["share"])
            size = begins[pick + 1] - begins[pick]
            begin = np.cumsum(size) - size
            mean = np.add.reduceat(vectors[ids] * share[:, None], begin)
            z = mean @ out + bias
            z = np.exp(z - z.max(1, keepdims=True))
            p = z / z.sum(1, keepdims=True)
            score[pick] = p[:, 1]
            g = p.copy()
            g[np.arange(len(pick)), y[pick]] -= 1
            back = np.repeat(g @ out.T, size, 0) * share[:, None]
            sort = np.argsort(ids, kind="stable")
            cut = np.flatnonzero(np.diff(ids[sort], prepend=-1))
            step, own = np.add.reduceat(back[sort], cut), ids[sort][cut]
            seen_v += (step * step).mean()
            done += 1
            vectors[own] -= rate * step / np.sqrt(seen_v / done)
            step = mean.T @ g / len(pick)
            seen_o += step * step
            out -= rate * step / np.sqrt(seen_o)
            step = g.mean(0)
            seen_b += step * step
            bias -= rate * step / np.sqrt(seen_b)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def _summed(found: list[tuple[np.ndarray, np.ndarray]], n_words: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the weights of each word's features, and their number."""
    total, count = np.zeros(n_words), np.zeros(n_words)
    for word, ids in found:
        total += np.bincount(word, model.weight[ids], n_words)
        count += np.bincount(word, minlength=n_words)
    return total, count


def scores(column: pa.Array, model: Model, shape: Shape) -> np.ndarray:
    """Probability of label 1 for each text: of its likeliest passage. A text without words has that of the bias alone."""
    out = np.full(len(column), 1 / (1 + np.exp(-model.bias)))
    for a, _, data, offsets in text_slices(column, LEARN_BYTES):
        if len(data) > LEARN_BYTES:  # one text
            parts = [_summed(*part, model) for part in taken_apart(data, shape)] or [(np.zeros(0), np.zeros(0))]
            total, count = (np.concatenate(p) for p in zip(*parts, strict=True))
            first = np.array([0, len(total)])
        else:
            found, first = features(data, offsets, shape)
            total, count = _summed(found, int(first[-1]), model)
        if not len(total):
            continue
        begin, doc = passages(first, shape.passage)
        z = np.add.reduceat(total, begin[:-1]) / np.maximum(np.add.reduceat(count, begin[:-1]), shape.least) + model.bias
        own = np.full(len(offsets) - 1, -np.inf)
        np.maximum.at(own, doc, z)
        full = np.flatnonzero(np.isfinite(own))
        out[a + full] = 1 / (1 + np.exp(-np.clip(own[full], -700, 700)))
    return out


# --- on Spark --------------------------------------------------------------------------------------


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: dict[int, int], most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(text, label): at most most[y] labelled rows of each label y, the first by a hash of doc_id, in an order by another hash; of
    each label, those that together hold at most most_bytes bytes of text, counted from the first, texts of over an eighth of it aside.

    Empty texts are not learnt from, nor is a doc_id that has both labels. Of repeated rows one is taken; a text that is learnt from
    counts whole. The chosen ids have a fixed bound, so they are broadcast and ordered in one task.
    """
    named = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(learn)
    named = named.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    usable = docs.where(F.octet_length("text") > 0).groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size")).where(F.col("size") <= most_bytes // 8)
    named = named.join(usable, "doc_id")
    upto = Window.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    first = [named.where(F.col("label") == y).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(n) for y, n in sorted(most.items())]
    first = [f.withColumn("upto", F.sum("size").over(upto)).where(F.col("upto") <= most_bytes).select("doc_id", "label") for f in first]
    chosen = docs.select("doc_id", "text").where(F.octet_length("text") > 0).join(F.broadcast(first[0].union(first[1])), "doc_id")
    chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return chosen.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sum(most.values())).select("text", "label")


def _fit(shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
        model = train(texts, np.array(labels, dtype=np.int64), shape)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()]), pa.array([model.bias])], ["weight", "bias"])

    return run


def fit(rows: DataFrame, shape: Shape) -> Model:
    """Trains on a bounded sample in one task; the folded model, of fixed size, comes to the driver."""
    got = rows.coalesce(1).mapInArrow(_fit(shape), "weight binary, bias double").first()
    return Model(np.frombuffer(got["weight"], np.float32), got["bias"]) if got else Model(np.zeros(1 << shape.buckets, np.float32), 0.0)


def _sent(docs: DataFrame, model: Model):
    """The model's numbers, of fixed size, for the tasks: plain values, as workers needn't have this package."""
    return docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))


def _score(shared, shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), model, shape))], ["doc_id", "score"])

    return run


def scored(docs: DataFrame, model: Model, shape: Shape) -> DataFrame:
    """(doc_id, score) for every row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(_sent(docs, model), shape), "doc_id long, score double")


def _pass(shared, shape: Shape, at: int, below: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), model, shape) < below))

    return run


def below(docs: DataFrame, model: Model, shape: Shape, threshold: float) -> DataFrame:
    """The rows of docs that score below the threshold; the columns stay."""
    return docs.mapInArrow(_pass(_sent(docs, model), shape, docs.columns.index("text"), threshold), docs.schema)
