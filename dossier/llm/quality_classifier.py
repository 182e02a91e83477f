"""Quality by supervised subword embeddings.

Every word and its character n-grams are hashed into BUCKETS learned vectors; a document is their average, a softmax over
the classes its output. A word that repeats the one before it also counts as the hashed word AGAIN, with the weight of a
word's n-grams: runs of one word look alike whatever the word. Vectors and output weights are trained by stochastic gradient
descent in numpy on a sample of at most SAMPLE labelled documents, whose hashed features executors compute.

Hashing works on whole slices of texts at once: their characters become one array of code points, in which a space stands
before and after each word, and rolling products give the hash of the n characters from each position on. Words of any
length and script thus give all their n-grams, and no table of words is kept. The output layer is linear in the vectors, so
scoring looks up each bucket's share of the class margin in place of its vector: the same softmax at a sixteenth of the work.

Defined cases: an empty or null text, or one of white space alone, scores the share of label 1 in the sample; without
labelled rows every text scores 0.5; a document with labels of both values counts as 1; a very long text is hashed in blocks
of BLOCK characters, so it takes about 40 bytes a character; equal texts have equal scores; repeated rows are rows of their own; columns of docs named like a new
one are replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.common import bounded_sample
from dossier.llm.word_table import map_texts

SAMPLE, BUCKET_BITS, DIM = 4_000, 15, 16
BUCKETS = 1 << BUCKET_BITS
GRAMS = (2, 3, 4)
EPOCHS, RATE = 6, 0.5
AGAIN, AGAIN_WEIGHT = 0, 10  # its bucket and how often a repeated word counts
SPACE = 32
BLOCK = 1 << 15  # characters hashed at a time: what stays in a core's cache
#: odd multipliers of the rolling and final products
ROLL, MIX, WORD_ROLL, WORD_MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1), np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=2)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of WORD_ROLL from 0 to 2 ** bits - 1, and of its inverse."""
    each = (int(WORD_ROLL), pow(int(WORD_ROLL), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full((1 << bits) - 1, r, np.uint64)))) for r in each)


class Stream:
    """The words of several texts as code points with a space before and after each word, and where texts and words begin.

    codes: the characters; first: for each text its first position (the space before its first word) and last the end;
    empty texts take no room.
    """

    def __init__(self, texts: list[str]):
        words = [" ".join(t.split()) for t in texts]
        self.codes = np.frombuffer(f" {' '.join(filter(None, words))} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        self.lengths = np.fromiter((len(w) + 1 if w else 0 for w in words), np.int64, len(words))
        self.first = np.concatenate(([0], np.cumsum(self.lengths)))
        self.spaces = np.flatnonzero(self.codes == SPACE) if self.first[-1] else np.zeros(1, np.int64)

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash of each word and the text it is in: a polynomial in the word's characters."""
        starts = self.spaces[:-1] + 1
        up, down = powers(max(len(self.codes) - 1, 1).bit_length())
        hashed = np.add.reduceat(self.codes * up[: len(self.codes)], starts) * down[starts]
        return hashed * WORD_MIX, np.searchsorted(self.first, starts, side="right") - 1

    def grams(self):
        """(position of the block, for each n-gram size the buckets from there on, which of them lie in one word)."""
        end = len(self.codes)
        for at in range(0, end, BLOCK):
            c = self.codes[at : at + BLOCK + max(GRAMS) - 1]
            inside = c != SPACE
            size = min(BLOCK, end - at)
            rolled, whole = c, np.ones(len(c), bool)
            for n in range(2, max(GRAMS) + 1):
                m = len(c) - n + 1
                if m <= 0:
                    break
                rolled = rolled[:m] * ROLL + c[n - 1 :]
                whole = whole[:m] & inside[n - 2 : n - 2 + m] if n > 2 else whole[:m]
                if n in GRAMS:
                    k = min(size, m)
                    yield at, ((rolled[:k] + np.uint32(n)) * MIX) >> np.uint32(32 - BUCKET_BITS), whole[:k]

    def repeated(self, hashed: np.ndarray, text: np.ndarray) -> np.ndarray:
        """How many words of each text repeat the one before."""
        return np.bincount(text[1:][(hashed[1:] == hashed[:-1]) & (text[1:] == text[:-1])], minlength=len(self.lengths))


def word_buckets(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def feature_counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and how often each is a feature of it."""
    out = []
    for t in texts:
        s = Stream([t])
        counts = np.zeros(BUCKETS, np.int64)
        if s.first[-1]:
            hashed, text = s.word_hashes()
            counts += np.bincount(word_buckets(hashed), minlength=BUCKETS)
            for _, buckets, whole in s.grams():
                counts += np.bincount(buckets[whole], minlength=BUCKETS)
            counts[AGAIN] += AGAIN_WEIGHT * int(s.repeated(hashed, text)[0])
        ids = np.flatnonzero(counts)
        out.append((ids.astype(np.int32), counts[ids].astype(np.int32)))
    return out


def feature_sums(texts: list[str], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its features' values, and the number of its features; values: one per bucket."""
    s = Stream(texts)
    n, total = np.zeros(len(texts)), np.zeros(len(texts))
    if not s.first[-1]:
        return total, n
    hashed, text = s.word_hashes()
    words = np.bincount(text, minlength=len(texts))
    again = s.repeated(hashed, text) * AGAIN_WEIGHT
    total += np.bincount(text, weights=values[word_buckets(hashed)], minlength=len(texts)) + again * values[AGAIN]
    each = np.zeros(len(s.codes))
    for at, buckets, whole in s.grams():
        each[at : at + len(buckets)] += values[buckets] * whole
    full = np.flatnonzero(s.lengths)
    total[full] += np.add.reduceat(each, s.first[full])
    # a word of k characters with its two spaces has k + 1, k and k - 1 n-grams
    characters = s.lengths - words
    return total, sum(characters + words * (3 - g) for g in GRAMS) + words + again


@dataclass
class Model:
    vectors: np.ndarray  # (BUCKETS, DIM)
    weights: np.ndarray  # (DIM, 2)
    bias: np.ndarray
    prior: float


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 0) -> Model:
    """examples: distinct features, their counts, label. One step per document, the rate falling to 0."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights, labels = np.zeros((DIM, 2), np.float32), np.array([y for *_, y in examples])
    prior = float(labels.mean()) if len(labels) else 0.5
    bias = np.log(np.clip([1 - prior, prior], 1e-3, 1)).astype(np.float32)
    total, step = EPOCHS * max(len(examples), 1), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            ids, counts, y = examples[i]
            rate, step = RATE * (1 - step / total), step + 1
            if not len(ids):
                continue
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ vectors[ids]
            error = softmax(mean @ weights + bias)
            error[y] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
            vectors[ids] -= (rate * np.sqrt(len(ids))) * share[:, None] * back
    return Model(vectors, weights, bias, prior)


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of the labelled rows of docs, from a bounded sample of them."""
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    taken = bounded_sample(known, sample, F.col(id_col))
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(taken, id_col)

    def work():
        def do(part: list[str]) -> list[pa.Array]:
            ids, counts = zip(*feature_counts(part), strict=True)
            return [pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]

        return do

    made = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "counts")]
    rows = map_texts(texts, "text", made, work).select(id_col, "label", "ids", "counts").toArrow().sort_by(id_col)
    each = zip(rows["ids"], rows["counts"], rows["label"].to_pylist(), strict=True)
    return train([(i.values.to_numpy(), n.values.to_numpy(), y) for i, n, y in each])


def margins(m: Model) -> np.ndarray:
    """What each bucket adds to the margin of label 1 over label 0."""
    return m.vectors.astype(np.float64) @ (m.weights[:, 1] - m.weights[:, 0]).astype(np.float64)


def scores(texts: list[str], m: Model, margin: np.ndarray) -> np.ndarray:
    """The probability of label 1 of each text."""
    total, n = feature_sums(texts, margin)
    z = total / np.maximum(n, 1) + (float(m.bias[1]) - float(m.bias[0]))
    return np.where(n > 0, softmax(np.column_stack((np.zeros(len(z)), z)))[:, 1], m.prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs without text_col, with the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        m: Model = shared.value
        margin = margins(m)
        return lambda texts: [pa.array(scores(texts, m, margin), pa.float64())]

    return map_texts(docs, text_col, [T.StructField(score_col, T.DoubleType())], work)
