"""Quality classifier: averaged vectors of hashed words, word pairs and character n-grams, under a softmax.

A text's features are its words, the pairs of words that follow each other, and the 3 to 5 characters long n-grams of each word set in ``<`` and ``>``. Each
is hashed into a bucket with a vector; a text is the average of the vectors of its features, counted as often as they occur, and a softmax over this average gives its label.
In a pair, a word that is the one before is hashed as "the same", so that all repetitions share one vector: which word repeats is not known beforehand.
Vectors and outputs are learned together by stochastic gradient descent in numpy, on a bounded sample of labelled documents, in one task.

As a text's average meets the outputs linearly, scoring adds up one number a feature. Words that a task has seen keep the sum over their n-grams.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumeset.llm.common import materialise

BUCKETS, DIMS = 1 << 17, 16
GRAMS = (3, 4, 5)
PER_LABEL, LEARN_CHARS = 1000, 20_000  # labelled documents learned from, of each label at most, and their code points at most
EPOCHS, RATE, SPREAD = 5, 0.5, 50.0  # passes; first step; how much larger the vectors' step is, as a text moves each of its many by a small share only
KEEP = 0.3
PIECE = 1 << 20  # bytes of a text that are taken apart at once
WINDOW = 1 << 18  # characters whose n-grams are hashed at once
WORDS = 300_000  # words that a task remembers; then it starts anew
SPACE = re.compile(rb"[\x20\x09-\x0d]")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
WORD, PAIR, SAME = np.uint64(1 << 40), np.uint64(1 << 50), np.uint64(5)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def word_features(words: list[bytes], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of words and buckets of their features (the word and its n-grams), a part at a time."""
    yield np.arange(len(words)), (mixed(word_hashes(words) + WORD) % np.uint64(buckets)).astype(np.int64)
    set_in = ["<" + w.decode("utf-8", "replace") + ">" for w in words]
    ends = np.cumsum([len(w) for w in set_in])
    points = np.frombuffer("".join(set_in).encode("utf-32-le", "surrogatepass"), np.uint32)
    for s in range(0, len(points), WINDOW):
        part = points[s : s + WINDOW + max(GRAMS) - 1].astype(np.uint64)
        own = np.searchsorted(ends, np.arange(s, s + len(part)), side="right")
        for n in GRAMS:
            m = min(WINDOW, len(part) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = h * MULTIPLIER + part[k : k + m] + np.uint64(1)
            inside = own[:m] == own[n - 1 : n - 1 + m]
            yield own[:m][inside], (mixed(h[inside]) % np.uint64(buckets)).astype(np.int64)


def pair_buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the pairs of words that follow each other."""
    a, b = hashes[:-1], hashes[1:]
    return (np.where(a == b, mixed(np.atleast_1d(SAME)), mixed(a * MULTIPLIER + b + PAIR)) % np.uint64(buckets)).astype(np.int64)


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded part at a time; only a word longer than that is taken whole."""
    at = 0
    while at < len(text):
        found = SPACE.search(text, at + PIECE)
        end = found.start() if found else len(text)
        yield text[at:end].split()
        at = end


def features(text: bytes, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text, in order, and how often each occurs."""
    ids, counts, before = [np.zeros(0, np.int64)], [np.zeros(0)], np.zeros(0, np.uint64)
    for words in pieces(text):
        if not words:
            continue
        hashes = np.concatenate([before, word_hashes(words)])
        pairs = pair_buckets(hashes, buckets)
        ids.append(pairs)
        counts.append(np.ones(len(pairs)))
        before = hashes[-1:]
        often: dict[bytes, int] = {}
        for w in words:
            often[w] = often.get(w, 0) + 1
        n = np.fromiter(often.values(), float, len(often))
        for own, bucket in word_features(list(often), buckets):
            ids.append(bucket)
            counts.append(n[own])
    found, place = np.unique(np.concatenate(ids), return_inverse=True)
    return found, np.bincount(place, weights=np.concatenate(counts), minlength=len(found))


@dataclass
class Model:
    """vectors: (buckets, dimensions); output: (2, dimensions) and bias (2), for labels 0 and 1."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def weights(self) -> np.ndarray:
        """What each bucket adds to the log odds of label 1."""
        return self.vectors.astype(float) @ (self.output[1] - self.output[0])


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int = BUCKETS, dims: int = DIMS, epochs: int = EPOCHS, rate: float = RATE, spread: float = SPREAD, seed: int = 1) -> Model:
    """Stochastic gradient descent over texts (buckets and counts) in an order drawn anew for each pass; steps fall to zero, both labels weigh alike."""
    rng = np.random.default_rng(seed)
    m = Model(rng.uniform(-1 / dims, 1 / dims, (buckets, dims)), np.zeros((2, dims)), np.zeros(2))
    weight = len(labels) / 2 / np.maximum(1, np.bincount(labels, minlength=2))
    steps = epochs * len(labels)
    for step, j in enumerate(np.concatenate([rng.permutation(len(labels)) for _ in range(epochs)]) if steps else []):
        ids, counts = texts[j]
        now = rate * (1 - step / steps)
        share = counts / max(1.0, counts.sum())
        mean = share @ m.vectors[ids]
        odds = m.output @ mean + m.bias
        slope = np.exp(odds - odds.max())
        slope /= slope.sum()
        slope[labels[j]] -= 1
        slope *= weight[labels[j]]
        back = slope @ m.output
        m.output -= now * np.outer(slope, mean)
        m.bias -= now * slope
        m.vectors[ids] -= now * spread * share[:, None] * back
    return m


def labelled(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, most_chars: int = LEARN_CHARS) -> DataFrame:
    """doc_id, quality and text (bytes) of what is learned from: up to ``per_label`` documents of each label, those with the smallest hashes of their ids.

    Documents whose id falls into the held-out fifth, labels that are null or neither 0 nor 1, ids with both labels, null and longer texts are left out;
    of several texts of one id the smallest counts.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_other"))
    known = known.where((F.col("quality") == F.col("_other")) & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    usable = docs.where(F.col("text").isNotNull() & (F.char_length("text") <= most_chars))
    ids = known.join(usable.select("doc_id").distinct(), "doc_id", "left_semi")
    drawn = [ids.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for q in (0, 1)]
    drawn = materialise(drawn[0].union(drawn[1]), "drawn")
    return usable.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").cast("binary").alias("text"), F.first("quality").alias("quality"))  # at most 2 * per_label rows


def held_out(doc_id: F.Column) -> F.Column:
    """Whether the CRC-32 of an id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, most_chars: int = LEARN_CHARS, buckets: int = BUCKETS, dims: int = DIMS) -> Model:
    """The model learned from a bounded sample (see ``labelled``); without labels one that scores every text 0.5."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            each = [features(bytes(t), buckets) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "ids": [i.astype("<i4").tobytes() for i, _ in each], "counts": [c.astype("<f4").tobytes() for _, c in each]})

    def learned(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("doc_id")
        m = train([(np.frombuffer(i, "<i4"), np.frombuffer(c, "<f4").astype(float)) for i, c in zip(f["ids"], f["counts"], strict=True)], f["quality"].to_numpy(np.int64), buckets, dims)
        return pd.DataFrame({c: [getattr(m, c).astype("<f4").tobytes()] for c in ("vectors", "output", "bias")})

    texts = labelled(docs, labels, per_label, most_chars).mapInPandas(counted, "doc_id long, quality int, ids binary, counts binary")
    # one task: at most 2 * per_label texts of most_chars code points
    rows = materialise(texts.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(learned, "vectors binary, output binary, bias binary"), "model").collect()
    if not rows:
        return train([], np.zeros(0, np.int64), buckets, dims)
    at = lambda c: np.frombuffer(rows[0][c], "<f4")
    return Model(at("vectors").reshape(buckets, dims), at("output").reshape(2, dims).astype(float), at("bias").astype(float))


class Scorer:
    """Log odds of texts; remembers for each word met its hash and what it and its n-grams add."""

    def __init__(self, weights: np.ndarray, bias: float, most_words: int = WORDS):
        self.weights, self.bias, self.most_words = weights, bias, most_words
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.hashes, self.sums, self.sizes = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)

    def learn(self, words: list[bytes]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if not new:
            return
        if len(self.place) + len(new) > self.most_words:
            self.forget()
            new = list(dict.fromkeys(words))
        sums, sizes = np.zeros(len(new)), np.zeros(len(new))
        for own, bucket in word_features(new, len(self.weights)):
            sums += np.bincount(own, weights=self.weights[bucket], minlength=len(new))
            sizes += np.bincount(own, minlength=len(new))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.hashes, self.sums, self.sizes = np.concatenate([self.hashes, word_hashes(new)]), np.concatenate([self.sums, sums]), np.concatenate([self.sizes, sizes])

    def log_odds(self, text: bytes) -> float:
        total, size, before = 0.0, 0.0, np.zeros(0, np.uint64)
        for words in pieces(text):
            if not words:
                continue
            self.learn(words)
            at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
            hashes = np.concatenate([before, self.hashes[at]])
            pairs = pair_buckets(hashes, len(self.weights))
            total += float(self.sums[at].sum() + self.weights[pairs].sum())
            size += float(self.sizes[at].sum()) + len(pairs)
            before = hashes[-1:]
        return self.bias + (total / size if size else 0.0)


def score(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted, a row for each row of docs (doc_id, text; other columns are ignored).

    A null or empty text, or one of white space, has no features: its score is that of the bias. Texts are scored whole, of any length. Repeated rows are scored each.
    """
    weights = docs.sparkSession.sparkContext.broadcast((model.weights(), float(model.bias[1] - model.bias[0])))  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*weights.value)
        for b in batches:
            odds = np.array([scorer.log_odds(t.as_py() or b"") for t in b.column("text")])
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-odds))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= keep).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return asked.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op12_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model learned from labels outside the held-out fifth."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
