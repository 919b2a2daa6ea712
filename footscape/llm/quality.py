"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy."""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footscape.llm.bpe import batches
from footscape.llm.common import fold_of, forget, stored

#: At most so many labelled rows are used for training: a bound, whatever the size of the corpus.
SAMPLE = 4000
BUCKETS, DIM, EPOCHS, RATE, SEED = 1 << 17, 16, 6, 0.5, 7
#: Lengths in bytes of the character n-grams, with < and > around each word.
NGRAMS = (3, 4, 5)
#: A word that repeats the one before counts as so many features of its own kind.
REPEAT_WEIGHT, REPEAT_BUCKET = 8, 0
THRESHOLD = 0.3
#: The log odds of every text where labels don't show both classes: nothing is rejected.
UNKNOWN = 0.0
CACHE_WORDS = 1 << 18
#: Documents whose features are held in one block, and characters of texts scored at once.
BLOCK, SCORED_CHARS = 200, 1 << 20


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, and the position of the word that each belongs to.

    A word has itself, its shape, and its n-grams of bytes; an n-gram's hash is a rolling one, computed
    for all words at once.
    """
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    n = len(raw)
    size = np.fromiter(map(len, raw), np.int64, n)
    own = np.fromiter(map(zlib.crc32, raw), np.uint64, n) % np.uint64(BUCKETS - 1) + np.uint64(1)
    shape = np.fromiter((w.isupper() + 2 * w.islower() + 4 * w.isalpha() + 8 * (not w[-1:].isalnum()) + 16 * (len(w) > 24) + 32 for w in words), np.uint64, n)
    text = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(n), size)
    room = np.repeat(np.cumsum(size), size) - np.arange(len(text))  # bytes from here to the word's end
    found, owner = [own, shape], [np.arange(n), np.arange(n)]
    mix = np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(len(text), np.uint64)
    for k in range(max(NGRAMS)):
        h[:len(text) - k or None] = (h[:len(text) - k or None] ^ (text[k:] + np.uint64(1))) * mix
        if k + 1 in NGRAMS:
            at = np.flatnonzero(room >= k + 1)
            found.append((h[at] >> np.uint64(24)) % np.uint64(BUCKETS - 1) + np.uint64(1))
            owner.append(word[at])
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their counts."""
    words = text.split()
    counts = Counter(words)
    if not counts:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    f, owner = word_features(list(counts))
    times = np.fromiter(counts.values(), np.float64, len(counts))[owner]
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    total = np.bincount(f, times, BUCKETS)
    total[REPEAT_BUCKET] = repeats * REPEAT_WEIGHT
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.float32)


@dataclass
class Model:
    """A document's score is sigmoid(bias + the mean of `weight` over its features): the product of each
    feature's embedding with the difference of the two output rows, taken once after training."""

    weight: np.ndarray
    bias: float

    def scorer(self) -> Scorer:
        return Scorer(self)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, dim: int = DIM, rate: float = RATE, seed: int = SEED) -> Model:
    """Embeddings averaged per document, softmax over the two classes. One class alone, or none, gives UNKNOWN."""
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), UNKNOWN)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim))
    out, bias = np.zeros((2, dim)), np.log(np.bincount(y, minlength=2) / len(y))
    # features lie in large blocks, so that their memory goes back to the system after training
    seen, blocks = [], []
    for k in range(0, len(texts), BLOCK):
        part = [document_features(t) for t in texts[k:k + BLOCK]]
        blocks.append((np.concatenate([f for f, _ in part]), np.concatenate([n for _, n in part]).clip(0, 65535).astype(np.uint16)))
        end = np.cumsum([len(f) for f, _ in part])
        seen += [(k // BLOCK, e - len(f), e) for e, (f, _) in zip(end.tolist(), part)]
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for k in rng.permutation(len(y)):
            lr = rate * (1 - done / steps)
            done += 1
            block, start, stop = seen[k]
            at, times = blocks[block][0][start:stop], blocks[block][1][start:stop].astype(np.float64)
            share = times / max(times.sum(), 1)
            rows = emb[at]
            hidden = share @ rows
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = p @ out
            out -= lr * np.outer(p, hidden)
            bias -= 0.1 * lr * p
            # the mean spreads a document's step over thousands of features; scaled by dim, they all move
            emb[at] = rows - lr * dim * share[:, None] * back
    diff = out[1] - out[0]
    return Model((emb @ diff).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Scores texts; the sums of words are kept, in bounded memory, between batches."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.total, self.count = [], []

    def _learn(self, words: list[str]) -> None:
        f, owner = word_features(words)
        total = np.bincount(owner, self.model.weight[f], len(words))
        count = np.bincount(owner, minlength=len(words))
        base = len(self.known)
        self.known.update(zip(words, range(base, base + len(words))))
        self.total.append(total)
        self.count.append(count)

    def score(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known, self.total, self.count = {}, [], []
        cut = [t.split() for t in texts]
        new = list(set().union(*cut).difference(self.known))
        if new:
            self._learn(new)
        total = np.concatenate(self.total) if self.total else np.empty(0)
        count = np.concatenate(self.count) if self.count else np.empty(0)
        self.total, self.count = [total], [count]
        z = np.empty(len(texts))
        w, get = self.model.weight[REPEAT_BUCKET] * REPEAT_WEIGHT, self.known.__getitem__
        for k, words in enumerate(cut):
            ids = np.fromiter(map(get, words), np.int64, len(words))
            same = int((ids[1:] == ids[:-1]).sum())
            z[k] = (total[ids].sum() + w * same) / max(count[ids].sum() + REPEAT_WEIGHT * same, 1) + self.model.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def one_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, _label, text) of the documents `ids` (doc_id, _label), a bounded list. Of rows that repeat an id, the least text is
    taken, by an aggregate that each task begins, so that the number of rows is bounded by that of ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "_label").agg(F.min("text").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, folds: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(doc_id, _label, text) of labelled documents in these folds, at most `limit`, one row a document: of each class those whose
    ids hash lowest, in the classes' proportion, but at least `limit` / 20 of a class that has so many.

    The ids are chosen from the labels of documents that are there, and only their texts are fetched. Null labels and rows
    without an id are passed over; of several labels of a document the largest counts.
    """
    one = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & fold_of(F.col("doc_id")).isin(*folds))
           .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("_label")))
    there = stored(one.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"))
    size = {r["_label"]: r["count"] for r in there.groupBy("_label").count().collect()}
    total = sum(size.values())
    parts = []
    for k in sorted(size):
        most = max(limit * size[k] // max(total, 1), min(limit // 20, size[k]))
        parts.append(there.filter(F.col("_label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(min(most, limit - limit // 20 * (len(size) - 1))))
    return one_text(docs, functools.reduce(DataFrame.unionByName, parts) if parts else there.limit(0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Train on at most `sample` labelled rows outside the held-out fold, in one task; only the weights come to the driver.

    Where the labels show one class only, or none, nothing is known of the other: every score is that of UNKNOWN, above
    the threshold, so that no document is rejected.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        rows = pd.concat([*frames, pd.DataFrame({"doc_id": [], "_label": [], "text": []})]).sort_values("doc_id")
        model = train(rows["text"].tolist(), rows["_label"].astype(int).tolist())
        yield pd.DataFrame({"weight": [model.weight.astype("<f4").tobytes()], "bias": [model.bias]})

    got = labelled_sample(docs, labels, label, sample).coalesce(1).mapInPandas(run, "weight binary, bias double").first()
    return Model(np.frombuffer(got["weight"], "<f4"), got["bias"]) if got else train([], [])


def score_column(model, text: Column) -> Column:
    """The score of each text (null: empty). `model.scorer()` makes the object whose `score(texts)` is called."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        scorer = model.scorer()
        for part in parts:
            yield pd.Series([s for group in batches([t or "" for t in part], SCORED_CHARS) for s in scorer.score(group)], dtype="float64")

    return run(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs` (doc_id, text, ...).

    A null text is scored as an empty one; repeated rows repeat, other columns are ignored, and an empty
    table gives no rows.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of(F.col("doc_id")) == 0).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that are predicted good; all columns stay."""
    return docs.filter(score_column(model, F.col("text")) >= threshold)
