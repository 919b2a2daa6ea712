"""Toxicity by class-conditional Kneser-Ney models over the characters of words."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footscape.llm.bpe import batches
from footscape.llm.common import fold_of, forget, stored
from footscape.llm.quality import one_text, score_column

#: Characters in an n-gram, and the discount.
ORDER, DISCOUNT = 5, 0.75
#: Backoff counts that each class's contexts get besides the discounted ones: evidence of a few counts stays small.
BACKOFF = 20
#: So many of a text's most toxic words are summed.
TOP = 3
#: Counts come from all labelled rows of the first folds; the scale of the score from at most so many documents of the last.
COUNT_FOLDS, SCALE_FOLDS, SCALE_SAMPLE = (1, 2, 3), (4,), 4000
THRESHOLD = 0.5
#: The log odds of every text where labels don't show both classes: nothing is predicted toxic.
UNKNOWN = -4.0
CACHE_WORDS = 1 << 18
#: Buckets of 2 ** 15 ids whose labels are sent to the texts at once: 64 MB.
BUCKETS_AT_ONCE = 8192
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A probability below the last backoff order: one character of an open alphabet.
FLOOR = 1e-4


def char_grams(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For each character of "word$", read after "^": the word's position, and for k = 1..ORDER the 64-bit digests of the last
    k characters (gram) and of those before the character among them (context). Where a word has fewer, the digest
    is that of all it has, with its start sign."""
    raw = ["^" + w + "$" for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    text = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    start = np.repeat(np.cumsum(size) - size, size)
    here = np.arange(len(text))
    at = np.flatnonzero(here > start)
    grams, contexts = [], []
    for k in range(1, ORDER + 1):
        g, c = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for back in range(k - 1, -1, -1):
            src = at - back
            ok = src >= start[at]
            ch = np.where(ok, text[np.maximum(src, 0)], 0)
            if back:
                c = np.where(ok, (c ^ ch) * _MIX, c)
            g = np.where(ok, (g ^ ch) * _MIX, g)
        grams.append(g)
        contexts.append(c)
    return np.repeat(np.arange(len(raw)), size)[at], grams, contexts


def gram_digests(chars: np.ndarray) -> np.ndarray:
    """The digests that char_grams gives, of n-grams as rows of code points, 0 where there is none."""
    h = np.zeros(len(chars), np.uint64)
    for ch in chars.T.astype(np.uint64):
        h = np.where(ch > 0, (h ^ (ch + np.uint64(1))) * _MIX, h)
    return h


def gram_rows(counted: DataFrame) -> DataFrame:
    """From (toxic, word, n): (gram, ordinary, toxic), one row per distinct n-gram of the longest order, with its counts in both
    classes. N-grams of lower orders are ends of these."""
    raw = F.concat(F.lit("^"), "word", F.lit("$"))
    at = F.sequence(F.lit(2), F.char_length(raw))
    grams = F.transform(at, lambda k: F.substring(raw, F.greatest(F.lit(1), k - (ORDER - 1)), F.least(F.lit(ORDER), k)))
    count = lambda x: F.sum(F.when(F.col("toxic") == x, F.col("n")).otherwise(0))
    return counted.select("toxic", "n", F.explode(grams).alias("gram")).groupBy("gram").agg(count(0).alias("ordinary"), count(1).alias("toxic"))


class Table:
    """Values by 64-bit digest, as many as there are distinct ones; rows of digests that aren't in it are zeros."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.concatenate([values[order], np.zeros((1, values.shape[1]))])
        # the digests are uniform: their first bits tell where to look
        self.shift = np.uint64(64 - max(1, len(keys)).bit_length())
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        head = (keys >> self.shift).astype(np.int64)
        at, end = self.first[head], self.first[head + 1]
        found, left = np.full(len(keys), len(self.keys)), np.flatnonzero(at < end)
        while len(left):
            hit = self.keys[at[left]] == keys[left]
            found[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return self.values[found]


def _by(keys: np.ndarray, values: list[np.ndarray]) -> Table:
    """A table of sums by key."""
    distinct, group = np.unique(keys, return_inverse=True)
    return Table(distinct, np.stack([np.bincount(group, v, len(distinct)) for v in values], 1))


def tables(chars: np.ndarray, counts: np.ndarray) -> Model:
    """The model of distinct n-grams of the longest order, rows of ORDER code points with zeros behind, and their counts
    (ordinary, toxic)."""
    size = (chars > 0).sum(1)

    def ends(k: int) -> tuple[np.ndarray, np.ndarray]:
        """The last k characters, as far as there are, and those without the last."""
        at = np.maximum(size - k, 0)[:, None] + np.arange(k)
        end = np.where(at < size[:, None], np.take_along_axis(chars, np.minimum(at, ORDER - 1), 1), 0)
        return end, np.where(np.arange(k) < np.minimum(size, k)[:, None] - 1, end, 0)

    own = [ends(k) for k in range(1, ORDER + 1)]
    digests = [(gram_digests(g), gram_digests(c)) for g, c in own]
    left, left_context = [], []
    for k in range(ORDER - 1):
        at = np.unique(digests[k + 1][0], return_index=True)[1]  # each longer gram once
        g, c = digests[k][0][at], digests[k][1][at]
        left.append(_by(g, [np.ones(len(g))]))
        first = np.zeros(len(g))
        first[np.unique(g, return_index=True)[1]] = 1
        left_context.append(_by(c, [np.ones(len(c)), first]))
    g, c = digests[-1]
    n = counts.astype(float)
    return Model(_by(g, [n[:, 0], n[:, 1]]), _by(c, [n[:, 0], n[:, 1], n[:, 0] > 0, n[:, 1] > 0]), left, left_context)


@dataclass
class Model:
    """Tables by gram or context. At order ORDER: counts of both classes (`gram`); their sums, and the number of distinct
    grams, by context. Shared, orders below: in how many different ways a gram is extended to the left; by context, the
    sum of that and the number of distinct grams."""

    gram: Table
    context: Table
    left: list
    left_context: list
    scale: np.ndarray = field(default_factory=lambda: np.array([0, 0, 0, 0, UNKNOWN]))

    def scorer(self) -> Scorer:
        return Scorer(self)

    def word_ratios(self, words: list[str]) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary) of each word.

        Interpolated Kneser-Ney: a class's discounted counts at the longest order, and below it the
        backoff counts that both classes share, so that a rare expression counts for neither.
        """
        owner, grams, contexts = char_grams(words)
        p = np.full(len(owner), FLOOR)
        for k in range(ORDER - 1):
            p = _smooth(self.left[k](grams[k])[:, 0], *self.left_context[k](contexts[k]).T, p, 0)
        g, c = self.gram(grams[-1]), self.context(contexts[-1])
        tox, ordinary = (np.log(_smooth(g[:, x], c[:, x], c[:, 2 + x], p, BACKOFF)) for x in (1, 0))
        return np.bincount(owner, tox - ordinary, len(words))


def _smooth(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, below: np.ndarray, more: float) -> np.ndarray:
    """What the discount takes from the seen grams of a context, and `more` counts, go to the order below."""
    lower = DISCOUNT * np.maximum(kinds, 1) + more
    return np.where(total > 0, (np.maximum(n - DISCOUNT, 0) + lower * below) / np.maximum(total + more, 1), below)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known, self.ratios = model, {}, np.empty(0)

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: mean log ratio a word; the highest of a word; the TOP highest together; log(1 + words).

        The mean compares the length-normalised likelihoods of the whole text, the others those of its most toxic
        words, each a passage of one word, which a long text doesn't dilute. All texts are summed at once.
        """
        if len(self.known) > CACHE_WORDS:
            self.known, self.ratios = {}, np.empty(0)
        cut = [_WORD.findall(t.lower()) for t in texts]
        new = list(set().union(*cut).difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.ratios = np.concatenate([self.ratios, self.model.word_ratios(new)])
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        out = np.zeros((len(texts), 4))
        full = np.flatnonzero(size)
        if not len(full):
            return out
        n, get = size[full], self.known.__getitem__
        r = self.ratios[np.concatenate([np.fromiter(map(get, w), np.int64, len(w)) for w in cut if w])]
        start, owner = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        out[full, 0] = np.add.reduceat(r, start) / n
        out[full, 3] = np.log1p(n)
        r = np.maximum(r, 0)
        for k in range(TOP):
            high = np.maximum.reduceat(r, start)
            out[full, 1] = np.maximum(out[full, 1], high)
            out[full, 2] += high
            at = np.flatnonzero(r == high[owner])
            r[at[np.r_[True, owner[at[1:]] != owner[at[:-1]]]]] = 0  # of equal ones, the first goes
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        x = self.features(texts)
        s = self.model.scale
        return 1 / (1 + np.exp(-np.clip(x @ s[:-1] + s[-1], -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression of weighted rows by Newton steps; the features are brought to unit size first."""
    size = np.maximum(np.abs(x).mean(0), 1e-9)
    a = np.column_stack([x / size, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * len(a) * np.diag([1e-2] * x.shape[1] + [1e-4])
        w += np.linalg.solve(hess, a.T @ (weight * (y - p)) - ridge * len(a) * np.diag([1e-2] * x.shape[1] + [1e-4]) @ w)
    return np.append(w[:-1] / size, w[-1])


def label_bits(labels: DataFrame, label: str, folds: tuple[int, ...]) -> DataFrame:
    """(bucket, known, toxic): bitmaps of the labelled ids of these folds, and of the toxic ones among them, a row for each
    2 ** 15 ids in a row. Of several labels of an id the largest counts."""
    one = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & fold_of(F.col("doc_id")).isin(*folds))
    one = one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(label) > 0).alias("toxic"))
    place = F.bitmap_bit_position("doc_id")
    return one.groupBy(F.bitmap_bucket_number("doc_id").alias("bucket")).agg(
        F.bitmap_construct_agg(place).alias("known"), F.bitmap_construct_agg(F.when(F.col("toxic"), place)).alias("bad"))


def _bit(bits: str, place: Column) -> Column:
    """Whether a bit of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, folds: tuple[int, ...], room: int = BUCKETS_AT_ONCE) -> DataFrame:
    """(doc_id, text, toxic) of the labelled documents of these folds. The labels are sent to the texts as bitmaps, `room`
    buckets (8 KB each) at a time; texts are read once for so many, and never shuffled."""
    bits = stored(label_bits(labels, label, folds))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(fold_of(F.col("doc_id")).isin(*folds))
    rows = rows.withColumns({"bucket": F.bitmap_bucket_number("doc_id"), "place": F.bitmap_bit_position("doc_id")})
    passes = max(1, -(-bits.count() // room))
    parts = [bits] if passes == 1 else [bits.filter(F.pmod(F.xxhash64("bucket"), F.lit(passes)) == k) for k in range(passes)]
    found = [rows.join(F.broadcast(p), "bucket").filter(_bit("known", F.col("place"))).select("doc_id", "text", _bit("bad", F.col("place")).cast("int").alias("toxic")) for p in parts]
    return functools.reduce(DataFrame.unionByName, found)


def word_counts(docs: DataFrame, labels: DataFrame, label: str, folds: tuple[int, ...]) -> DataFrame:
    """(toxic, word, n) over all labelled rows of these folds, summed in each task before the shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(counts: dict) -> pd.DataFrame:
            return pd.DataFrame([(x, w, n) for x, c in counts.items() for w, n in c.items()], columns=["toxic", "word", "n"])

        forget()
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for f in frames:
            for x, t in zip(f["toxic"], f["text"]):
                counts[int(x > 0)].update(_WORD.findall(t.lower()))
                if sum(map(len, counts.values())) > CACHE_WORDS:
                    yield frame(counts)
                    counts = {0: Counter(), 1: Counter()}
        yield frame(counts)

    return labelled_texts(docs, labels, label, folds).select("toxic", "text").mapInPandas(run, "toxic int, word string, n long").groupBy("toxic", "word").agg(F.sum("n").alias("n"))


def scale_sample(docs: DataFrame, present: DataFrame, folds: tuple[int, ...], limit: int = SCALE_SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, _label, text) of at most `limit` documents of these folds, as many of one class as of the other where there are
    so many, those whose ids hash lowest; and how many there are of each class. `present` has (doc_id, _label, fold)."""
    own = present.filter(F.col("fold").isin(*folds))
    size = {int(r["_label"]): r["count"] for r in own.groupBy("_label").count().collect()}
    toxic = min(size[1], max(limit // 2, limit - size[0]))
    lowest = lambda x, n: own.filter(F.col("_label") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", "_label")
    return one_text(docs, lowest(1, toxic).unionByName(lowest(0, limit - toxic))), size


def sample_features(rows: DataFrame, model: Model) -> pd.DataFrame:
    """The features of a bounded sample (doc_id, _label, text), made where its texts are; only they come to the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        scorer = model.scorer()
        for f in frames:
            x = [scorer.features(g) for g in batches(f["text"].tolist())]
            yield pd.DataFrame(np.concatenate([*x, np.zeros((0, 4))]), columns=list("abcd")).assign(_label=f["_label"].to_numpy())

    return rows.mapInPandas(run, "a double, b double, c double, d double, _label int").toPandas().sort_values(list("abcd")).reset_index(drop=True)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Counts of all n-grams over all labelled rows of COUNT_FOLDS, summed by Spark; the scale of the score by logistic
    regression on at most SCALE_SAMPLE documents of SCALE_FOLDS. The held-out fold takes no part.

    Where one of these two has documents of one class only, both are made of all folds but the held-out one; where these
    have one class only, or none, every score is that of UNKNOWN, below the threshold.
    """
    folds = (*COUNT_FOLDS, *SCALE_FOLDS)
    one = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & fold_of(F.col("doc_id")).isin(*folds))
           .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("_label")))
    present = stored(one.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id").withColumn("fold", fold_of(F.col("doc_id"))))
    seen = {(r["fold"], r["_label"]) for r in present.select("fold", "_label").distinct().collect()}
    both = lambda fs: {x for f, x in seen if f in fs} == {0, 1}
    if not both(folds):
        return tables(np.zeros((0, ORDER), np.uint32), np.zeros((0, 2)))
    apart = both(COUNT_FOLDS) and both(SCALE_FOLDS)
    chars = F.encode(F.rpad("gram", ORDER, "\0"), "UTF-32").alias("chars")
    got = gram_rows(word_counts(docs, labels, label, COUNT_FOLDS if apart else folds)).select(chars, "ordinary", "toxic").toArrow().combine_chunks()
    points = np.frombuffer(b"".join(c.buffers()[2][4 * ORDER * c.offset:4 * ORDER * (c.offset + len(c))] for c in got.column("chars").chunks), ">u4").reshape(-1, ORDER).astype(np.uint32)
    model = tables(points, np.stack([got.column(c).to_numpy() for c in ("ordinary", "toxic")], 1))
    del got, points
    rows, size = scale_sample(docs, present, SCALE_FOLDS if apart else folds)
    x = sample_features(rows, model)
    y = x["_label"].to_numpy()
    weight = np.array([size[k] / max(int((y == k).sum()), 1) for k in (0, 1)])[y]
    model.scale = _logistic(x[list("abcd")].to_numpy(), y.astype(float), weight / weight.mean())
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs` (doc_id, text, ...).

    A null text is scored as an empty one. Without labelled rows of both classes no text is predicted toxic.
    Repeated rows repeat, other columns are ignored, and an empty table gives no rows.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of(F.col("doc_id")) == 0).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that are not predicted toxic; all columns stay."""
    return docs.filter(score_column(model, F.col("text")) < threshold)
