"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's features are hashed character n-grams of the bounded word, so a misspelling that was
never seen shares most of its vectors with the word. A window of WINDOW words on end is the
average of its words' n-gram vectors, and a linear softmax over that average gives the odds of
toxic; vectors and softmax are trained together by gradient descent in numpy. Only documents
are labelled, so training alternates: the windows of clean documents are clean; of a toxic
document only windows that the model of the pass before finds likely are toxic. A document's
score is a logistic function, fitted on the training documents, of its likeliest window (the
area hyperbolic sine of its log odds), so a
few words in a long text count as much as in a short one.

Because the softmax is linear, a trained n-gram is one number at scoring time, and windows are
differences of running sums.

Training takes at most SAMPLE labelled documents, those with the least md5 of their id, in one
executor's task, which keeps four bytes for each of their words and each distinct word's n-grams.
Training and scoring take whole texts. Inputs of a score are the text alone.

Defined results: a null or empty text has no window and gets the score of a window with no
evidence; a null doc_id is held in (its crc32 is null) and never trained on; labels whose
toxic is null don't count, of repeated labels the larger does; without any usable label every
score is the prior 0.5. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.scratch import folded, session_for, unfolded
from lexgrove.llm.textcols import U, mix, slices, text_bytes, word_spans

BUCKETS = 1 << 18
WIDTH = 8
GRAMS = (3, 4, 5, 6)
WINDOW = 6
SAMPLE = 3000
#: Bytes of texts, about, whose n-grams are found at once.
RUN = 1 << 19
PASSES = 4
LEAST_DOCS = 4
DECAY = 1e-4
#: Clean windows of a pass (hard ones and random ones each), and its least steps of 256 windows.
CLEAN = 20_000
STEPS = 150
THRESHOLD = 0.7

_rng = np.random.default_rng(77)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = _rng.integers(1, 2**63, max(GRAMS), dtype=np.uint64) | U(1)
#: Marks around and between words that aren't part of them.
_TRIM = np.zeros(256, bool)
_TRIM[[ord(c) for c in ".,;:!?\"'()[]{}<>|-*_"]] = True


def word_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each n-gram, the number of n-grams of each word, and of words before each row.

    Words are lower-cased (A-Z), freed of marks at both ends and bounded by spaces. A word of
    marks only is left out.
    """
    starts, ends = word_spans(data, offsets)
    if len(starts):
        soft = _TRIM[data]
        hard = np.flatnonzero(~soft)
        first = np.searchsorted(hard, starts)
        last = np.searchsorted(hard, ends) - 1
        full = first <= last
        rows = np.searchsorted(starts[full], offsets)
        starts, ends = hard[first[full]], hard[last[full]] + 1
    else:
        rows = np.zeros(len(offsets), np.int64)
    size = ends - starts + 2
    at = np.concatenate(([0], np.cumsum(size)))
    # words on end, each between two bounds
    text = np.full(int(at[-1]), 32, np.uint8)
    inner = np.ones(len(text), bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    taken = np.zeros(len(data) + 1, np.int8)
    np.add.at(taken, starts, 1)
    np.add.at(taken, ends, -1)
    text[inner] = _LOWER[data[np.cumsum(taken[:-1]) > 0]]
    code = _BYTE[text]
    word = np.repeat(np.arange(len(size)), size)
    left = np.repeat(at[1:], size) - np.arange(len(text))  # bytes to the word's end
    found, owner = [], []
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(text), np.uint64)
        for n in range(1, min(max(GRAMS), len(text)) + 1):
            rolled[: len(text) - n + 1] += code[n - 1 :] * _STEP[n - 1]
            if n in GRAMS:
                ok = np.flatnonzero(left >= n)
                found.append((mix(rolled[ok] + U(n)) & U(BUCKETS - 1)).astype(np.int32))
                owner.append(word[ok])
    owner = np.concatenate([np.zeros(0, np.int64), *owner])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([np.zeros(0, np.int32), *found])[order], np.bincount(owner, minlength=len(size)), rows


@dataclass
class Model:
    weight: np.ndarray  # of each n-gram: its part of the log odds
    bias: float
    slope: float
    shift: float

    def windows(self, grams: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Each row's likeliest window, as log odds; the bias for a row without words."""
        ends = np.cumsum(counts)
        total = np.concatenate(([0.0], np.cumsum(self.weight[grams], dtype=np.float64)))
        sums = np.concatenate(([0.0], total[ends]))
        many = np.concatenate(([0], ends))
        out = np.full(len(rows) - 1, self.bias)
        begin = np.arange(len(counts))
        end = np.minimum(begin + WINDOW, np.repeat(rows[1:], np.diff(rows)))
        # the last full window stands for the shorter ones at a row's end
        begin = np.maximum(np.minimum(begin, end - WINDOW), np.repeat(rows[:-1], np.diff(rows)))
        odds = (sums[end] - sums[begin]) / np.maximum(many[end] - many[begin], 1) + self.bias
        some = np.flatnonzero(np.diff(rows))
        if len(some):
            out[some] = np.maximum.reduceat(odds, rows[some])
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        best = self.windows(*word_grams(*text_bytes(column)))
        return 1 / (1 + np.exp(-np.clip(self.slope * np.arcsinh(best) + self.shift, -50, 50)))


class Sample:
    """Training texts as word numbers: four bytes a word, and each distinct word's n-grams once.

    Texts are added a column at a time and not kept.
    """

    def __init__(self) -> None:
        self._known: dict[int, int] = {}
        self._grams: list[np.ndarray] = []
        self._counts: list[np.ndarray] = []
        self._words: list[np.ndarray] = []
        self._sizes: list[np.ndarray] = []

    def add(self, column: pa.Array) -> None:
        batch = pa.record_batch([column.cast(pa.large_string())], ["text"])
        for part in slices(batch, "text", RUN):
            grams, counts, rows = word_grams(*text_bytes(part.column("text")))
            self._sizes.append(np.diff(rows))
            if not len(counts):
                continue
            starts = np.cumsum(counts) - counts
            place = np.arange(len(grams)) - np.repeat(starts, counts)
            with np.errstate(over="ignore"):
                key = np.add.reduceat(mix(grams.astype(np.uint64) + place.astype(np.uint64) * U(0x9E3779B97F4A7C15)), starts)
            distinct, first, place = np.unique(key, return_index=True, return_inverse=True)
            before = len(self._known)
            number = np.array([self._known.setdefault(k, len(self._known)) for k in distinct.tolist()], np.int32)
            new = first[number >= before]
            self._counts.append(counts[new].astype(np.int32))
            self._grams.append(grams[_ranges(starts[new], counts[new])])
            self._words.append(number[place])

    def finish(self) -> None:
        """Join the parts: words of all texts on end, and where each text's begin."""
        self.grams = np.concatenate([np.zeros(0, np.int32), *self._grams])
        self.counts = np.concatenate([np.zeros(0, np.int32), *self._counts])
        self.starts = np.cumsum(self.counts, dtype=np.int64) - self.counts
        self.words = np.concatenate([np.zeros(0, np.int32), *self._words])
        self.rows = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *self._sizes]))))
        self._known, self._grams, self._counts, self._words, self._sizes = {}, [], [], [], []

    def common(self) -> np.ndarray:
        """Whether an n-gram has LEAST_DOCS texts; one of fewer says more about those than about the class."""
        texts = np.zeros(BUCKETS, np.int32)
        for a, b in zip(self.rows[:-1].tolist(), self.rows[1:].tolist(), strict=True):
            own = np.unique(self.words[a:b])
            texts[np.unique(self.grams[_ranges(self.starts[own], self.counts[own])])] += 1
        return texts >= LEAST_DOCS

    def bag(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of windows of words, on end, and the number of each window's."""
        words = self.words[_ranges(low, high - low)]
        counts = self.counts[words]
        ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))[np.cumsum(high - low)]
        return self.grams[_ranges(self.starts[words], counts)], np.diff(ends, prepend=0)

    def totals(self, model: Model) -> np.ndarray:
        """Each distinct word's sum of weights."""
        return np.add.reduceat(model.weight[self.grams].astype(np.float64), self.starts) if len(self.starts) else np.zeros(0)

    def odds(self, model: Model, total: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Log odds of windows of words, in order of low; total: as totals gives it."""
        out = np.empty(len(low))
        for a in range(0, len(low), 50_000):
            first, last = low[a : a + 50_000], high[a : a + 50_000]
            base = int(first.min())
            words = self.words[base : int(last.max())]
            sums, many = (np.concatenate(([0], np.cumsum(x[words]))) for x in (total, self.counts))
            out[a : a + 50_000] = (sums[last - base] - sums[first - base]) / (many[last - base] - many[first - base]) + model.bias
        return out

    def best(self, model: Model) -> np.ndarray:
        """Each text's likeliest window, at any word, as log odds; the bias for one without words."""
        out, total = np.full(len(self.rows) - 1, model.bias), self.totals(model)
        for i, (a, b) in enumerate(zip(self.rows[:-1].tolist(), self.rows[1:].tolist(), strict=True)):
            if b > a:
                low = np.arange(a, max(a, b - WINDOW) + 1)
                out[i] = self.odds(model, total, low, np.minimum(low + WINDOW, b)).max()
        return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, on end."""
    sizes = sizes.astype(np.int64)
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def train(sample: Sample, labels: np.ndarray, passes: int = PASSES, seed: int = 5) -> Model:
    """Fit vectors and softmax; see the module's text."""
    rng = np.random.default_rng(seed)
    sample.finish()
    rows, common = sample.rows, sample.common()
    windows = -(-np.diff(rows) // WINDOW)
    doc = np.repeat(np.arange(len(labels), dtype=np.int32), windows)
    low = np.repeat(rows[:-1] - WINDOW * (np.cumsum(windows) - windows), windows) + WINDOW * np.arange(int(windows.sum()))
    high = np.minimum(low + WINDOW, rows[doc + 1])
    low = np.maximum(high - WINDOW, rows[doc])
    toxic = labels[doc] > 0
    vectors = (rng.random((BUCKETS, WIDTH), np.float32) - 0.5) / WIDTH
    softmax = np.zeros(WIDTH, np.float32)
    bias = 0.0
    model = Model(np.zeros(BUCKETS), 0.0, 1.0, 0.0)
    for turn in range(passes):
        target = toxic.astype(np.float32)
        if turn:
            odds = sample.odds(model, sample.totals(model), low, high)
            # of a toxic document: windows above even odds, and the likeliest in any case
            best = np.full(len(labels), -np.inf)
            np.maximum.at(best, doc, odds)
            target = (toxic & ((odds > 0) | (odds >= best[doc]))).astype(np.float32)
            clean = np.flatnonzero(~toxic)
            if len(clean) > 2 * CLEAN:  # the likeliest clean windows, and as many others
                hard = np.argpartition(-odds[clean], CLEAN)[:CLEAN]
                clean = clean[np.union1d(hard, rng.choice(len(clean), CLEAN, replace=False))]
            pick = np.concatenate((clean, np.flatnonzero(target > 0)))
        else:
            pick = np.arange(len(target))
            if len(pick) > 4 * CLEAN:
                pick = rng.choice(pick, 4 * CLEAN, replace=False)
        weight = np.where(target > 0, (target[pick] == 0).sum() / max(1.0, (target[pick] > 0).sum()), 1.0) ** 0.5
        rate = 2.0 / (1 + turn)
        rounds = max(1, round(STEPS * 256 / max(1, len(pick))))  # small samples are gone over again
        for part in (x for _ in range(rounds) for x in np.array_split(rng.permutation(pick), max(1, len(pick) // 256))):
            if not len(part):
                continue
            bag, n = sample.bag(low[part], high[part])
            mean = np.add.reduceat(vectors[bag], np.cumsum(n) - n, axis=0) / n[:, None]
            found = 1 / (1 + np.exp(-np.clip(mean @ softmax + bias, -30, 30)))
            slip = (found - target[part]) * weight[part]
            push = np.bincount(bag, np.repeat(slip / n, n), BUCKETS)
            hit = np.flatnonzero(push)
            step = (rate * push[hit, None] * softmax).astype(np.float32)
            softmax -= rate * (slip @ mean) / len(part) * 4
            bias -= rate * float(slip.mean())
            vectors[hit] -= step + DECAY * vectors[hit]
        model = Model(np.where(common, vectors @ softmax, 0.0), bias, 1.0, 0.0)
    model.slope, model.shift = _logistic(np.arcsinh(sample.best(model)), labels)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of y by x, by Newton's method with a slight prior."""
    scale, middle = max(float(np.std(x)), 1e-6), float(np.mean(x))
    z = np.column_stack(((x - middle) / scale, np.ones(len(x))))
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(2) * 1e-2, z.T @ (y - p) - 1e-2 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1] - beta[0] * middle / scale)


def sample_of(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) to train on: rows whose crc32(doc_id) mod 3 is not 1."""
    kind = F.crc32(F.col("doc_id").cast("string")) % 3
    known = labels.where(F.col("toxic").isNotNull() & (kind != 1)).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    known = known.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(most).withColumnRenamed("doc_id", "_id")
    texts = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    return texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("_toxic").alias("toxic"))


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sample, labels = Sample(), []
    for batch in batches:
        sample.add(batch.column("text"))
        labels += [int((x or 0) > 0) for x in batch.column("toxic").to_pylist()]
    if len(set(labels)) == 2:
        model = train(sample, np.array(labels, np.int64))
        columns = [model.weight.astype(np.float32).tobytes()], [float(model.bias)], [model.slope], [model.shift]
        yield pa.record_batch([pa.array(columns[0], pa.binary()), *(pa.array(c, pa.float64()) for c in columns[1:])], ["weight", "bias", "slope", "shift"])


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Trained in one task over the sample, a bounded number of texts; the driver gets the weights alone."""
    session_for(docs)
    ordered = sample_of(docs, labels, most).repartition(1).sortWithinPartitions("doc_id")
    found = ordered.select("text", "toxic").mapInArrow(_trained, "weight binary, bias double, slope double, shift double").collect()
    if not found:
        return Model(np.zeros(BUCKETS), 0.0, 0.0, 0.0)
    return Model(np.frombuffer(found[0]["weight"], np.float32), found[0]["bias"], found[0]["slope"], found[0]["shift"])


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs, all rows and columns, and the score of each whole text."""
    session_for(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in texts:
            batch = pa.record_batch([pa.array(column, pa.large_string(), from_pandas=True)], ["text"])
            found = [shared.value.score(part.column("text")) for part in slices(batch, "text", RUN)]
            yield pd.Series(np.concatenate([np.zeros(0), *found]))

    return docs.withColumn(name, F.pandas_udf(run, "double")("text"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that score below the threshold."""
    scored = with_score(folded(docs, "doc_id", "text"), fit(docs, labels), "_score").where(F.col("_score") < threshold)
    return unfolded(scored, docs.columns, "doc_id", "text")
