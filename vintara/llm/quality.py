"""Document quality by Bradley-Terry ranking.

From labelled documents pairs are made in which one is preferred to the other. A linear
score is learned by logistic loss on the difference of the pair's features, which is the
Bradley-Terry model with scores that depend on features. Documents are then accepted by
a quantile of the scores: as large a share of the labelled sample is rejected as its
labels reject.

Features are counts that tell how a text is written, and hashed shares of its words and
of its runs of three bytes, which tell what it is written about; the latter weigh less,
so that few labels don't teach them by heart. The model is fitted on a bounded sample of
labelled documents; scores are computed from whole texts in one pass without a shuffle.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.llm.common import text_of

#: Labelled documents used for fitting, at most; those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
#: Preference pairs made of them, at most.
PAIRS = 100_000
#: Columns that words, and runs of three bytes, are hashed to, and how much they count
#: beside the other features.
WORD_COLUMNS = GRAM_COLUMNS = 256
CONTENT_WEIGHT = 0.1
#: Score at and above which a document is accepted.
ACCEPT = 0.7
RIDGE = 1e-4

# Marks counted together, by what they tend to mean in web text.
MARKS = {"shout": b"!", "table": b"|", "noise": b"#$%&*@^~<>{}[]\\=_", "stop": b".?", "pause": b",;:", "bracket": b"()'\"-"}
FEATURES = (
    "log_chars", "log_words", "log_lines", "word_length", "upper", "digits", "spaces", "wide",
    *MARKS, "distinct_words", "repeated_word", "distinct_lines", "short_words", "marked_words", "upper_words",
)


N_FEATURES = len(FEATURES) + WORD_COLUMNS + GRAM_COLUMNS


class _Columns(dict):
    """The column of each word met; starts anew when they are many. Long words aren't remembered."""

    def __missing__(self, word: str) -> int:
        column = zlib.crc32(word.encode()) % WORD_COLUMNS
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = column
        return column


_COLUMNS = _Columns()


def _content(data: bytes, words: list[str]) -> np.ndarray:
    """Roots of the shares of each column of words and of runs of three bytes, ASCII in lower case."""
    found = np.zeros(WORD_COLUMNS + GRAM_COLUMNS)
    if words:
        found[:WORD_COLUMNS] = np.bincount([_COLUMNS[w] for w in words], minlength=WORD_COLUMNS) / len(words)
    if len(data) > 2:
        b = np.frombuffer(data, np.uint8).astype(np.uint16)
        # Products wrap around; only the upper byte of the mixture is used.
        grams = (b[:-2] * np.uint16(40503) + b[1:-1] * np.uint16(25717) + b[2:] * np.uint16(9377)) >> 8
        found[WORD_COLUMNS:] = np.bincount(grams, minlength=GRAM_COLUMNS) / len(grams)
    return np.sqrt(found)


def features(text: str) -> np.ndarray:
    """Features of a whole text; all but the lengths are shares and averages."""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, int(counts.sum()))
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum() + counts[192:].sum()))
    words, lines = text.split(), text.split("\n")
    n_words = max(1, len(words))
    distinct = len(set(words))
    written = [
        math.log1p(len(text)),
        math.log1p(len(words)),
        math.log1p(len(lines)),
        min(30.0, len(text) / n_words),
        counts[65:91].sum() / letters,
        counts[48:58].sum() / n,
        (counts[32] + counts[9:14].sum()) / n,
        counts[128:].sum() / n,
        *(counts[list(marks)].sum() / n for marks in MARKS.values()),
        # Herdan's measure, which length changes little.
        math.log1p(distinct) / math.log1p(n_words) if words else 0.0,
        sum(map(eq, words, words[1:])) / n_words,
        len(set(lines)) / len(lines),
        sum(1 for w in words if len(w) < 4) / n_words,
        sum(1 for w in words if not w[-1].isalnum()) / n_words,
        sum(map(str.isupper, words)) / n_words,
    ]
    lowered = data.lower()
    return np.concatenate([written, _content(lowered, lowered.decode().split())])


def _standard(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    found = np.clip((rows - mean) / scale, -8, 8)
    found[:, len(FEATURES) :] *= CONTENT_WEIGHT
    return found


@dataclass(frozen=True)
class Model:
    """A linear score over standardised features, and the quantile that accepts."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return _standard(rows, self.mean, self.scale) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1, and :data:`ACCEPT` at the threshold."""
        x = self.slope * (self.raw(rows) - self.threshold) + math.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_pairs(rows: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> np.ndarray:
    """Weights of least logistic loss on the feature differences of pairs of ``rows``.

    ``better`` and ``worse`` are row numbers. Newton's method, each step by conjugate
    gradients; products go over the rows, so the differences are never put together.
    """
    n, w = len(better), np.zeros(rows.shape[1])

    def gathered(pair_values: np.ndarray) -> np.ndarray:
        """``sum of value * (better row - worse row)`` over the pairs."""
        share = np.bincount(better, pair_values, len(rows)) - np.bincount(worse, pair_values, len(rows))
        return share @ rows / n

    def loss(at: np.ndarray) -> float:
        score = rows @ at
        return float(np.logaddexp(0, score[worse] - score[better]).mean() + ridge / 2 * at @ at)

    now = loss(w)
    for _ in range(rounds):
        score = rows @ w
        p = 1 / (1 + np.exp(np.clip(score[better] - score[worse], -500, 500)))
        gradient = gathered(p) - ridge * w
        step, left = np.zeros_like(w), gradient.copy()
        way, size = left.copy(), float(left @ left)
        enough = 1e-4 * size
        for _ in range(100):
            if size <= enough:
                break
            moved = rows @ way
            curved = gathered(p * (1 - p) * (moved[better] - moved[worse])) + ridge * way
            length = size / float(way @ curved)
            step += length * way
            left -= length * curved
            size, before = float(left @ left), size
            way = left + size / before * way
        rate = 1.0
        while loss(w + rate * step) > now and rate > 1e-6:
            rate /= 2
        w = w + rate * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, before):
            break
    return w


def fit(rows: np.ndarray, labels: np.ndarray, pairs: int = PAIRS, seed: int = 0) -> Model:
    """A model from feature rows and labels 0 and 1.

    Without both labels there are no preferences: all weights are 0 and every score is
    :data:`ACCEPT`.
    """
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 1.0)
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    scale[scale < 1e-9] = 1.0
    rng, n = np.random.default_rng(seed), min(pairs, 50 * max(len(good), len(bad)))
    weights = fit_pairs(_standard(rows, mean, scale), *(x[rng.integers(0, len(x), n)] for x in (good, bad)))
    model = Model(mean, scale, weights, 0.0, 1.0)
    raw = model.raw(rows)
    threshold = float(np.quantile(raw, (labels == 0).mean()))
    spread = float(np.quantile(raw, 0.9) - np.quantile(raw, 0.1)) or 1.0
    return Model(mean, scale, weights, threshold, 8 / spread)


def _feature_rows(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py()) for t in texts], float).reshape(-1, N_FEATURES)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label may only be used to measure."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on the documents of at most ``sample_rows`` labels that aren't held out.

    Labels other than 0 and 1 and null ids are left out; of several labels for one id
    the largest counts, and of several documents with it the one of the smallest text hash.
    Null texts are empty. Without documents or labels, see :func:`fit`.
    """
    sample = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.max("quality").cast("double").alias("quality"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample_rows)
    )
    rows = docs.select(docs[doc_id].cast("long").alias("_id"), text_of(docs, text).alias("text"))
    labelled = rows.join(F.broadcast(sample), "_id")
    # One row a label, whatever the copies: they are chosen by hashes before texts are read.
    chosen = labelled.groupBy("_id").agg(F.min(F.xxhash64("text")).alias("_hash"))

    def measure(batches):
        for batch in batches:
            table = _feature_rows(batch.column("text"))
            flat = pa.array(table.astype(np.float32).ravel())
            values = pa.ListArray.from_arrays(np.arange(0, table.size + 1, N_FEATURES), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("quality"), values], names=["_id", "quality", "values"]
            )

    texts = (
        labelled.withColumn("_hash", F.xxhash64("text"))
        .join(F.broadcast(chosen), ["_id", "_hash"])
        .groupBy("_id", "quality")
        .agg(F.first("text").alias("text"))
    )
    found = texts.mapInArrow(measure, "_id long, quality double, values array<float>").toArrow()
    found = found.sort_by("_id")  # in an order that doesn't depend on the partitions
    table = [c.flatten().to_numpy(zero_copy_only=False) for c in found["values"].chunks]
    table = np.concatenate([*table, np.empty(0, np.float32)]).reshape(-1, N_FEATURES).astype(np.float64)
    return fit(table, found["quality"].to_numpy())


def scorer(model: Model):
    """A column function from texts to scores."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(_feature_rows(texts)), pa.float64())

    return score


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row.

    The score is between 0 and 1, for empty texts too (null is empty), and depends on
    the text alone. Repeated rows have the same score; an empty table gives no rows.
    """
    return docs.select(
        F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), scorer(model)(text_of(docs, text)).alias("score")
    ).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all their columns.

    A null text is scored as an empty one and stays null; null ids, repeated rows and
    columns of any other name pass as they are; an empty table gives no rows.
    """
    return docs.where(scorer(model)(text_of(docs, text)) >= ACCEPT)
