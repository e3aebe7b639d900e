"""Toxicity by FTRL-proximal logistic regression over hashed words, n-grams and skip-grams.

A text's features are which columns its words, pairs, triples and pairs with one or two words
between them are hashed to. Weights are learned by FTRL-proximal (McMahan et al., 2013): each
coordinate has a learning rate of its own, and the L1 term leaves a coordinate at exactly
0 until the evidence for it outweighs ``L1``, so that what is broadcast is a short list of
columns and weights.

Fitting uses a bounded sample of labelled documents, kept in the shared folder. In each
round the shards of the sample are learned from side by side, starting from the same
state; the mean of what they end with starts the next round (iterative parameter
mixing). A lost task is learned again from the same state. The state has at most ``2 ** BITS``
coordinates whatever the data, and scores take one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintara.llm.common import saved, text_of

#: Labelled documents used for fitting, at most; those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
#: Columns are numbers of so many bits.
BITS = 20
#: Parts of the sample that are learned from side by side, and rounds over the sample.
SHARDS, ROUNDS = 4, 4
#: Learning rate, its smoothing, and the penalty that leaves weights at 0.
ALPHA, BETA, L1 = 3.0, 1.0, 2.0
#: Score at and above which a document is called toxic.
TOXIC = 0.5

#: Runs of ASCII letters and of bytes of all other characters.
_WORD = re.compile(rb"[a-z\x80-\xff]+")
#: How far the words of each feature lie behind its first one, the widest last: words, pairs,
#: pairs with a word between, triples, pairs with two words between.
PATTERNS = ((), (1,), (2,), (1, 2), (3,))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashed(text: str) -> np.ndarray:
    """The columns of a whole text's features, with repeats; none for a text without words."""
    words = _WORD.findall(text.lower().encode())
    hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    found = []
    for kind, behind in enumerate(PATTERNS):
        n = len(hashes) - (behind[-1] if behind else 0)
        if n <= 0:
            break
        mixed = hashes[:n] + np.uint64(kind)
        for step in behind:
            mixed = mixed * _MIX + hashes[step : step + n]
        found.append((mixed * _MIX) >> np.uint64(64 - BITS))
    return np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)


def columns_of(text: str) -> np.ndarray:
    """The columns of a whole text, each once, in ascending order."""
    found = np.sort(hashed(text))
    return found[np.append(True, found[1:] != found[:-1])[: len(found)]]


class State:
    """What FTRL-proximal remembers of each coordinate: ``z`` and the sum of squared gradients ``n``.

    The last coordinate is the intercept, which isn't penalised.
    """

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        size = 2**BITS + 1
        self.z = np.zeros(size) if z is None else z
        self.n = np.zeros(size) if n is None else n

    def weights(self, at: np.ndarray) -> np.ndarray:
        """The proximal step's solution at some coordinates: 0 wherever ``|z|`` is at most ``L1``."""
        z = self.z[at]
        free = at == 2**BITS
        over = np.where(free, z, np.sign(z) * np.maximum(np.abs(z) - L1, 0))
        return -over * ALPHA / (BETA + np.sqrt(self.n[at]))

    def learn(self, columns: np.ndarray, label: float) -> float:
        """One example; returns the probability given to label 1 before it."""
        at = np.append(columns, 2**BITS)
        w = self.weights(at)
        p = float(_sigmoid(w.sum()))
        g = p - label
        n = self.n[at]
        self.n[at] = grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        return p


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass(frozen=True)
class Model:
    """The columns whose weight isn't 0, their weights, and the intercept."""

    columns: np.ndarray
    weights: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        table = np.zeros(2**BITS)
        table[self.columns] = self.weights
        return table


def model_of(state: State) -> Model:
    at = np.arange(2**BITS + 1)
    weights = state.weights(at)
    kept = np.flatnonzero(weights[:-1])
    return Model(kept.astype(np.int32), weights[kept], float(weights[-1]))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label may only be used to measure. A null id has no label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``shard, turn, toxic, text`` of at most ``sample_rows`` labels that aren't held out.

    Labels other than 0 and 1 and null ids are left out; of several labels for one id
    the largest counts, and of several documents with it the one of the smallest text hash.
    """
    sample = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample_rows)
    )
    rows = docs.select(docs[doc_id].cast("long").alias("_id"), text_of(docs, text).alias("text"))
    labelled = rows.join(F.broadcast(sample), "_id").withColumn("_hash", F.xxhash64("text"))
    # One row a label, whatever the copies: they are chosen by hashes before texts are shuffled.
    chosen = labelled.groupBy("_id").agg(F.min("_hash").alias("_hash"))
    texts = labelled.join(F.broadcast(chosen), ["_id", "_hash"]).groupBy("_id", "toxic").agg(F.first("text").alias("text"))
    return texts.select(F.pmod(F.xxhash64("_id"), F.lit(SHARDS)).alias("shard"), F.xxhash64("_id", F.lit(1)).alias("turn"), "toxic", "text")


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on :func:`labelled_sample`.

    Null texts are empty. Without labelled documents all weights are 0 and every
    score is 0.5; the fit depends on the documents' ids, texts and labels alone, not on their order.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = pa.array([columns_of(t.as_py()) for t in batch.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], columns], names=["shard", "turn", "toxic", "columns"])

    # Dealt to shards once: each round reads its shards where they are. A shard is a bounded share of a bounded
    # sample, and is learned from in the order of hashed ids, so that partitions and attempts don't change the result.
    texts = labelled_sample(docs, labels, sample_rows, doc_id, text)
    dealt = texts.repartition(SHARDS, "shard").sortWithinPartitions("shard", "turn")
    sample = saved(dealt.mapInArrow(measured, "shard long, turn long, toxic int, columns array<int>"))
    spark, state = docs.sparkSession, State()
    for _ in range(ROUNDS):
        start = spark.sparkContext.broadcast((state.z, state.n))

        def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z, n = start.value
            shard, own = None, State(z, n)

            def moves() -> pa.RecordBatch:
                moved = np.flatnonzero((own.n != n) | (own.z != z))
                change = ((own.z - z)[moved].astype(np.float32), (own.n - n)[moved].astype(np.float32))
                return pa.RecordBatch.from_arrays([pa.array(moved, pa.int32()), *map(pa.array, change)], names=["column", "z", "n"])

            for batch in batches:
                for of, columns, label in zip(batch.column("shard").to_pylist(), batch.column("columns"), batch.column("toxic").to_pylist()):
                    if of != shard:
                        yield moves()
                        shard, own = of, State(z.copy(), n.copy())
                    own.learn(columns.values.to_numpy(), label)
            yield moves()

        # At most SHARDS rows a column; brought together in an order of their own, so sums don't depend on the tasks.
        found = sample.mapInArrow(learned, "column int, z float, n float").toArrow()
        found = found.sort_by([("column", "ascending"), ("z", "ascending"), ("n", "ascending")])
        at = found["column"].to_numpy()
        state = State(
            state.z + np.bincount(at, found["z"].to_numpy(), 2**BITS + 1) / SHARDS,
            state.n + np.bincount(at, found["n"].to_numpy(), 2**BITS + 1) / SHARDS,
        )
    return model_of(state)


def scorer(docs: DataFrame, model: Model):
    """A column function from texts to scores; the weights are broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, intercept = sent.value.dense(), sent.value.intercept
        for texts in batches:
            columns = (hashed(t.as_py()) for t in texts)
            sums = [table[np.unique(c[table[c] != 0])].sum() for c in columns]
            yield pa.array(_sigmoid(intercept + np.array(sums, float)), pa.float64())

    return score


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row.

    The score is between 0 and 1, for empty texts too (null is empty), and depends on
    the text alone. Null ids are scored and not held out, repeated rows have the same score,
    other columns play no part whatever their names, and an empty table gives no rows.
    """
    return docs.select(
        F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), scorer(docs, model)(text_of(docs, text)).alias("score")
    ).withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def keep_civil(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't call toxic, with all their columns."""
    return docs.where(scorer(docs, model)(text_of(docs, text)) < TOXIC)
