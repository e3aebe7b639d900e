"""The toxicity classifier: learning, sparsity, held-out accuracy, edges."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintara.llm import queries, toxicity

INSULTS = ("grobble", "fnordish")


def made(n, seed=1):
    """Labelled texts: every fifth has an insult among common words."""
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("ta", "lo", "mi", "ze") for b in "bcdfgkl"]
    rows = []
    for i in range(n):
        text = list(rng.choice(words, 60))
        if i % 5 == 0:
            text[int(rng.integers(60))] = INSULTS[i % 2].upper() if i % 3 else INSULTS[i % 2]
        rows.append((i, " ".join(text), int(i % 5 == 0)))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    rows = made(1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return rows, docs, labels, toxicity.learn(docs, labels)


def test_each_feature_is_there_once():
    columns = toxicity.columns_of("One two. ONE two Été one two")
    assert list(columns) == sorted(set(columns.tolist()))
    single = toxicity.columns_of("word")
    assert len(single) == 1 and set(single) <= set(toxicity.columns_of("another WORD here"))
    # A pair of neighbours and a pair with a word between are different features.
    assert len(toxicity.columns_of("a b c d")) == 4 + 3 + 2 + 2 + 1
    assert len(toxicity.columns_of("")) == len(toxicity.columns_of("1 2 ?!")) == 0


def test_ftrl_step_by_step():
    """The state after a few examples, against the algorithm written out for one coordinate at a time."""
    examples = [(np.array([1, 5]), 1), (np.array([5, 9]), 0), (np.array([1]), 1), (np.array([1, 9]), 1)] * 3
    state, z, n = toxicity.State(), {}, {}
    for columns, label in examples:
        state.learn(columns, label)
        at, w = [*columns.tolist(), 2**toxicity.BITS], {}
        for i in at:
            zi, free = z.get(i, 0.0), i == 2**toxicity.BITS
            less = 0 if free else toxicity.L1
            w[i] = 0.0 if abs(zi) <= less else -(zi - np.sign(zi) * less) * toxicity.ALPHA / (toxicity.BETA + n.get(i, 0.0) ** 0.5)
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in at:
            ni = n.get(i, 0.0)
            sigma = ((ni + g * g) ** 0.5 - ni**0.5) / toxicity.ALPHA
            z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], ni + g * g
    for i in z:
        assert state.z[i] == pytest.approx(z[i]) and state.n[i] == pytest.approx(n[i])


def test_held_out_texts_are_told_apart(spark, learned):
    _, _, _, model = learned
    rows = made(600, seed=9)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows]) > 0.97
    for i, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.5)
    kept = {r.doc_id for r in toxicity.keep_civil(docs, model).collect()}
    assert kept == {i for i in got if not got[i].predicted}


def test_weights_are_few(learned):
    _, docs, _, model = learned
    met = set()
    for r in docs.collect():
        met |= set(toxicity.columns_of(r.text).tolist())
    assert 0 < len(model.columns) < len(met) / 10
    for word in INSULTS:
        assert model.dense()[toxicity.columns_of(word)[0]] > 0


def test_fit_depends_on_rows_alone(spark, learned):
    _, docs, labels, model = learned
    again = toxicity.learn(docs.repartition(7), labels.repartition(3))
    assert again.columns.tolist() == model.columns.tolist() and again.weights.tolist() == model.weights.tolist()
    # Held-out labels play no part, nor does a repeated document.
    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs.unionByName(docs), other).weights.tolist() == model.weights.tolist()


def test_edges(spark, learned):
    _, docs, labels, model = learned
    rows = [(None, "grobble"), (1, None), (1, None), (2, ""), (3, "tab " * 200_000 + "grobble"), (4, "中文 \U0001f600")]
    odd = spark.createDataFrame([(i, t, 1.0, "x", 5) for i, t in rows], "doc_id long, text string, score double, held_out string, toxic int")
    got = toxicity.score_documents(odd, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1  # a null text is an empty one
    empty = docs.limit(0)
    assert toxicity.score_documents(empty, model).isEmpty()
    nothing = toxicity.learn(empty, labels)
    assert len(nothing.columns) == 0 and {r.score for r in toxicity.score_documents(odd, nothing).collect()} == {0.5}
    bad = spark.createDataFrame([(0, None), (None, 1), (1, 7)], "doc_id long, toxic int")
    assert len(toxicity.learn(docs, bad).columns) == 0


def test_small_table(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op13_toxicity(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    assert set(got) == {r.doc_id for r in queries.documents(spark, sf_dir).collect()}
    seen = [r for r in labels if not got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].predicted == r.toxic for r in seen]) > 0.9
