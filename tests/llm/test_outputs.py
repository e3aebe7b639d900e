"""Shards, the quality classifier and the pipeline."""

import io
import zlib

import numpy as np
import pytest

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer
from pyspark.sql import functions as F
from vintara.llm import common, exact, packing, pii, quality, queries, simhash, sstable


def ids_of(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_shard_round_trip():
    out, rows = io.BytesIO(), [(None, 0), (-5, 0), (0, 0), (3, 0), (3, 1), (2**40, 0)]
    writer = sstable.ShardWriter(out, block_bytes=64)
    data = {row: np.arange(i * 7, dtype="<u4").tobytes() for i, row in enumerate(rows)}
    for row in rows:
        writer.add(sstable.key_of(*row), data[row])
    with pytest.raises(ValueError):
        writer.add(sstable.key_of(0, 0), b"")
    assert writer.finish() == (6, sum(len(x) for x in data.values()) // 4)
    reader = sstable.ShardReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert [(sstable.identifier_of(k), ids) for k, ids in reader] == [(row[0], data[row]) for row in rows]
    for row in rows:
        assert reader.get(*row).tobytes() == data[row]
    assert reader.get(1) is None and reader.get(3, 2) is None
    assert sum(reader.bloom.may_hold(sstable.key_of(i, 0)) for i in range(1000, 3000)) < 100


def test_empty_shard():
    out = io.BytesIO()
    assert sstable.ShardWriter(out).finish() == (0, 0)
    assert list(sstable.ShardReader(io.BytesIO(out.getvalue()), len(out.getvalue()))) == []


def check_shards(spark, texts, n_shards):
    docs = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, start int")
    folder = common.shared_path(spark, "test-shards")
    got = sstable.read_shards(sstable.write_shards(docs, folder, n_shards), folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = sorted((str(i), len(ids_of(t)), zlib.crc32(ids_of(t).tobytes())) for i, t in texts)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    return folder


def test_shards_of_rows_of_every_kind(spark):
    texts = [(5, "b c"), (1, None), (None, "x"), (5, "a"), (5, "a"), (-3, ""), (9, "long " * 20000), (None, "y")]
    check_shards(spark, texts, 3)
    check_shards(spark, [], 2)
    folder = check_shards(spark, [(i, f"text {i}") for i in range(500)], 4)
    found = [sstable.open_shard(f"{folder}/shard-{s:06d}.sst").get(321) for s in range(4)]
    assert [x.tolist() for x in found if x is not None] == [ids_of("text 321").tolist()]


def test_shards_of_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op9_sstable_output"](spark, sf_dir).collect()}
    at = 0
    for r in docs:
        ids = ids_of(r.text)
        assert got[r.doc_id] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


# Quality.


def test_pairs_are_learned():
    rng = np.random.default_rng(0)
    rows = rng.standard_normal((2000, quality.N_FEATURES))
    labels = (rows[:, 2] - 0.5 * rows[:, 5] + 0.1 * rng.standard_normal(2000) > -1).astype(float)
    model = quality.fit(rows, labels)
    assert ((model.score(rows) >= quality.ACCEPT) == labels).mean() > 0.95
    assert abs((model.score(rows) < quality.ACCEPT).mean() - (labels == 0).mean()) < 0.01


def test_scores_of_rows_of_every_kind(spark):
    model = quality.fit(np.zeros((0, quality.N_FEATURES)), np.zeros(0))
    texts = [(1, None), (2, ""), (None, "a"), (4, "\n\n"), (5, "w " * 60000), (5, "w " * 60000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, score int")
    got = quality.score_documents(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert quality.score_documents(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (4, 7)], "doc_id long, quality int")
    learned = quality.learn(docs, labels)
    assert all(r.score == pytest.approx(0.7) for r in quality.score_documents(docs, learned).collect())


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = queries.QUERIES["op10_quality_classifier"](spark, sf_dir).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) >= 0.95


def test_repeated_documents_count_once_and_all_labels_count(spark):
    rng = np.random.default_rng(2)
    words = {1: "the quiet river runs below the old stone bridge and on", 0: "BUY now!!! $$$ click | win | free ### offer"}
    texts = [(i, " ".join(rng.permutation(words[i % 2].split()))) for i in range(32)]
    schema = "doc_id long, text string, quality string"
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int")
    once = quality.learn(spark.createDataFrame([(i, t, "x") for i, t in texts], schema), labels)
    # Six rows a label, more than the sample has labels, in another order.
    more = spark.createDataFrame([(i, t, "x") for i, t in texts * 6][::-1], schema).repartition(7)
    repeated = quality.learn(more, labels, sample_rows=32)
    assert np.allclose(once.weights, repeated.weights) and once.threshold == repeated.threshold
    scores = {r.doc_id: r.predicted for r in quality.score_documents(more, repeated).collect()}
    assert all(scores[i] == i % 2 for i, _ in texts)


def test_content_is_learned():
    # Written alike; only the words tell them apart.
    rng = np.random.default_rng(6)
    good, bad = (["aba", "cade", "milo", "ronda"], ["uku", "wexy", "zupf", "jirgo"])
    texts = [" ".join(rng.choice(good if i % 2 else bad, 40)) for i in range(200)]
    rows, labels = np.array([quality.features(t) for t in texts]), np.arange(200.0) % 2
    model = quality.fit(rows[:100], labels[:100])
    assert ((model.score(rows[100:]) >= quality.ACCEPT) == labels[100:]).mean() > 0.95


def test_pairwise_loss_is_least():
    rng = np.random.default_rng(8)
    rows, better, worse = rng.standard_normal((60, 5)), rng.integers(0, 60, 300), rng.integers(0, 60, 300)
    w = quality.fit_pairs(rows, better, worse, ridge=0.01)

    def gradient(w):
        x = rows[better] - rows[worse]
        return -(x / (1 + np.exp(x @ w))[:, None]).mean(axis=0) + 0.01 * w

    assert np.abs(gradient(w)).max() < 1e-4


def test_accepted_rows_are_whole(spark):
    model = quality.fit(np.zeros((0, quality.N_FEATURES)), np.zeros(0))
    docs = spark.createDataFrame([(1, None, 3, 0.1), (None, "a", None, 0.2), (1, None, 3, 0.1)], "doc_id long, text string, _id int, score double")
    assert quality.keep_good(docs, model).collect() == docs.collect()
    assert quality.keep_good(docs.limit(0), model).count() == 0 and quality.keep_good(docs, model).columns == docs.columns


def test_held_out_labels_change_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.learn(docs, labels), quality.learn(docs, turned)
    assert (a.weights == b.weights).all() and a.threshold == b.threshold


# Pipeline.


def test_pipeline_against_plain_steps(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.run(spark, sf_dir).collect()

    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    texts = {i: t for i, t in rows.items() if model.score(np.array([quality.features(t)]))[0] >= quality.ACCEPT}
    last = {t: i for i, t in sorted(texts.items())}
    texts = {i: t for t, i in last.items()}
    from test_similar import brute_similar

    ids = sorted(texts)
    least = {ids[c] for c in brute_similar([texts[i] for i in ids])}
    # Keys may miss a link in a hundred, so a copy more may stay; none that should stay goes.
    kept = {r.doc_id for r in got}
    assert least <= kept and len(kept - least) <= 0.02 * len(ids)
    texts = {i: texts[i] for i in kept}
    assert {r.doc_id for r in got} == set(texts)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    want = {(i, len(ids_of(t))) for i, t in clean.items()}
    totals = {}
    for r in got:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length
    assert set(totals.items()) == want


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(50), sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert packing.pack_documents(docs.limit(0)).count() == 0
    assert exact.drop_exact_duplicates(docs).count() >= simhash.drop_near_duplicates(docs).count()
