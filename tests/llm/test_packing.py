import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from tokenizers import Tokenizer
from vintara.llm import packing


def optimum(items, capacity):
    """The least number of bins, by trying everything."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0] and i < len(items):
            return
        if i == len(items):
            best[0] = min(best[0], len(rooms))
            return
        for room in set(rooms):
            if room >= items[i]:
                at = rooms.index(room)
                place(i + 1, rooms[:at] + [room - items[i]] + rooms[at + 1 :])
        place(i + 1, rooms + [capacity - items[i]])

    place(0, [])
    return best[0]


def bins(patterns):
    return sum(times for _, times in patterns)


@settings(max_examples=300, deadline=None)
@given(st.integers(8, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=8))))
def test_dominance_keeps_the_optimum(case):
    capacity, items = case
    counts = {x: items.count(x) for x in items}
    fixed, rest = packing.reduce_by_dominance(dict(counts), capacity)
    left = [x for x, n in rest.items() for _ in range(n)]
    assert bins(fixed) + (optimum(left, capacity) if left else 0) == optimum(items, capacity)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_plan_places_every_piece_once(items):
    patterns = packing.plan({x: items.count(x) for x in items}, 50)
    assert sorted(x for content, times in patterns for x in content * times) == sorted(items)
    assert all(sum(content) <= 50 for content, _ in patterns)


def test_plan_is_near_the_bound_for_many_pieces():
    rng = random.Random(1)
    counts = {n: rng.randint(0, 5000) for n in range(1, 2049)}
    bound = sum(n * k for n, k in counts.items()) / 2048
    assert bins(packing.plan(counts)) <= 1.02 * bound + 1


def check(rows, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        first, start, piece = len(ids) % 2048 or 2048, 0, 0
        while start < len(ids):
            n = first if piece == 0 else 2048
            want.append((doc_id, piece, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            start, piece = start + n, piece + 1
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by_sequence)


def test_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (4, "word " * 9000), (5, "é漢字 🙂" * 3000)]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in texts], "doc_id long, text string, piece string, length int")
    check(packing.pack_documents(docs).collect(), texts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs).count() == 0


@pytest.mark.parametrize("rows", [300])
def test_small_buckets_rank_without_gaps(spark, rows, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 7)
    rng = random.Random(3)
    texts = [(i, "ab " * rng.choice([1, 2, 2, 2, 50, 900])) for i in range(rows)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    check(packing.pack_documents(docs).collect(), texts)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    used = check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert used <= 1.01 * sum(r.length for r in rows) / 2048 + 1
