"""SimHash groups, components, neighbours against brute force."""

import os
import random
import re

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F
from vintara.llm import ann, components, queries, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    array = np.array(prints, np.uint64)
    for i in range(len(array)):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= 4) + i + 1:
            parent[find(int(j))] = find(i)
    least = {}
    for i, doc_id in enumerate(ids):
        root = find(i)
        least[root] = min((x for x in (least.get(root), doc_id) if x is not None), default=None)
    return [least[find(i)] for i in range(len(ids))]


TEXTS = [
    (10, None), (9, " \t\n"), (8, "one"), (3, "One"), (7, "a b c d"), (6, "A  b\tC d"), (5, "é漢 🙂 x y z"), (5, "é漢 🙂 x y z"),
    (None, "é漢 🙂 x y z"), (4, "w " * 30000), (None, "alone of all"), (2, "a\x1cb c\x85d e\xa0f"),
]


def test_fingerprints():
    for _, text in TEXTS:
        assert simhash.fingerprint(text or "") % 2**64 == brute_print(text)


def test_rows_of_every_kind(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in TEXTS], "doc_id long, text string, fp int")
    want = brute_components([brute_print(t) for _, t in TEXTS], [i for i, _ in TEXTS])
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(zip((i for i, _ in TEXTS), want), key=str)
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted({r.component_id for r in got}, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def variants_of(rng, center, n, flips):
    out = set()
    while len(out) < n:
        x = center
        for bit in rng.sample(range(64), rng.randint(0, flips)):
            x ^= 1 << bit
        out.add(x)
    return out


def test_no_link_is_missed_in_dense_groups(spark):
    rng = random.Random(11)
    prints = set()
    for n, flips in ((400, 3), (60, 5), (30, 2), (5, 4)):
        prints |= variants_of(rng, rng.getrandbits(64), n, flips)
    prints |= {rng.getrandbits(64) for _ in range(300)}
    chain = rng.getrandbits(64)
    for i in range(0, 64, 4):
        chain ^= 15 << i
        prints.add(chain)
    prints = sorted(x - 2**64 if x >= 2**63 else x for x in prints)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r.fp: r.root for r in simhash.linked_components(frame).collect()}
    want = brute_components([p % 2**64 for p in prints], prints)
    assert [got.get(p, p) for p in prints] == want


def test_variants_meet_for_every_near_pair(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        rows.append(tuple(x - 2**64 if x >= 2**63 else x for x in (a, b)))
    pairs = spark.createDataFrame(rows, "a long, b long")
    assert pairs.where(F.arrays_overlap(simhash.variant_keys(F.col("a")), simhash.variant_keys(F.col("b")))).count() == 200


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 5), (5, 7), (9, 9), (200, 1), (None, 4), (3, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.connected_components(frame).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {3: 3, 5: 3, 7: 3, 1: 1, 200: 1}
    assert components.connected_components(frame.limit(0)).count() == 0


def test_near_duplicates_of_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = [brute_print(r.text) for r in docs]
    want = {
        (r.doc_id, f"{p:016x}", c) for r, p, c in zip(docs, prints, brute_components(prints, [r.doc_id for r in docs]))
    }
    assert set(map(tuple, queries.QUERIES["op5_simhash_near_dedup"](spark, sf_dir).collect())) == want


# Neighbours.


def brute_neighbours(ids, vectors, own, query, k):
    scores = (vectors * query).sum(axis=1)
    other = ids != own
    order = np.lexsort((ids[other], -scores[other]))[:k]
    return list(zip(ids[other][order].tolist(), scores[other][order].tolist()))


def recall(spark, rows, k=20, **options):
    """Recall, and the share of candidates verified; the form of the rows is asserted."""
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, rank string")
    got = ann.nearest_neighbours(frame, F.col("vec_id") % 20 == 0, k, **options).collect()
    ids = np.array([r[0] for r in rows])
    vectors = np.array([r[1] for r in rows], np.float32).astype(float)
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score, r.verified))
    found = total = verified = possible = 0
    for own, query in zip(ids, vectors):
        if own % 20:
            continue
        want = brute_neighbours(ids, vectors, own, query, k)
        mine = sorted(by_query[own])
        assert [m[0] for m in mine] == list(range(1, len(want) + 1))
        assert all(abs(m[2] - (vectors[ids == m[1]][0] * query).sum()) < 1e-12 for m in mine)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        found += len({m[1] for m in mine} & {w[0] for w in want})
        total += len(want)
        verified += mine[0][3]
        possible += len(ids) - 1
    return found / total, verified / possible


def test_recall_on_vectors_of_different_length(spark):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((12, 24))
    rows = [(i, (centers[i % 12] + 0.5 * rng.standard_normal(24)) * rng.uniform(0.2, 3), "x", "y") for i in range(1500)]
    rows = [(i, v.tolist(), a, b) for i, v, a, b in rows]
    assert recall(spark, rows)[0] >= 0.9
    # Eight cells: queries are routed by the stopping test.
    some, share = recall(spark, rows, block_rows=200)
    assert some >= 0.9 and share < 0.9


def test_equal_vectors_tie_to_the_smaller_id(spark):
    rng = np.random.default_rng(9)
    hot = rng.standard_normal(8).tolist()
    rows = [(i, hot if i % 2 else rng.standard_normal(8).tolist(), "", "") for i in range(400)]
    assert recall(spark, rows, block_rows=100)[0] >= 0.9
    same = [(i, hot, "", "") for i in range(100)]
    assert recall(spark, same)[0] == 1.0


def test_norms_that_cannot_reach_the_best_are_skipped(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16) * (10 if i % 10 == 0 else 0.01), "", "") for i in range(1000)]
    found, share = recall(spark, [(i, v.tolist(), a, b) for i, v, a, b in rows], k=3, block_rows=64)
    assert found >= 0.9 and share < 0.9


def test_rows_that_share_an_id_are_candidates(spark):
    rows = [(0, [1.0, 0.0], "", ""), (0, [0.0, 1.0], "", ""), (0, [0.0, 1.0], "", ""), (7, [1.0, 1.0], "", ""), (7, [2.0, 1.0], "", "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, rank string")
    got = ann.nearest_neighbours(frame, F.col("vec_id") % 20 == 0, 5).collect()
    want = [(0, 1, 7, 1.0), (0, 1, 7, 2.0), (0, 2, 7, 1.0), (0, 2, 7, 1.0), (0, 3, 0, 0.0), (0, 3, 0, 0.0)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def test_vectors_that_take_no_part(spark):
    rows = [
        (0, [1.0, 2.0], "", ""), (20, [2.0, 1.0], "", ""), (1, None, "", ""), (2, [0.0, 0.0], "", ""), (3, [1.0, None], "", ""),
        (4, [float("nan"), 1.0], "", ""), (5, [float("inf"), 1.0], "", ""), (40, [], "", ""), (None, [1.0, 1.0], "", ""),
        (60, [1.0, 2.0, 3.0], "", ""), (0, [1.0, 2.0], "", ""),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, rank string")
    got = ann.nearest_neighbours(frame, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 20, 4.0), (20, 1, 0, 4.0)]
    assert ann.nearest_neighbours(frame.limit(0), F.lit(True)).count() == 0


def test_chi_square_and_trees():
    assert abs(ann.chi_square_quantile(0.95, 10) - 18.307) < 1e-3
    rng = np.random.default_rng(0)
    points = rng.standard_normal((1000, 6))
    order, starts = ann.kd_order(points, 20)
    assert sorted(order.tolist()) == list(range(1000)) and np.diff([*starts, 1000]).max() <= 20
    for a, b in zip(starts, [*starts[1:], 1000]):
        part = points[order[a:b]]
        low = ann.box_distances(part.min(axis=0)[None], part.max(axis=0)[None], np.zeros(6))[0]
        assert low <= (part**2).sum(axis=1).min() + 1e-12
    cells = ann.Cells(points, 8)
    assert cells.n == 8 and np.bincount(cells.of(points), minlength=8).min() > 60
    assert ann.Cells(np.ones((50, 3)), 8).n == 1 and ann.Cells(np.zeros((0, 3)), 8).of(points[:, :3]).tolist() == [0] * 1000


def test_points_are_verified_in_the_order_of_their_projected_distance():
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((5000, 48))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    block = ann.Block.build(np.arange(5000), vectors, 1.0)
    for q in range(5):
        limit = ann.chi_square_quantile(0.8, ann.PROJECTIONS)
        ids, scores, verified = block.nearest(q, vectors[q], 10, limit)
        away = ((block.points - ann.projected(vectors[q : q + 1], 1.0, ann.PROJECTIONS)) ** 2).sum(axis=1)
        first = block.ids[np.argsort(away, kind="stable")[:verified]]
        best = first[first != q][np.argsort(-(vectors[first[first != q]] @ vectors[q]), kind="stable")[:10]]
        assert verified < 4500 and ids.tolist() == best.tolist()
        # A floor leaves out what is below it and shortens the search.
        some = block.nearest(q, vectors[q], 10, limit, float(scores[2]))
        assert set(some[0].tolist()) <= set(ids[:3].tolist()) and some[2] <= verified


def test_recall_of_table(spark):
    rows = [(r.vec_id, list(r.embedding), "", "") for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    found, share = recall(spark, rows)
    assert found >= 0.9 and share < 0.7


def test_query_of_table(spark, sf_dir):
    ids = [r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()]
    assert queries.QUERIES["op3_nearest_neighbours"](spark, sf_dir).count() == 20 * sum(1 for i in ids if i % 20 == 0)


@pytest.mark.skipif(not os.environ.get("TEST_LARGE"), reason="minutes; figures are in the README")
def test_recall_of_a_hundred_thousand_vectors(spark):
    rng = np.random.default_rng(5)
    base = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()], float)
    found = base[rng.integers(0, len(base), 100_000)] + 0.1 * rng.standard_normal((100_000, base.shape[1]))
    found /= np.linalg.norm(found, axis=1)[:, None]
    rows = [(i if i % 200 == 0 or i % 20 else i + 1_000_001, v.tolist(), "", "") for i, v in enumerate(found)]
    some, share = recall(spark, rows)
    assert some >= 0.9 and share < 0.7
