"""Documents of similar shingles against brute force."""

import random

from vintara.llm import similar


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_similar(texts, least=0.8):
    """The component of each text, as the smallest number in it."""
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b):
                one, two = find(i), find(j)
                parent[max(one, two)] = min(one, two)
    return [find(i) for i in range(len(texts))]


def changed(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_planted_copies_are_found_and_others_left_alone(spark):
    rng = random.Random(5)
    texts = [" ".join(f"t{rng.randrange(3000)}" for _ in range(rng.choice((60, 200, 400)))) for _ in range(80)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"q{rng.randrange(3000)}" for _ in range(80)) for _ in range(40)]
    # A dense group, whose members are nearer to their original than to each other.
    texts += [changed(rng, texts[2], 1 + len(texts[2].split()) // 90) for _ in range(60)]
    for i in range(3, 60):
        texts += [changed(rng, texts[i], rng.randrange(1, 6)) for _ in range(i % 3)]
    want = brute_similar(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in similar.similar_documents(docs).collect()}
    missed = sum(got[i].component_id != c for i, c in enumerate(want))
    assert missed <= 0.01 * len(texts)
    # Nothing is joined that brute force doesn't join.
    groups = {}
    for i, c in enumerate(want):
        groups.setdefault(got[i].component_id, set()).add(c)
    assert all(len(g) == 1 for g in groups.values())
    assert [i for i in got if got[i].kept] == [i for i in got if got[i].component_id == i]
    assert {r.doc_id for r in similar.drop_similar_documents(docs).collect()} == {r.component_id for r in got.values()}


def test_rows_of_every_kind(spark):
    long = "w " * 30_000
    texts = [(10, None), (9, " \t\n"), (8, "one"), (3, "One"), (7, "a b c d"), (6, "A  b\tC d"), (5, "é 漢 x y z"), (5, "é 漢 x y z"),
             (None, "é 漢 x y z"), (4, long), (None, "alone of all"), (None, "alone of all")]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in texts], "doc_id long, text string, fp int, digest string")
    got = similar.similar_documents(docs).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted(
        [("10", "9"), ("9", "9"), ("8", "3"), ("3", "3"), ("7", "6"), ("6", "6"), ("5", "5"), ("5", "5"), ("None", "5"), ("4", "4"), ("None", "None"), ("None", "None")]
    )
    kept = similar.drop_similar_documents(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "6", "9", "None"] and kept.columns == docs.columns
    assert similar.similar_documents(docs.limit(0)).count() == 0 and similar.drop_similar_documents(docs.limit(0)).count() == 0


def test_similar_documents_of_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    want = {r.doc_id: rows[c].doc_id for r, c in zip(rows, brute_similar([r.text for r in rows]))}
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs).collect()}
    assert sum(got[i] != c for i, c in want.items()) <= 0.01 * len(want)


def test_rare_shingles_bring_together_all_similar_and_few_others(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    common = list(range(1000, 1060))  # a passage that all have, half of each
    sets = [common + [int(x) for x in rng.integers(2000, 10**6, 60)] for _ in range(60)]
    for k in range(12):  # and some that differ from another in a few places, up to and beyond the limit
        sets.append(sets[k][: 120 - 2 * k] + [10**7 + 100 * k + j for j in range(2 * k)])
    sets = [sorted(set(s)) for s in sets]
    nodes = spark.createDataFrame([(i, i, s) for i, s in enumerate(sets)], "node long, label long, shingles array<int>")
    found = {(r.a, r.b) for r in similar._sharing_rare(nodes, 0.8).collect()}

    def alike(a, b):
        shared = len(set(sets[a]) & set(sets[b]))
        return shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared)

    linked = {(a, b) for b in range(len(sets)) for a in range(b) if alike(a, b)}
    assert linked and linked <= found and len(found) <= 12
    one = nodes.withColumn("label", nodes.label * 0)
    assert similar._sharing_rare(one, 0.8).isEmpty() and similar._sharing_rare(nodes.limit(0), 0.8).isEmpty()


def test_candidates_of_a_dense_group_are_few_for_each_text(spark, monkeypatch):
    rng, texts = random.Random(1), []
    base = [f"b{i}" for i in range(150)]
    for _ in range(500):
        words = list(base)
        for _ in range(rng.randrange(9)):
            place = rng.randrange(len(words))
            words[place : place + rng.randrange(2)] = [f"x{rng.randrange(10**6)}"] * rng.randrange(2)
        texts.append(" ".join(words))
    candidates, verified = [], similar._verified

    def counted(pairs, *args):
        candidates.append(pairs.count())
        return verified(pairs, *args)

    monkeypatch.setattr(similar, "_verified", counted)
    got = {r.doc_id: r.component_id for r in similar.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[i] != c for i, c in enumerate(brute_similar(texts))) <= 0.01 * len(texts)
    # Those with hubs, and those that hubs leave apart.
    assert candidates[0] <= 16 * len(texts) and candidates[1] <= len(texts)
