"""Spelling variants: against brute force, cut lists, edges."""

import itertools
import random
import re
import zlib

import pytest

from vintara.llm import queries, spelling

LOWER = {c: c + 32 for c in range(65, 91)}


def counts_of(rows):
    """The words of ``(doc_id, text)`` rows, letters taken out as the query does, with their counts."""
    found = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] = found.get(run, 0) + 1
    return {w: n for w, n in found.items() if n >= 2}


def edits(a, b):
    """Whether exactly one edit leads from ``a`` to ``b``: by trying all of them."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts):
    near = {w: [] for w in counts}
    for a, b in itertools.combinations(counts, 2):
        if edits(a, b):
            near[a].append(b)
            near[b].append(a)
    forms = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * n else None
    found = set()
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        found.add((w, forms[w], root, n, len(near[w]), counts[forms[w]] if forms[w] else None))
    return found


def check(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = [tuple(r) for r in spelling.spelling_forms(words).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(counts) and set(got) == brute(counts)


def test_small_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, sf_dir).select("doc_id", "text").collect()]
    counts = counts_of(rows)
    got = queries.op11_spelling_variants(spark, sf_dir).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {r.word: r.n for r in got} == counts
    assert {tuple(r) for r in got} == brute(counts)


@pytest.mark.parametrize("limit", [3, 10**9])
def test_near_words_of_few_letters(spark, monkeypatch, limit):
    # Many repeated letters, so that an insertion has several places; lists are cut down to one letter, or not at all.
    monkeypatch.setattr(spelling, "LIST", limit)
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 10))) for _ in range(400)}
    words |= {"", "a", "ab", "ba", "aaaaaaaaaaaa", "aaaaaaaaaaaaa", "aaaaaaaaaaaaaa"}
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = [tuple(sorted((r.a, r.b))) for r in spelling.near_words(frame).collect()]
    want = {(a, b) for a, b in itertools.combinations(sorted(words), 2) if edits(a, b) and min(len(a), len(b)) > 1}
    assert len(got) == len(set(got)) and set(got) == want


def test_chains_and_ties(spark):
    # A chain of forms, equal counts, and a word whose best neighbour isn't frequent enough.
    check(spark, {"abcdefgh": 100000, "abcdefg": 1000, "abcdefx": 10, "abcdexx": 2, "zbcdefg": 1000, "qqqqqqq": 5, "qqqqqqr": 49, "qqqqqqs": 49})
    check(spark, {"mmmmmmm": 2, "mmmmmma": 20, "mmmmmmb": 20})


def test_counts_of_all_kinds_of_texts(spark):
    long = "Straßenbau ×÷ÉtéÉté " * 3000
    rows = [(1, None), (2, ""), (3, long), (None, "Elephants elephants"), (None, "Elephants elephants"), (4, "\U0001f600telełgraphs telegraph中telegraph"), (4, "x" * 5000 + " " + "x" * 5000)]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    got = {r.word: r.n for r in spelling.word_counts(docs, misspell=True).collect()}
    assert got == counts_of(rows)
    plain = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    assert plain["elephants"] == 4 and "telegraph" in plain


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    words = spelling.word_counts(docs, misspell=True)
    assert words.isEmpty() and spelling.spelling_forms(words).isEmpty()
