"""The Merkle manifest: against a plain version, partial runs, edges."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from vintara.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([digest(*found[-1][i : i + 8]) for i in range(0, len(found[-1]), 8)])
    return found


def siblings(levels, place):
    found = []
    for nodes in levels[:-1]:
        run, k = nodes[place // 8 * 8 :][:8], place % 8
        found.append((run[:k], run[k + 1 :]))
        place //= 8
    return found


def plain(rows):
    """The rows of the query, with lists and loops."""
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        ordered = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        trees[name] = ordered, levels_of([leaf_of(r, r["text"]) for r in ordered])
    top = levels_of([trees[name][1][-1][0] for name in names])
    found = []
    for at, name in enumerate(names):
        ordered, levels = trees[name]
        for place, row in enumerate(ordered):
            path, text = siblings(levels, place) + siblings(top, at), row["text"]
            if text is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0:
                text = text.translate({c: c + 32 for c in range(65, 91)})
            folded = leaf_of(row, text)
            for left, right in path:
                folded = digest(*left, folded, *right)
            proof = digest(*(d for left, right in path for d in left + right))
            found.append((row["doc_id"], levels[0][place], levels[-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return found


def checked(docs):
    copies = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.lowered()).otherwise(F.col("text"))
    return sorted((tuple(r) for r in merkle.verify_copies(docs, copies).collect()), key=str)


def same(docs):
    assert checked(docs) == sorted(plain([r.asDict() for r in docs.collect()]), key=str)


def test_small_table(spark, sf_dir):
    got = sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, sf_dir).collect()), key=str)
    assert got == sorted(plain([r.asDict() for r in queries.documents(spark, sf_dir).collect()]), key=str)
    assert {verified for *_, verified in got} == {True, False}


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 513, 5000])
def test_trees_of_every_depth(spark, n):
    docs = spark.range(n).selectExpr("id * 7 - 3 AS doc_id", "concat('Ab', id % 3) AS text", "'x' AS lang", "'s' AS source", "id AS n_chars")
    same(docs)


def test_many_groups_of_many_sizes(spark):
    docs = spark.range(900).selectExpr(
        "id AS doc_id", "concat('T', id) AS text", "if(id % 11 = 0, NULL, concat('l', cast(sqrt(id) AS int) * cast(sqrt(id) AS int) % 70)) AS lang", "NULL AS source", "id AS n_chars"
    )
    same(docs.withColumn("source", F.lit(None).cast("string")))


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "", "", 0), (1, "", "", "", 0), (1, "A", "", "", 0), (12, "ÉA" * 50000, "é", "S", 5), (3, None, "z", "S", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    same(docs)
    other = docs.withColumns({"grp": F.lit(1), "leaf": F.lit("x"), "place": F.lit(2), "size": F.lit(0), "copy": F.lit("c"), "level": F.lit(9), "root": F.lit("r")})
    assert checked(other) == checked(docs)


def test_a_third_of_all_rows_repeats(spark):
    rows = [(5, "same", "en", "s", 4)] * 300 + [(i, f"T{i}", "en", "s", 2) for i in range(600)]
    same(spark.createDataFrame(rows, SCHEMA).repartition(6))


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert checked(docs) == [] and merkle.manifest(merkle.leaves(docs)).root() is None


def test_root_changes_with_any_row(spark):
    rows = [(i, f"T{i}", "en" if i % 3 else "de", "s", 2) for i in range(40)]
    root = lambda rows: merkle.manifest(merkle.leaves(spark.createDataFrame(rows, SCHEMA))).root()
    first = root(rows)
    assert first == root(rows[::-1])
    assert first != root(rows[1:]) and first != root([*rows[1:], (0, "t0", "de", "s", 2)])
