import hashlib

import duckdb

from vintara.llm import exact, queries


def brute(rows):
    out = []
    texts = [t or "" for _, t in rows]
    for doc_id, text in rows:
        same = [i for (i, _), t in zip(rows, texts) if t == (text or "")]
        keep = max((i for i in same if i is not None), default=None)
        out.append((doc_id, keep, len(same), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "b"), (5, "b"), (None, "c"), (6, "é" * 5000), (7, "A")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, kept string, text_sha256 string")


def test_rows_of_every_kind(spark):
    for support in (0.001, 0.3):
        got = exact.exact_dedup(frame(spark, ROWS), support=support).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(ROWS)
        assert sum(r.kept for r in got) == 6
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_a_hot_text_is_settled_by_broadcast(spark):
    rows = [(i, "hot" if i % 3 else f"t{i // 6}") for i in range(900)]
    got = exact.exact_dedup(frame(spark, rows), support=0.1).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    kept = exact.drop_exact_duplicates(frame(spark, rows), support=0.1)
    assert kept.columns == ["doc_id", "text", "kept", "text_sha256"]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_frequent_values_are_all_found(spark):
    df = spark.createDataFrame([(str(i % 7 if i % 2 else 100 + i),) for i in range(2000)], "v string")
    found = {r.v for r in exact.frequent_values(df, "v", 0.05).collect()}
    assert {str(i) for i in range(7)} <= found and len(found) <= 20


def test_empty_table(spark):
    assert exact.exact_dedup(frame(spark, [])).count() == 0
    assert exact.drop_exact_duplicates(frame(spark, [])).count() == 0


def test_table_against_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = queries.QUERIES["op6_exact_dedup"](spark, sf_dir).select(*columns).collect()
    want = duckdb.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES['op6_exact_dedup']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
