"""Exact deduplication with a heavy-hitter split (DataFrame operations only).

One group of copies may hold a third of all rows, so a plain shuffle on the digest
would send them all to one task. A Misra-Gries summary (``DataFrame.freqItems``, at
most ``1 / support`` counters) finds every digest with more than ``support`` of the
rows. One exact pass verifies their counts and winners, which are broadcast, and the
rows of these digests are settled where they are. No other digest has more than
``support`` of the rows; these take an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintara.llm.common import saved, text_of
from vintara.storage import small

#: Share of the rows above which a digest counts as frequent. It bounds the broadcast:
#: at most ``1 / SUPPORT`` digests.
SUPPORT = 0.001
#: Rows of identifiers and digests (about 100 bytes each) up to which they are broadcast.
DROP_ROWS = 100_000


def frequent_values(df: DataFrame, column: str, support: float = SUPPORT) -> DataFrame:
    """Candidates for values of ``column`` held by over ``support`` of the rows.

    Every such value is among them; at most ``1 / support`` others may be, so the
    result is small enough to broadcast however large ``df`` is. Nulls are left out.
    """
    some = df.where(F.col(column).isNotNull()).freqItems([column], support)
    return some.select(F.explode(F.col(f"{column}_freqItems")).alias(column))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their characters are; null counts as the empty text. Of equal
    texts the row with the largest id stays (a null id is smaller than any other). If
    rows repeat with the same id and text, exactly one is kept. Other columns, whatever
    their names, play no part. An empty table gives no rows.
    """
    rows = saved(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.sha2(text_of(docs, text), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    best = F.max(F.struct("doc_id", "_row")).alias("_best")
    winners = saved(
        rows.join(F.broadcast(frequent_values(rows, "text_sha256", support)), "text_sha256")
        .groupBy("text_sha256")
        .agg(best, F.count(F.lit(1)).alias("group_size"))
    )
    frequent = rows.join(F.broadcast(winners), "text_sha256")
    # Aggregated before the shuffle, so no group is ever held by one task.
    rest = rows.join(F.broadcast(winners), "text_sha256", "left_anti")
    others = rest.join(rest.groupBy("text_sha256").agg(best, F.count(F.lit(1)).alias("group_size")), "text_sha256")
    columns = [
        F.col("doc_id"),
        F.col("_best.doc_id").alias("keep_id"),
        F.col("group_size"),
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        F.col("text_sha256"),
    ]
    return frequent.select(*columns).unionByName(others.select(*columns))


def drop_unkept(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``found`` keeps, with all their columns.

    ``found`` has ``doc_id, digest, kept`` for each row, the digest being the SHA-256 of its
    text, and keeps one at most of rows that repeat with id and text. What goes is decided
    on these; texts are shuffled only if more than :data:`DROP_ROWS` rows go,
    or for rows that repeat with id and text and of which one stays.
    """
    each = found.groupBy(F.col("doc_id").alias("_vintara_id"), F.col("digest").alias("_vintara_digest")).agg(
        F.bool_or("kept").alias("_vintara_kept"), F.count(F.lit(1)).alias("_vintara_n")
    )
    # Few rows are broadcast after a count; more meet the texts in a shuffle.
    each = small(saved(each.where("NOT _vintara_kept OR _vintara_n > 1")), DROP_ROWS)
    marked = docs.withColumn("_vintara_hash", F.sha2(text_of(docs, text), 256))
    same = F.col(doc_id).eqNullSafe(F.col("_vintara_id")) & (F.col("_vintara_hash") == F.col("_vintara_digest"))
    alone = marked.join(each, same, "left_anti").select(*docs.columns)
    repeated = each.where("_vintara_kept")
    if repeated.isEmpty():
        return alone
    one = Window.partitionBy("_vintara_hash", doc_id).orderBy(F.lit(1))
    of_each = marked.join(repeated, same, "left_semi").withColumn("_vintara_rank", F.row_number().over(one))
    return alone.unionByName(of_each.where("_vintara_rank = 1").select(*docs.columns))


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    Same treatment of nulls, ties and repeats; an empty table gives no rows.
    """
    found = exact_dedup(docs, doc_id, text, support).select("doc_id", F.col("text_sha256").alias("digest"), "kept")
    return drop_unkept(docs, found, doc_id, text)
