"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes null texts as empty ones, null ids, repeated rows and further columns,
and gives no rows for an empty table; what it does with them its operator states.

Each stage is one of the corpus operators, applied to all that its predecessor kept.
``run`` writes every stage to the folder that the cluster shares and reads it again, so
a lost executor costs no more than the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vintara.llm import exact, packing, pii, quality, similar
from vintara.llm.common import shared_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a classifier learned from ``labels`` accepts; a null text is scored as an empty one."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact.drop_exact_duplicates(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by SimHash variants and a similarity of 0.8, the document with the smallest id."""
    return similar.drop_similar_documents(docs)


def sanitised_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data and what reveals it replaced by labels."""
    return pii.sanitise(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good_documents),
    ("exact_dedup", distinct_documents),
    ("near_dedup", dissimilar_documents),
    ("personal_data", sanitised_documents),
    ("packing", packed_documents),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
