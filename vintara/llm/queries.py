"""The corpus operators as queries over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.llm import ann, bpe, exact, licenses, merkle, packing, pii, quality, reference_sql, secrets, simhash, spelling, sstable, toxicity
from vintara.llm.common import shared_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(documents(spark, sf_dir)))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest_neighbours(embeddings, F.col("vec_id") % 20 == 0)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(documents(spark, sf_dir)))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digest(pii.personal_data(documents(spark, sf_dir)))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_round_trip(documents(spark, sf_dir))


def op9_sstable_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "shards")
    shards = sstable.write_shards(documents(spark, sf_dir), folder)
    return sstable.read_shards(shards, folder)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_documents(docs, model)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return spelling.spelling_forms(spelling.word_counts(docs, misspell=True))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    copies = F.when(tampered, merkle.lowered()).otherwise(F.col("text"))
    return merkle.verify_copies(documents(spark, sf_dir), copies)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, model)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_license_scan, op3_nearest_neighbours, op4_secret_scan, op5_simhash_near_dedup, op6_exact_dedup, op7_personal_data, op8_bpe_round_trip, op9_sstable_output, op10_quality_classifier, op11_spelling_variants, op12_merkle_manifest, op13_toxicity)}

ORACLES = {
    "op6_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER g AS keep_id,
               count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_spelling_variants": reference_sql.SPELLING,
    "op12_merkle_manifest": reference_sql.MERKLE,
}
