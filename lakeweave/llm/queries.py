"""The queries of the training-data operators for the driver contract: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, dac, dedup, merkle, packing, pii, quality, simhash, tokens
from .bpe import vocabulary
from .common import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.remove_repeated(table(spark, sf_dir, "documents"), 100, ("n_bytes", "n_removed", "n_spans", "kept_sha256"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), with_ids=False)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3).select("doc_id", "fingerprint", "component_id")


def _if_kind(kind: str):
    return lambda span: F.when(span["kind"] == kind, 1)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.array_compact(F.transform("base", _if_kind(k)))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.written("base"), 256).alias("base_sha256"), pii.written("spans").alias("spans"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.filter("vec_id % 20 = 0"), k=20)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    dac.write_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), folder)
    return dac.read_tokens(spark, folder, with_ids=False)


QUERIES = {
    "op1_suffix_array_dedup": op1,
    "op2_bpe_encode_decode": op2,
    "op3_document_fingerprints": op3,
    "op4_packing": op4,
    "op5_simhash_near_dedup": op5,
    "op6_personal_data": op6,
    "op7_token_counts": op7,
    "op8_inverted_multi_index": op8,
    "op9_quality_classifier": op9,
    "op10_token_binary": op10,
}
ORACLES: dict[str, str] = {}
