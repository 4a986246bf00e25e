"""From raw documents to packed sequences: five stages, each on all that the one before it kept.

In every stage null and empty texts are documents like others (without words they are copies of each other), rows that
repeat are copies too, a null doc_id is an id that comes last where ids are compared, ties go to the smaller id and then
to the smaller digest of the text, an empty table gives no rows, and columns besides doc_id, text and n_chars pass
through unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeweave.llm import dedup, jaccard, packing, pii, quality
from lakeweave.llm.bpe import vocabulary
from lakeweave.llm.common import drop_folder, new_folder


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, shingle=5, least=0.8)


def fresh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document or place has already."""
    return dedup.without_repeated(docs, length=100)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), with_ids=False)


STAGES = [("quality classifier", good), ("SimHash near-dedup", distinct), ("suffix-array dedup", fresh), ("PII", private), ("packing", packed)]
#: A classifier, shingles and a tokenizer are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each keeps is written to the shared folder and read again, so that no stage is done twice.

    A stage's files go when the next one's are written; the last ones, from which the result is packed, when the driver ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                drop_folder(spark, f"{folder}/{k - 1}")
    return docs
