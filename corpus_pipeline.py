"""A training corpus from raw documents: rejected, line-deduplicated, near-deduplicated, mixed and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from civicspark.llm.common import shared_table
from civicspark.llm.line_dedup import without_shared_lines
from civicspark.llm.mixing import mixed
from civicspark.llm.near_copies import one_of_each_group
from civicspark.llm.packing import pack
from civicspark.llm.quality_classifier import good_documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds too go; a document that loses all its lines is an empty one."""
    return without_shared_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that five-word shingles of Jaccard similarity 0.8 or more connect."""
    return one_of_each_group(docs, n=5, radius=12, similarity=0.8)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand in the mix as often as their source's target takes them, some not at all, some twice."""
    return mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; every copy of a document is packed."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Models, XXH64 and token ids have no form in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir))
    return docs
