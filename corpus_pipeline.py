"""A training-data pipeline over documents: reject bad ones, one of each near-duplicate group, no benchmark, masked, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from umbra.llm import decontaminate, packing, pii, quality, shingles
from umbra.llm.common import documents, drop_settled, settled, settled_so_far


def good_ones(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    Links are those of SimHash fingerprints over five words where the sets of shingles have a similarity of 0.8 or more,
    and all others of that similarity, which fingerprints of 64 bits can't promise.
    """
    return shingles.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked."""
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each at its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", good_ones),
    ("simhash_near_dedup", one_of_each),
    ("benchmark_decontamination", uncontaminated),
    ("pii", masked),
    ("packing", packed),
]

#: SQL can't express fingerprints, trained taggers or token ids; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; what each stage before it returns is written to the shared folder and read again.

    What a stage wrote on its way, and what it read, is deleted once its own result is written.
    """
    docs, before = documents(spark, sf_dir), settled_so_far(spark)
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
        drop_settled(spark, before | {docs.settled_at})
    return STAGES[-1][1](spark, docs, sf_dir)
