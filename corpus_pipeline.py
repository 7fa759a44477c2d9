"""Corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

A stage takes (spark, docs, sf_dir) and returns documents; run() writes what
each returns as Parquet and reads it again for the next one.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxdesk.llm import decontamination, mixing, quality, sharding, simhash
from voxdesk.llm.common import Scratch, fresh, if_small

SHARDS = 8

#: The mix follows hashes and permutations that SQL does not have.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the isolation forest keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_clean(docs, labels, Scratch(spark, "stage-quality"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the first row of its smallest doc_id."""
    scratch = Scratch(spark, "stage-simhash")
    row = fresh(docs, "row_number")[0]
    numbered = scratch.store(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = simhash.near_duplicates(
        numbered.select(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", row).alias("key"), "text"),
        scratch, "key",
    )
    dropped = found.where(F.col(f"key.{row}") != F.col(f"component_id.{row}")).select(F.col(f"key.{row}").alias(row))
    # Fewer rows go than stay; broadcast while they are few, the text is not shuffled.
    dropped = if_small(scratch.store(dropped, "dropped"))
    return numbered.join(dropped, row, "left_anti").drop(row)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.drop_contaminated(docs, items, Scratch(spark, "stage-decontamination"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources, its documents cut and repeated as the blocks drawn say."""
    return mixing.mixed_documents(docs, Scratch(spark, "stage-mixing"))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot."""
    return sharding.assign(docs, Scratch(spark, "stage-sharding"), SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, one after the other."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
    return docs
