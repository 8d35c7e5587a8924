"""A training-data pipeline over ``documents``: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; the runner
writes it as Parquet and reads it back as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxweave.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from fluxweave.llm.common import materialize, table
from fluxweave.llm.queries import mixing_model, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts as toxic go."""
    return toxicity.drop_toxic(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by the n-gram Jaccard join, the one with the smallest id stays."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold enough of a benchmark item go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of domains under their target weight repeat; none is dropped, since rates start at 1."""
    return mixing.resample(docs, mixing_model(docs, table(spark, sf_dir, "labels"), keep_all=True))


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard, and the place in it, of every row."""
    found, _ = sharding.shard(docs)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_to_targets),
    ("sharding", to_shards),
]

#: The learned stages can't be expressed in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
