"""A pipeline over the documents: each stage calls one corpus operator and works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelore.llm import decontam, mixing, registry, sharding, simhash, toxicity
from pricelore.llm.common import released, ship, stored, table


def begin(spark: SparkSession) -> None:
    """Give the executors the operators, and let go of what the stage before has left in shuffles."""
    ship(spark)
    released(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not find toxic. A null or empty text has an empty text's score; repeated rows go or stay
    together; an empty table stays empty. The network learns from the labelled rows of the table `documents`."""
    begin(spark)
    return toxicity.reject_toxic(docs, registry.toxic_network(docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id. Null and empty texts are one group; rows with null
    ids stay; an empty table stays empty."""
    begin(spark)
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items; those that are mostly such passages go. Null, empty and clean texts stay as they
    are, and n_chars follows a changed text."""
    begin(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by source and by quality label. A null source is a source; documents without words take
    part with size 0; an empty table stays empty."""
    begin(spark)
    rows = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__whole"))
    mixed = mixing.mix(registry.with_quality(rows, table(spark, sf_dir, "labels")), weight=F.col("__weight"))
    return mixed.filter(F.col("copies") > 0).withColumn("__n", F.explode(F.sequence(F.lit(1), "copies"))).select(*[F.col("__whole").getField(c).alias(c) for c in docs.columns])


def place_on_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shards, by id; a null id has a shard as well."""
    begin(spark)
    return sharding.place(docs, registry.SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", place_on_shards),
]

#: SQL can express neither the network nor the fingerprints; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages. Each stage's rows are written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
