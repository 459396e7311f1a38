"""The registered queries of the corpus operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, mixing, packs, secrets, sharding, simhash, substring, tokens, topk, toxicity
from .common import shared_folder, ship, small, stored, table

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def with_quality(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with __weight, a document's weight in the mix: 1 if its label says good, 0.5 if bad, 0.75 where it has none. Of several
    labels of an id the best counts."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__labelled")).agg(F.max("quality").alias("__quality"))
    few = small(known)
    weight = F.when(F.col("__quality") == 1, 1.0).when(F.col("__quality") == 0, 0.5).otherwise(0.75)
    out = rows.join(known if few is None else few, F.col("doc_id") == F.col("__labelled"), "left").withColumn("__weight", weight).drop("__labelled", "__quality")
    # A mix reads its rows three times: where they have been shuffled for the join, once is enough.
    return stored(out, "weighted") if few is None else out


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    # Words and digests are taken from the texts once, and rows without texts are mixed.
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.size_of(text).alias("words"), F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("digest"))
    rows = stored(with_quality(rows, table(spark, sf_dir, "labels")), "sizes")
    return mixing.mix(rows, weight=F.col("__weight"), size=F.col("words"), tie=F.col("digest")).select("doc_id", *mixing.MADE)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return secrets.find_secrets(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def toxic_network(docs: DataFrame, sf_dir: str) -> toxicity.Network:
    spark = docs.sparkSession
    return toxicity.train(*toxicity.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxic_network(docs, sf_dir))
    return scored.select("doc_id", (toxicity.crc_remainder("doc_id") == 0).alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, SHARDS).select("doc_id", sharding.slot_of(F.col("doc_id")).alias("slot"), "shard")


def op10_token_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    path = f"{shared_folder(spark)}/packs-{uuid.uuid4().hex}"
    packs.write_packs(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"))
    return packs.read_packs(spark, path)


def queries():
    return {f.__name__: f for f in (op1_token_counts, op2_mix_sources, op3_secret_scan, op4_toxicity, op5_decontamination, op6_simhash, op7_top_k, op8_substring_dedup, op9_sharding, op10_token_packs)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix_sources": mixing.ORACLE,
        "op5_decontamination": decontam.ORACLE,
        "op7_top_k": topk.ORACLE,
        "op9_sharding": sharding.oracle(SHARDS),
    }
