"""The registered queries of the catalogue engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelore.functions import patterns as rx
from pricelore.functions import text as tx
from pricelore.operators import lines as ln
from pricelore.operators import pages as pg
from pricelore.operators import reports as rp
from pricelore.operators import rows as rw
from pricelore.plans import oracle, reading
from pricelore.sources.catalog import catalog_lines

__all__ = ["oracle_sql", "queries"]
KEY = ("source_file", "page_number", "line_no")


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.line_info(catalog_lines(spark, sf_dir))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.parse_rows(info(spark, sf_dir))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rw.hard_validation(rw.noise_class(rw.discard_reason(parsed(spark, sf_dir))))


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rw.export_rows(parsed(spark, sf_dir))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.page_signals(info(spark, sf_dir))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_lines(spark, sf_dir).select(*KEY, F.posexplode(tx.tokenize(F.col("line"))).alias("token_idx", "token"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as words with positions."""
    return tokens(spark, sf_dir).select(*KEY, F.col("token").alias("text"), (F.col("token_idx") * 40).cast("double").alias("x0"), (F.col("line_no") * 10).cast("double").alias("top"))


def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(tx.split_lines(tx.normalize_text(F.col("text")))).alias("line_no", "line"))


def known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.split(F.lower("p_type"), " ")).alias("word")).distinct()


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql() | reading.oracle_sql()


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def queries():
    i, r, j, x, s, c, t = info, parsed, judged, exported, signals, catalog_lines, tokens
    product = (*KEY, "art_no", "name", "price", "confidence", "notes")
    return {
        "price_summary": lambda a, d: rp.price_summary(r(a, d)),
        "normalize_lines": normalize_lines,
        "tokenize": t,
        "token_classes": lambda a, d: t(a, d).groupBy(tx.classify_token(F.col("token")).alias("token_class")).agg(F.count("*").alias("n"), F.countDistinct("token").alias("n_distinct")),
        "parse_numbers": lambda a, d: t(a, d).groupBy("token").agg(F.count("*").alias("n")).withColumn("number", tx.parse_number(F.col("token"))),
        "code_tokens": lambda a, d: t(a, d).groupBy(tx.canonical_code(F.col("token")).alias("code"), tx.is_valid_code(F.col("token")).alias("is_valid"), tx.is_plausible_code(F.col("token")).alias("is_plausible")).agg(F.count("*").alias("n")),
        "line_flags": lambda a, d: longs(i(a, d), "number_count", "best", "code_hits").select(*KEY, "has_currency", "measure_context", "dimension_line", "price_like", "toc_line", "number_count", "best", "code_hits", "max_value"),
        "best_price_per_line": lambda a, d: i(a, d).filter("best > 0").select(*KEY, F.array_max("candidates").getField("token").alias("price_token"), F.col("best").alias("score")),
        "price_candidates": lambda a, d: i(a, d).select(*KEY, F.explode("price_candidates").alias("p")).select(*KEY, (-F.col("p.minus_i")).alias("token_idx"), "p.token", "p.value", "p.score"),
        "resolved_fields": lambda a, d: ln.resolve_fields(i(a, d)).select(*KEY, F.col("best_price.token").alias("best_price"), F.col("best_code.token").alias("best_code"), "resolved_name", "has_dimension_candidate"),
        "toc_lines": lambda a, d: longs(i(a, d).filter("toc_line").withColumn("n_pairs", F.size("toc_pairs")), "year_hits", "short_numbers", "n_pairs").select(*KEY, "year_hits", "short_numbers", "n_pairs"),
        "legal_lines": lambda a, d: c(a, d).withColumns({"legal_hits": tx.count_patterns(F.col("line"), rx.LEGAL), "is_legal": tx.is_legal(F.col("line"))}).filter("legal_hits > 0").drop("line"),
        "header_lines": lambda a, d: c(a, d).withColumns({"is_header": tx.is_header(F.col("line")), "legend_hits": tx.count_words(F.col("line"), rx.LEGEND_WORDS)}).filter("is_header OR legend_hits >= 2").drop("line"),
        "cooccurrence_window": lambda a, d: pg.cooccurrence(i(a, d)).select(*KEY, "cooccurs", "row_candidate"),
        "page_signals": lambda a, d: longs(s(a, d), "legal_hits").select("source_file", "page_number", "n_lines", "digits", "chars", "price_like_count", "mixed_code_count", "cooccurrence_count", "row_candidate_count", "currency_tokens", "legal_hits", "numeric_density", "table_hint", "has_stopword", "signal_score"),
        "toc_pages": lambda a, d: s(a, d).select("source_file", "page_number", "toc_score", "toc_like", "toc_hard"),
        "page_gates": lambda a, d: pg.page_gates(s(a, d)).select("source_file", "page_number", "text_like", "review_only"),
        "signal_score_topk": lambda a, d: pg.top_pages(s(a, d)).select("source_file", "page_number", "page_rank", "signal_score"),
        "discard_reasons": lambda a, d: rw.discard_reason(r(a, d)).groupBy("discard_reason").agg(F.count("*").alias("n")),
        "noise_classes": lambda a, d: rw.noise_class(r(a, d)).select(*KEY, "noise_class"),
        "hard_validation": lambda a, d: rw.hard_validation(r(a, d)).select(*KEY, "hard_reason"),
        "row_scoring": lambda a, d: rw.score_rows(r(a, d)).select(*KEY, "art_no", "name", "price", "confidence", "needs_review"),
        "products": lambda a, d: x(a, d).filter("exported").select(*product),
        "review": lambda a, d: x(a, d).filter("needs_review OR NOT exported").select(*product),
        "guardrail_counts": lambda a, d: j(a, d).groupBy("hard_reason", "noise_class").agg(F.count("*").alias("n")),
        "review_reasons": lambda a, d: rp.review_reasons(x(a, d)),
        "dedup_best": lambda a, d: rw.dedup(x(a, d)).select(*KEY, "art_no", "row_score", "dup_rank", "dup_verdict"),
        "duplicate_conflicts": lambda a, d: rw.duplicate_conflicts(x(a, d)),
        "parser_metrics": lambda a, d: rp.parser_metrics(x(a, d)),
        "run_scores": lambda a, d: rp.run_scores(x(a, d), rw.duplicate_conflicts(x(a, d))),
        "currency_detect": lambda a, d: pg.currency_choice(c(a, d)),
        "marker_fields": lambda a, d: rw.marker_fields(c(a, d)).drop("line"),
        "currency_filter": lambda a, d: rw.currency_filter(rw.marker_fields(c(a, d))).select(*KEY, "price_dkk", "price_sek", "price_nok", "price_eur"),
        "triage_scores": lambda a, d: pg.triage(c(a, d)),
        "triage_decisions": lambda a, d: pg.triage_with_tables(c(a, d), pg.table_metrics(words(a, d))),
        "corpus_groups": lambda a, d: rp.corpus_groups(s(a, d), pg.triage(c(a, d))),
        "missing_labels": lambda a, d: rp.missing_labels(c(a, d), known_words(a, d)),
        "code_patterns": lambda a, d: rp.code_patterns(r(a, d)),
        "price_formats": lambda a, d: rp.price_formats(i(a, d)),
        "section_carry": lambda a, d: pg.section_carry(c(a, d)),
        "sample_counts": lambda a, d: pg.sample_counts(c(a, d).groupBy("source_file").agg(F.max("page_number").alias("n_pages"))),
        "table_metrics": lambda a, d: pg.table_metrics(words(a, d)),
        "stitch_pairs": lambda a, d: pg.stitch_pairs(words(a, d)),
        "line_clusters": lambda a, d: pg.cluster_lines(words(a, d)),
    } | reading.queries(info, parsed, judged, exported, signals, words)
