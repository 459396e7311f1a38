"""Whole runs: a folder of documents to sheets of products, reports, and a summary."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelore.config import CONFIG
from pricelore.functions import labels as lb
from pricelore.functions import patterns as rx
from pricelore.operators import blocks as bl
from pricelore.operators import choice as ch
from pricelore.operators import lines as ln
from pricelore.operators import pages as pg
from pricelore.operators import reports as rp
from pricelore.operators import rows as rw
from pricelore.operators import tables as tb
from pricelore.sinks import writers
from pricelore.sources import files
from pricelore.sources.catalog import page_lines, parse_page_range

LOGGER = logging.getLogger(__name__)
COLUMNS = ("source_file", "page_number", "line_no", "parser", "section", "art_no", "name", "price", "exported", "needs_review", "notes", "noise")


#: The ways of reading by their names: what each reads, lines as they are normalised or as they were read, and how it cuts them into blocks.
PARSERS = {"marker": bl.marker_blocks, "table_based": tb.table_lines, "code_price_based": lambda lines: bl.code_price_blocks(ln.line_info(lines))}


def segmenter(name: str = "marker"):
    """The segmentation of a way of reading."""
    if name not in PARSERS:
        raise ValueError(f"unknown parser: {name}")
    return PARSERS[name]


def diagnostics(results: DataFrame, top_pages: DataFrame, attempts: DataFrame, document: str) -> dict[str, DataFrame]:
    """The sheets of one document's diagnosis: what came of it, the pages that were read, and the attempts."""
    of = lambda df: df.filter(F.col("source_file") == document)
    return {"SUMMARY": writers.summary(of(results)).orderBy("n").select("key", "value"), "TOP_K": of(top_pages).orderBy("page_rank"), "ATTEMPTS": of(attempts).orderBy("way_rank")}


def rows_of(lines: DataFrame, raw: DataFrame, sections: DataFrame) -> dict[str, DataFrame]:
    """The rows of each way of reading. raw: lines as they were read, with their gaps; sections: section_carry."""
    own = sections.select("source_file", "page_number", "section")
    shared = lambda df, parser: df.withColumn("parser", F.lit(parser)).join(own, ["source_file", "page_number"], "left").select(*COLUMNS)
    coded = rw.ensure_prices(rw.apply_duplicates(rw.export_rows(ln.parse_rows(ln.line_info(lines)))))
    merged = bl.split_merged(bl.attach_continuations(bl.marker_blocks(lines)))
    marked = bl.marker_rows(merged).withColumn("price", F.col(f"price_{CONFIG.target_currency.lower()}"))
    priced = F.coalesce(*[F.col(f"price_{c.lower()}") for c in rx.ROW_CURRENCIES]).isNotNull()
    marked = marked.withColumn("exported", (F.col("art_no") != "") & priced)
    marked = marked.withColumns({"needs_review": ~F.col("exported"), "noise": F.lit(False), "notes": F.concat_ws("; ", *[F.when(F.col(c) != "", F.col(c)) for c in ("parse_notes", "note")], F.when(F.col("art_no") == "", "missing_art_no"), F.when(~priced, "missing_price"))})
    tabled = tb.table_rows(raw).withColumn("exported", (F.col("art_no") != "") & F.col("price").isNotNull())
    tabled = tabled.withColumns({"needs_review": ~F.col("exported"), "noise": F.lit(False), "notes": F.concat_ws("; ", F.when(F.col("art_no") == "", "missing_art_no"), F.when(F.col("price").isNull(), "missing_price"))})
    return {"marker": shared(marked, "marker"), "table_based": shared(tabled, "table_based"), "code_price_based": shared(coded, "code_price_based")}


def converted(pages: DataFrame, store=lambda name, df: df) -> dict[str, DataFrame]:
    """What a run makes of pages (source_file, page_number, text, and words where a reader has them): rows by the best way of each document that can
    be read, results, and attempts. `store` may write a step's table and read it back: later steps read each of them several times."""
    texts = pages.filter(F.col("page_number").isNotNull())
    lines = page_lines(texts)
    raw = texts.select("source_file", "page_number", F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("line_no", "line")).filter(F.col("line").rlike(r"\S"))
    placed = texts.select("source_file", "page_number", F.explode("words").alias("w")).select("source_file", "page_number", "w.text", "w.x0", "w.top")
    triage = store("triage", pg.triage_with_tables(lines, pg.table_metrics(placed)))
    readable = triage.filter(F.col("decision").isin("OK", "FORSE")).select("source_file")
    own = rows_of(lines, raw, pg.section_carry(lines))
    every = store("rows", own["marker"].unionByName(own["table_based"]).unionByName(own["code_price_based"]).join(readable, "source_file", "left_semi"))
    n_pages = files.page_counts(texts).select("source_file", F.col("n_pages").alias("eval_pages"))
    attempts = ch.judged(ch.metrics(every.filter("NOT noise")).join(n_pages, "source_file"))
    order = triage.select("source_file", ch.order_of_ways(F.col("profile"), F.col("art_no_count"), F.col("rrp_count")).alias("ways"))
    tried = store("attempts", ch.tried(attempts, order))
    best = ch.best_runs(tried, triage)
    rows = every.join(best.select("source_file", "parser"), ["source_file", "parser"])
    counts = rows.groupBy("source_file").agg(F.count_if("exported").alias("rows_exported"), F.count_if("needs_review").alias("review_rows"))
    results = triage.join(best.select("source_file", "parser", "score", "final_status"), "source_file", "left").join(counts, "source_file", "left")
    status = F.coalesce("final_status", F.when(F.col("decision") == "NO", "SKIPPED").otherwise("FAILED"))
    results = results.withColumn("final_status", status).fillna(0, ["rows_exported", "review_rows"])
    return {"rows": rows, "results": results, "attempts": tried.withColumn("attempt", ch.attempt_text())}


def needs_suggestions(results: DataFrame) -> DataFrame:
    """The documents for which a profile is suggested: those that could not be read for certain."""
    return results.filter((F.col("decision") != "OK") | ~F.col("final_status").startswith("CONVERTED"))


def run_folder(spark: SparkSession, folder: str, out: str, pattern: str = "*.txt", recursive: bool = False, page_range: str | None = None, run: str = "run") -> DataFrame:
    """Read a folder, write sheets, reports, suggested profiles and a manifest under out, and give the summary. Pages are read once and stored; files that can't
    be read are in the triage report with their errors."""
    found = files.files(spark, folder, pattern, recursive)
    key = files.fingerprint(found, "1", page_range=page_range, pattern=pattern, recursive=recursive)
    pages = files.cached(spark, f"{out}/pages", key, lambda: files.read_pages(found, parse_page_range(page_range)))

    def store(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/steps/{name}")
        return spark.read.parquet(f"{out}/steps/{name}")

    parts = converted(pages, store)
    written = writers.write_sheets(parts["rows"], f"{out}/sheets")
    LOGGER.info("sheets written: %s", written)
    errors = files.error_rows(pages).withColumn("final_status", F.lit("FAILED"))
    writers.write_triage_report(parts["results"].unionByName(errors, allowMissingColumns=True), parts["attempts"], f"{out}/reports")
    unsure = needs_suggestions(parts["results"]).select("source_file")
    writers.write_json(rp.suggested_profile(rp.profile_terms(page_lines(pages.join(unsure, "source_file", "left_semi").filter("page_number IS NOT NULL")), lb.DEFAULT)), f"{out}/profile")
    writers.write_json(writers.manifest(spark, found, {"target_currency": CONFIG.target_currency, "mode": CONFIG.export_mode, "pages": page_range}, run), f"{out}/manifest")
    return rp.run_summary(parts["results"].withColumn("suspicious_numeric_art_no_seen", F.lit(False)))


def main(args: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pricelore", description="Read price lists of a folder into sheets of products.")
    parser.add_argument("folder")
    parser.add_argument("out")
    parser.add_argument("--pattern", default="*.txt")
    parser.add_argument("--recursive", action="store_true")
    parser.add_argument("--pages", help="such as 2-5,7")
    parser.add_argument("--log-level", default="INFO")
    given = parser.parse_args(args)
    logging.basicConfig(level=given.log_level.upper(), format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    spark = SparkSession.builder.appName("pricelore").getOrCreate()
    run_folder(spark, given.folder, given.out, given.pattern, given.recursive, given.pages).show(truncate=False)


if __name__ == "__main__":
    main()
