"""Aggregates over rows and corpora: quality, reviews, groups of documents, vocabulary that profiles lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelore.config import CONFIG
from pricelore.functions import text as tx


def price_summary(rows: DataFrame) -> DataFrame:
    """Products a document: codes, and what they cost, counting each code once by its first row."""
    w = Window.partitionBy("source_file", "art_no").orderBy("page_number", "line_no")
    first = rows.filter((F.col("art_no") != "") & F.col("price").isNotNull()).withColumn("n", F.row_number().over(w)).filter("n = 1")
    return first.groupBy("source_file").agg(F.count("*").alias("n_codes"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.sum(F.round(F.col("price") * 100).cast("long")).alias("sum_cents"))


def parser_metrics(rows: DataFrame) -> DataFrame:
    """How well a document was read, from 0 rows on; and a score of it that leaves conflicts of codes out. run_scores gives the
    one by which ways to read a document compete."""
    out = rows.groupBy("source_file").agg(
        F.count("*").alias("n_rows"), F.countDistinct(F.when(F.col("art_no") != "", F.col("art_no"))).alias("n_codes"),
        F.sum(((F.col("art_no") != "") & F.col("price").isNotNull()).cast("int")).alias("n_key"), F.sum(F.col("needs_review").cast("int")).alias("n_review"),
    )
    out = out.withColumns({"unique_code_ratio": F.col("n_codes") / F.col("n_rows"), "key_fields_rate": F.col("n_key") / F.col("n_rows"), "review_rate": F.col("n_review") / F.col("n_rows")})
    # A review rate of nothing counts as one that isn't known.
    score = F.col("key_fields_rate") + 0.6 * F.col("unique_code_ratio") - 0.5 * F.when(F.col("n_review") == 0, 1.0).otherwise(F.col("review_rate"))
    ok = (F.col("n_rows") >= CONFIG.rows_min) & (F.col("unique_code_ratio") >= CONFIG.unique_ratio_min) & (F.col("key_fields_rate") >= CONFIG.key_rate_min)
    return out.withColumns({"run_score": score, "ok": ok})


def run_scores(rows: DataFrame, duplicates: DataFrame) -> DataFrame:
    """parser_metrics with the rate of conflicting codes among exported rows, and its term in the score. `duplicates` are the
    duplicate_conflicts of the rows."""
    exported = rows.groupBy("source_file").agg(F.count_if("exported").alias("n_exported"))
    conflicts = duplicates.filter("n_variants > 1").groupBy("source_file").agg(F.count("*").alias("n_conflicts"))
    df = parser_metrics(rows).join(exported, "source_file").join(conflicts, "source_file", "left").withColumn("n_conflicts", F.coalesce("n_conflicts", F.lit(0)))
    df = df.withColumn("duplicate_conflicts_rate", F.when(F.col("n_exported") > 0, F.col("n_conflicts") / F.col("n_exported")).otherwise(0.0))
    return df.withColumn("run_score", F.col("run_score") - 0.8 * F.col("duplicate_conflicts_rate")).drop("n_exported")


def review_reasons(rows: DataFrame) -> DataFrame:
    """The notes of rows that need review or aren't exported, most frequent first, of equals the one that came first."""
    notes = rows.filter("needs_review OR NOT exported").select("source_file", "page_number", "line_no", F.posexplode(F.split(F.when(F.col("notes") == "", "unspecified").otherwise(F.col("notes")), "; ")).alias("i", "note")).filter("note <> ''")
    few = notes.groupBy("note").agg(F.count("*").alias("n"), F.min(F.struct("source_file", "page_number", "line_no", "i")).alias("__first"))
    return few.orderBy(F.col("n").desc(), "__first").limit(20).drop("__first")


def code_quality(rows: DataFrame) -> DataFrame:
    """Of each document the rows whose code differs from the one in the text's code field, or is of digits alone beside one; and
    those whose code has been corrected."""
    field = F.regexp_extract("line", r"(?i)Art\.?\s*no\.?\s*:\s*([A-Z0-9]+(?:-[A-Z0-9]+)*)", 1)
    df = rows.withColumns({"__code": tx.canonical_code(F.col("art_no")), "__field": tx.canonical_code(field)})
    df = df.withColumn("__numeric", F.col("__code").rlike(r"^\d{6,}$") & (F.col("__field") != ""))
    bad = F.col("__numeric") | (F.col("__code") != "") & (F.col("__field") != "") & (F.col("__code") != F.col("__field"))
    return df.groupBy("source_file").agg(F.count_if(bad).alias("bad_art_no_count"), F.count_if(F.col("notes").contains("art_no_corrected")).alias("corrected_art_no_count"), F.coalesce(F.max("__numeric"), F.lit(False)).alias("suspicious_numeric_art_no_seen"))


def run_report(judged: DataFrame, rows: DataFrame) -> DataFrame:
    """One row a document with the figures of a run. judged: all parsed lines with their discard_reason, noise_class and hard_reason; rows: the
    exported and reviewed ones with the verdicts on duplicates (apply_duplicates)."""
    kept = (F.col("discard_reason") == "") & (F.col("noise_class") == "")
    seen = F.col("discard_reason") == ""
    lines = judged.groupBy("source_file").agg(
        F.countDistinct("page_number").alias("pages_processed"), F.count("*").alias("rows_candidate"), F.count_if(seen).alias("rows_after_parsing"), F.count_if(kept).alias("rows_after_filters"),
        *[F.count_if(F.col("discard_reason") == r).alias(f"discard_{r}") for r in ("header_like", "toc_year_price", "bad_id", "dimension_line", "no_price")],
        F.count_if(seen & (F.col("noise_class") != "")).alias("noise_total"), F.count_if(seen & (F.col("noise_class") == "noise_header_eur1")).alias("eur_1_kills"),
        F.count_if(kept & (F.col("hard_reason") == "numeric_dimension_artno")).alias("numeric_dimension_artno"), F.count_if(kept & (F.col("hard_reason") == "hard_legal")).alias("hard_legal"),
        F.sum(F.size(F.filter("toks", lambda t: t["price"] & t["year"]))).alias("year_price_blocked"),
    )
    out = F.col("exported")
    own = rows.groupBy("source_file").agg(
        F.count_if(out).alias("rows_exported"), F.count_if("needs_review").alias("rows_needs_review"), F.count_if("noise").alias("rows_noise"), F.count_if(F.col("art_no") == "").alias("missing_art_no"),
        F.count_if(out & F.col("price").isNull()).alias("missing_price"), F.count_if(out & ((F.col("name") == "") | F.col("price").isNull())).alias("partial_export"),
        F.countDistinct(F.when(F.col("art_no") != "", F.col("art_no"))).alias("codes"), F.avg("confidence").alias("mean_confidence"),
    )
    variant = F.struct(F.lower(F.btrim("name")), F.coalesce(F.col("price").cast("string"), F.lit("")))
    codes = rows.filter(F.col("dup_rank").isNotNull()).groupBy("source_file", "art_no").agg(F.count("*").alias("n"), F.countDistinct(variant).alias("v"))
    codes = codes.groupBy("source_file").agg(F.count_if(F.col("n") > 1).alias("duplicate_art_no_count"), F.count_if(F.col("v") > 1).alias("duplicate_conflicts_count"))
    df = lines.join(own, "source_file", "left").join(codes, "source_file", "left").join(code_quality(rows), "source_file", "left")
    zero = [c for c, t in df.dtypes if t == "bigint"]
    return df.fillna(0, zero).fillna(False, ["suspicious_numeric_art_no_seen"])


def discard_samples(judged: DataFrame, most: int = 5) -> DataFrame:
    """The first lines of each document and reason for which rows were discarded or are noise."""
    reason = F.when(F.col("discard_reason") != "", F.col("discard_reason")).otherwise(F.col("noise_class"))
    w = Window.partitionBy("source_file", "reason").orderBy("page_number", "line_no")
    df = judged.withColumn("reason", reason).filter("reason <> ''").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    return df.select("source_file", "reason", "n", F.substring("line", 1, 200).alias("sample"))


def risk_flags(documents: DataFrame) -> DataFrame:
    """What may be wrong with a document, of n_pages_read, text_len, needs_ocr (any page) and has_stopword (any page)."""
    low = F.col("text_len") < CONFIG.text_len_min
    flags = F.array_compact(F.array(F.when(low, "low_text"), F.when(low & F.col("needs_ocr"), "scanned_likely"), F.when(low & F.col("has_stopword"), "intro_only")))
    return documents.withColumn("risk_flags", F.when(F.col("n_pages_read") == 0, "no_content").otherwise(F.array_join(flags, ";")))


def document_signature(parser, columns, density, currencies):
    """The group that a document belongs to: the way to read it, and buckets of its columns, its digits and its currencies."""
    wide = F.when(columns >= 6, "c6p").when(columns >= 4, "c4").when(columns >= 2, "c2").when(columns == 1, "c1").otherwise("c0")
    digits = F.when(density >= 0.08, "nhigh").when(density >= 0.04, "nmid").otherwise("nlow")
    money = F.when(currencies >= 2, "cmulti").when(currencies == 1, "csingle").otherwise("cnone")
    return F.concat_ws("_", parser, wide, digits, money)


def document_groups(documents: DataFrame, most: int = 3) -> DataFrame:
    """Documents (source_file, parser, table_columns, numeric_density, currencies, and figures) in groups by their signature: size, mean figures and the
    first examples, the largest group first."""
    df = documents.withColumn("group_id", document_signature(F.col("parser"), F.col("table_columns"), F.col("numeric_density"), F.col("currencies")))
    figures = [c for c in ("numeric_density", "table_columns", "marker_score", "table_score", "code_price_score", "price_count") if c in df.columns]
    groups = df.groupBy("group_id").agg(F.count("*").alias("size"), *[F.round(F.avg(c), 4).alias(f"avg_{c}") for c in figures])
    w = Window.partitionBy("group_id").orderBy("source_file")
    few = df.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_list("source_file")), ",").alias("examples"))
    return groups.join(few, "group_id").orderBy(F.col("size").desc(), "group_id")


def is_label_like(line):
    """Whether a line looks like a label: it ends with a colon, has wide gaps, or is of two to four words in capitals."""
    capitals = (line == F.upper(line)) & line.rlike("[A-Z]") & F.size(F.regexp_extract_all(line, F.lit("[A-Za-z]{3,}"), F.lit(0))).between(2, 4)
    return (F.length(line) <= 90) & (line != "") & (line.endswith(":") | line.contains("  ") | line.contains("\t") | capitals)


def unknown_words(lines: DataFrame, known: DataFrame, stopwords: tuple[str, ...], most: int = 20) -> DataFrame:
    """The words of label-like lines without prices that no dictionary has (known: word), with counts, the language that they hint at, and
    three examples."""
    from pricelore.functions import labels as lb

    clean = F.btrim("line")
    some = lines.filter((F.length(clean) <= 120) & ~F.col("line").rlike(r"\d+[.,]\d{2}") & is_label_like(clean))
    words = some.select("source_file", "page_number", "line_no", clean.alias("snippet"), F.explode(F.regexp_extract_all("line", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("w")).withColumn("word", F.lower("w"))
    words = words.filter(~F.col("word").isin(*stopwords)).join(known, "word", "left_anti")
    counts = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(most)
    w = Window.partitionBy("word").orderBy("source_file", "page_number", "line_no")
    few = words.withColumn("i", F.row_number().over(w)).filter("i <= 3").groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "snippet"))), lambda x: x["snippet"]), " | ").alias("examples"))
    return counts.join(few, "word").withColumn("language", lb.language(F.col("word")))


def label_candidates(lines: DataFrame, least: int = 3, most: int = 30) -> DataFrame:
    """Label-like lines of six words at most that come up often."""
    clean = F.btrim("line")
    some = lines.filter(is_label_like(clean) & (F.size(F.split(clean, r"\s+")) <= 6)).groupBy(clean.alias("label")).agg(F.count("*").alias("n"))
    return some.filter(F.col("n") >= least).orderBy(F.col("n").desc(), "label").limit(most)


def header_candidates(lines: DataFrame, most: int = 15) -> DataFrame:
    """The lines without prices that look like headings, most frequent first."""
    clean = F.btrim("line")
    looks = (F.length("line") <= 120) & ((F.size(F.filter(F.split("line", r"\s{2,}|\t|\|"), lambda x: F.btrim(x) != "")) >= 2) | (clean == F.upper(clean)) & clean.rlike("[A-Z]"))
    some = lines.filter(looks & ~F.col("line").rlike(r"\d+[.,]\d{2}")).groupBy(clean.alias("header")).agg(F.count("*").alias("n"))
    return some.orderBy(F.col("n").desc(), "header").limit(most)


def column_stats(words: DataFrame, x_bin: int = 20, least: int = 8) -> DataFrame:
    """How many pages have how many columns: bins of x with enough words."""
    bins = words.groupBy("source_file", "page_number", F.floor(F.col("x0") / x_bin).alias("xb")).agg(F.count("*").alias("n"))
    pages = bins.groupBy("source_file", "page_number").agg(F.count_if(F.col("n") >= least).alias("n_columns"))
    return pages.groupBy("source_file", "n_columns").agg(F.count("*").alias("n_pages"))


def profile_terms(lines: DataFrame, dictionary: dict, least: int = 2) -> DataFrame:
    """The words of headings that come up at least twice, by the field they name, without those that the dictionary has for it: what a
    profile for these documents would add. Headings are short lines in capitals or with wide gaps, with two words and no price."""
    from pricelore.functions import labels as lb

    line = F.col("line")
    heading = (F.length(line) <= 80) & ~line.rlike(r"\b\d{1,7}(?:[.,]\d{2})\b") & (F.size(F.regexp_extract_all(line, F.lit("[A-Za-z]{3,}"), F.lit(0))) >= 2) & (line.contains("  ") | line.contains("\t") | (line == F.upper(line)) & line.rlike("[A-Z]"))
    words = lines.filter(heading).select(F.explode(F.split(F.lower(line), "[^a-z]+")).alias("term")).filter(F.length("term") >= 3)
    found = words.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= least).withColumn("field", lb.field_of(F.col("term"))).filter("field <> ''")
    known = [(f, t) for f, names in dictionary.get("fields", {}).items() for t in lb.terms({"fields": {f: names}})]
    if not known:
        return found.select("field", "term", "n")
    own = lines.sparkSession.createDataFrame(known, "field string, term string")
    return found.join(F.broadcast(own), ["field", "term"], "left_anti").select("field", "term", "n")


def suggested_profile(terms: DataFrame) -> DataFrame:
    """One row: a profile as JSON, of profile_terms."""
    fields = terms.groupBy("field").agg(F.array_sort(F.collect_set("term")).alias("names"))
    return fields.agg(F.to_json(F.struct(F.lit("1.0").alias("version"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "names")))).alias("fields"))).alias("profile"))


def snippets(lines: DataFrame, each: int = 50, most: int = 200) -> DataFrame:
    """Lines of a document for a look at it: the first with codes, prices and headings. A line goes to the first kind that it is of and that
    has room; so kinds depend on how many came before, and a document's lines are taken in order, of each mixture of kinds the first few."""
    line = F.col("line")
    kinds = F.concat(F.when(line.rlike(r"(?i)\bart\.?\s*no\.?"), "a").otherwise(""), F.when(line.rlike(r"\d+[.,]\d{2}"), "p").otherwise(""), F.when(line.rlike(r"(?i)\b(?:code|description|price)\b"), "h").otherwise(""))
    w = Window.partitionBy("source_file", "kinds").orderBy("page_number", "line_no")
    few = lines.withColumn("kinds", kinds).filter("kinds <> ''").withColumn("i", F.row_number().over(w)).filter(F.col("i") <= 3 * each)
    docs = few.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("page_number", "line_no", "line", "kinds"))).alias("l"))
    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("p"), F.lit(0).alias("h"), F.array().cast("array<struct<kind:string,line:string>>").alias("out"))

    def step(s, x):
        room = {k: x["kinds"].contains(k) & (s[k] < each) for k in "aph"}
        kind = F.when(room["a"], "a").when(room["p"], "p").when(room["h"], "h")
        own = F.array(F.struct(kind.alias("kind"), x["line"].alias("line")))
        return F.struct(*[(s[k] + F.coalesce(kind == k, F.lit(False)).cast("int")).alias(k) for k in "aph"], F.when(kind.isNotNull(), F.concat(s["out"], own)).otherwise(s["out"]).alias("out"))

    chosen = docs.select("source_file", F.slice(F.aggregate("l", start, step, lambda s: s["out"]), 1, most).alias("o"))
    return chosen.select("source_file", F.posexplode("o").alias("n", "s")).select("source_file", "n", "s.kind", "s.line")


def corpus_report(documents: DataFrame) -> DataFrame:
    """One row a document with the public columns of a corpus scan. documents: source_file, page_count, pages_sampled, triage counts, currencies as a
    map, numeric_density, price_count, table_columns, numeric_line_ratio, table_score, recommended_parser and risk_flags."""
    from pricelore.functions import labels as lb

    marks = F.format_string("art_no=%d;code=%d;rrp=%d;size=%d", "art_no_count", "code_count", "rrp_count", "size_count")
    table = F.format_string("columns=%d;numeric_ratio=%.3f;score=%.2f", "table_columns", "numeric_line_ratio", "table_score")
    return documents.select(F.col("source_file").alias("path"), "page_count", F.array_join(F.transform("pages_sampled", lambda p: p.cast("string")), ",").alias("pages_sampled"), marks.alias("marker_hits"), lb.counts_text(F.col("currency_counts")).alias("currency_tokens"), "numeric_density", F.col("price_count").alias("price_pattern_hits"), table.alias("table_likelihood"), "recommended_parser", "risk_flags")


def page_metrics(pages: DataFrame) -> DataFrame:
    """A JSON payload a page with its signals, for a look at a run."""
    names = [c for c in ("n_lines", "price_like_count", "mixed_code_count", "cooccurrence_count", "row_candidate_count", "numeric_density", "table_hint", "table_likelihood", "signal_score", "toc_score", "toc_like", "toc_hard") if c in pages.columns]
    return pages.select("source_file", "page_number", F.to_json(F.struct(*names)).alias("metrics"))


def run_summary(results: DataFrame) -> DataFrame:
    """One row for a run: documents, how they ended, and their rows. results: final_status, rows_exported, review_rows and suspicious_numeric_art_no_seen."""
    status = F.col("final_status")
    return results.agg(
        F.count("*").alias("documents"), F.count_if(status.startswith("CONVERTED")).alias("converted"), F.count_if(status.startswith("REVIEW_ONLY")).alias("review_only"), F.count_if(status.startswith("FAILED")).alias("failed"),
        F.count_if(status.startswith("SKIPPED")).alias("skipped"), F.coalesce(F.sum("rows_exported"), F.lit(0)).alias("rows_exported"), F.coalesce(F.sum("review_rows"), F.lit(0)).alias("review_rows"), F.coalesce(F.max("suspicious_numeric_art_no_seen"), F.lit(False)).alias("suspicious"),
    )


def corpus_groups(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """Documents grouped by a signature of their profile, digits and whether they name currencies. document_groups has the full signature."""
    docs = pages.groupBy("source_file").agg(F.sum("digits").alias("digits"), F.sum(F.col("chars") + F.col("n_lines") - 1).alias("chars"), F.sum("currency_tokens").alias("currency"), F.count("*").alias("n_pages"))
    docs = docs.join(profiles.select("source_file", "profile"), "source_file")
    density = F.col("digits") / F.col("chars")
    bucket = F.when(density >= 0.08, "nhigh").when(density >= 0.04, "nmid").otherwise("nlow")
    signature = F.concat_ws("_", "profile", bucket, F.when(F.col("currency") > 0, "cany").otherwise("cnone"))
    docs = docs.withColumn("signature", signature)
    groups = docs.groupBy("signature").agg(F.count("*").alias("n_docs"), F.sum("n_pages").alias("n_pages"))
    # Ranks are cut before the shuffle, so that no group passes through one task.
    w = Window.partitionBy("signature").orderBy("source_file")
    few = docs.withColumn("n", F.row_number().over(w)).filter("n <= 3").groupBy("signature").agg(F.array_join(F.array_sort(F.collect_list("source_file")), ",").alias("examples"))
    return groups.join(few, "signature")


def missing_labels(lines: DataFrame, known: DataFrame, stopwords: tuple[str, ...] = ("the", "and", "of", "about", "for")) -> DataFrame:
    """Words of lines without numbers that no label dictionary has, with counts; `known` has a column word."""
    words = lines.filter(~F.col("line").rlike(r"\d")).select(F.explode(F.split(F.lower("line"), "[^a-z]+")).alias("word")).filter((F.length("word") >= 3) & ~F.col("word").isin(*stopwords))
    return words.join(known, "word", "left_anti").groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(20)


def code_patterns(rows: DataFrame) -> DataFrame:
    """Kinds of codes, with counts and the first of each."""
    return rows.filter("art_no <> ''").withColumn("pattern", tx.code_pattern(F.col("art_no"))).groupBy("pattern").agg(F.count("*").alias("n"), F.countDistinct("art_no").alias("n_codes"), F.min("art_no").alias("example"))


def price_formats(info: DataFrame) -> DataFrame:
    """Which separators prices are written with."""
    tokens = info.select(F.explode(F.transform("candidates", lambda c: c.getField("token"))).alias("token"))
    kind = F.when(F.col("token").rlike(r"\..*,"), "dot_comma").when(F.col("token").rlike(r",.*\."), "comma_dot").when(F.col("token").contains(","), "comma").when(F.col("token").contains("."), "dot").otherwise("none")
    return tokens.groupBy(kind.alias("format")).agg(F.count("*").alias("n"), F.min("token").alias("smallest"), F.max("token").alias("largest"))
