"""From parsed lines to products: reasons to discard, noise, validation, confidence, and the way to export or review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelore.config import CONFIG
from pricelore.functions import patterns as rx
from pricelore.functions import text as tx
from pricelore.operators.lines import settled


def is_product():
    """Whether a row has a valid product code."""
    return tx.is_valid_code(F.col("art_no"))


#: The mode in which rows without a name or a price may stay for review.
PARTIAL = "partial_ok"
#: Reasons that no code and price outweigh, and those that only leave a mark.
HARD = ("missing_art_no", "missing_price", "hard_art_no", "numeric_dimension_artno", "dim_only_row", "header_like_strict")
DOUBTFUL = ("hard_legal", "dim_only_row", "header_like_strict")


def discard_reason(rows: DataFrame, mode: str = CONFIG.export_mode) -> DataFrame:
    """Why a row is no product at all; '' if it may be one. Rows with any candidate for a code or a price aren't discarded
    for want of a code; unless partial rows may stay, those that don't look priced are."""
    any_candidate = (F.size("code_candidates") > 0) | (F.size("price_candidates") > 0)
    header = ~F.col("line").rlike(rx.NUMBER) & F.col("line").rlike(r"(?i)\b(?:code|description|price)\b")
    reason = (
        F.when(header, "header_like")
        .when(F.col("toc_line"), "toc_year_price")
        .when((F.col("art_no") == "") & ~any_candidate, "bad_id")
        .when((F.col("art_no") == ""), "")
        .when(F.col("dimension_line") & ~F.col("price_like"), "dimension_line")
        .when(F.lit(mode != PARTIAL) & ~F.col("price_like"), "no_price")
        .otherwise("")
    )
    return settled(rows.withColumn("discard_reason", reason))


def noise_class(rows: DataFrame) -> DataFrame:
    """The kind of noise that a row is; '' if none. The first kind that fits holds."""
    line, low = F.col("line"), F.lower("line")
    n_tokens = F.size("tokens")
    alpha_tokens = F.size(F.filter("tokens", lambda t: t.rlike("[A-Za-z]")))
    alpha_chars = F.length(F.regexp_replace(line, "[^A-Za-z]", ""))
    title = F.size(F.filter("tokens", lambda t: t.rlike("^[A-Z][a-z]+$")))
    index_number = F.exists("tokens", lambda t: t.rlike(r"^\d{1,9}$") & t.try_cast("int").between(10, 250))
    price_like = F.col("price_like") | (F.size("price_candidates") > 0) | F.col("price").isNotNull()
    has_codes, codes = F.size("code_candidates") > 0, F.size("code_candidates")
    legend = F.col("legend_hits") >= 2
    small = F.array_max(F.transform("price_candidates", lambda c: c.getField("value"))) <= 3
    kind = (
        F.when(~is_product() & F.col("toc_line"), "noise_toc_line")
        .when(~is_product() & (title >= 2) & index_number & ~F.col("has_currency") & ~has_codes, "noise_index")
        .when(~is_product() & (F.col("is_header") | legend), "noise_header_legend")
        .when(is_product() & legend & (alpha_tokens < 2), "noise_header_legend")
        .when(is_product() & F.col("has_currency") & (line.contains("€") | F.upper(line).contains("EUR")) & small, "noise_header_eur1")
        .when(~is_product() & (low.contains("extra charge") | low.contains("treatment")) & (n_tokens >= 6), "noise_accessory_note")
        .when(~is_product() & (low.contains("anti-stain") | low.contains("antistain")), "noise_accessory_note")
        .when(~is_product() & line.rlike(r"(?i)\b(?:cat|category|sq\.?\s*m|sqm|mq)\b"), "noise_material_metric")
        .when(~is_product() & (line.rlike(r"(?i)\b(?:peso|weight|volume)\b") | line.rlike(r"\bL[1-3]\b")), "noise_weight_dim")
        .when(codes >= 2, "noise_composition")
        .when(~is_product() & (F.col("has_dimension_candidate") | F.col("dimension_line")) & ~price_like, "noise_dimension_block")
        .when(~is_product() & price_like & ((alpha_tokens < 2) | (alpha_chars < 4) | (n_tokens <= 2) & F.col("has_currency")), "noise_price_only")
        .otherwise("")
    )
    return settled(rows.withColumn("noise_class", kind))


def is_dimension_only():
    words = F.filter(F.split("resolved_name", r"\s+"), lambda t: t.rlike("[A-Za-z]") & ~t.rlike(rx.DIMENSION_WORD))
    letters = F.length(F.regexp_replace(F.array_join(words, ""), "[^A-Za-z]", ""))
    return (F.col("has_dimension_candidate") | F.col("line").rlike(rx.DIMENSION_WORD)) & (F.size(words) < 2) & (letters < 4)


def has_signal():
    """Whether anything about a row speaks of a price."""
    return F.col("price").isNotNull() | F.col("price_like") | (F.size("price_candidates") > 0)


def hard_validation(rows: DataFrame, mode: str = CONFIG.export_mode) -> DataFrame:
    """Why a row may not be exported; '' if it may. Unless partial rows may stay, a price and a proper name are asked for as well."""
    reason = (
        F.when(F.col("is_legal"), "hard_legal")
        .when(is_dimension_only(), "dim_only_row")
        .when(F.col("is_header"), "header_like_strict")
        .when(F.col("art_no") == "", "missing_art_no")
        .when(F.col("art_no").rlike(r"^\d+$") & (F.col("dimension_line") | F.col("has_dimension_candidate")), "numeric_dimension_artno")
        .when(~is_product(), "hard_art_no")
    )
    if mode != PARTIAL:
        name = F.btrim("name")
        letters = F.length(F.regexp_replace(name, r"[^\p{L}]", ""))
        reason = reason.when(~has_signal(), "hard_no_price").when(name == "", "hard_no_name").when(~F.length(name).between(3, 90), "hard_name_len").when(letters < 3, "hard_name_alpha")
    return settled(rows.withColumn("hard_reason", reason.otherwise("")))


def score_rows(rows: DataFrame) -> DataFrame:
    """confidence, and whether a row needs review. Rows may have ocr_used and size_unparsed, which cost some."""
    lost = F.when(F.col("art_no") == "", 0.8).otherwise(0.0) + F.when(F.col("name") == "", 0.4).otherwise(0.0) + F.when(F.col("price").isNull(), 0.2).otherwise(0.0)
    review = (F.col("art_no") == "") | (F.col("name") == "")
    if "ocr_used" in rows.columns:
        lost = lost + F.when(F.col("ocr_used"), CONFIG.ocr_penalty).otherwise(0.0)
        review = review | F.col("ocr_used") & F.col("price").isNull()
    if "size_unparsed" in rows.columns:
        lost = lost + F.when(F.col("size_unparsed"), 0.1).otherwise(0.0)
    df = rows.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - lost)))
    return df.withColumn("needs_review", (F.col("confidence") < CONFIG.confidence_threshold) | review)


def export_rows(rows: DataFrame, mode: str = CONFIG.export_mode) -> DataFrame:
    """exported, needs_review, confidence and notes of the rows that are neither discarded nor noise.

    A row with a valid code and a price is exported unless a hard reason holds; every other row needs review. Each note stands once,
    where it first came up.
    """
    df = (score_rows(hard_validation(noise_class(discard_reason(rows, mode)), mode))).filter((F.col("discard_reason") == "") & (F.col("noise_class") == ""))
    hard, product, priced = F.col("hard_reason"), is_product(), F.col("price").isNotNull()
    codes, prices = F.size("code_candidates") > 0, F.size("price_candidates") > 0
    df = df.withColumn("exported", product & priced & ~hard.isin(*HARD))
    strict = F.lit(mode != PARTIAL)
    some = (
        (F.col("dimension_line"), "dimension_line"), (~F.col("price_like"), "no_price_like"),
        (F.col("art_no") == "", "missing_art_no"), (F.col("name") == "", "missing_product_name"), (~priced, "missing_price_eur"),
        (F.col("has_dimension_candidate"), "dim_detected"), (prices, "price_detected"), (codes, "artno_detected"),
        (~product, "invalid_chunk_missing_art_no"), (strict & ~has_signal(), "invalid_chunk_missing_price"), (strict & (F.col("name") == ""), "invalid_chunk_missing_name"), (~prices & ~codes, "no_price_no_artno"),
        (hard != "", hard), (~strict & ~has_signal(), "partial_export_weak_signal"), (~product, "missing_art_no"), (~priced, "missing_price"),
        (F.col("exported") & F.col("dimension_line"), "SOFT_REVIEW:dimension_line"),
    )
    notes = F.array_distinct(F.array_compact(F.array(*[F.when(when, note) for when, note in some])))
    limited = F.when(hard.isin(*DOUBTFUL), F.least("confidence", F.lit(0.3))).otherwise(F.col("confidence"))
    return settled(df.withColumns({"needs_review": ~F.col("exported"), "confidence": limited, "notes": F.array_join(notes, "; ")}))


def row_score(rows: DataFrame):
    """How good a row is among the rows of its code."""
    score = F.when(F.col("name") != "", 3).otherwise(0) + F.when(F.col("price").isNotNull() | F.col("price_like"), 4).otherwise(0) + F.when(F.col("has_currency"), 2).otherwise(0)
    for c in ("designer", "size_raw", "variant", "colli", "section"):
        if c in rows.columns:
            score = score + F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0)
    score = score - F.when(F.col("dimension_line"), 3).otherwise(0) - F.when((F.size(F.split("line", r"\s+")) > 10) & ~F.col("price_like"), 2).otherwise(0)
    return score - F.col("needs_review").cast("int") - (~F.col("exported")).cast("int")


ORDER = ("page_number", "line_no")


def dedup(rows: DataFrame) -> DataFrame:
    """Rows of a document and code ranked by score: the best stays; others become noise or real price conflicts."""
    w = Window.partitionBy("source_file", "art_no").orderBy(F.col("row_score").desc(), *ORDER)
    df = rows.filter(is_product()).withColumn("row_score", row_score(rows)).withColumn("dup_rank", F.row_number().over(w))
    price_like = F.col("price_like") | F.col("price").isNotNull()
    verdict = F.when(F.col("dup_rank") == 1, "best").when(~price_like, "technical_sheet_line").when(F.col("is_header"), "header_noise_conflict").otherwise("real_price_conflict")
    return df.withColumn("dup_verdict", verdict)


def apply_duplicates(rows: DataFrame) -> DataFrame:
    """All rows, with noise, and with exported, needs_review and notes as the verdicts have it: of a code's rows the best stays as it is, lines
    without a price and headings become noise, and other prices are exported with a mark. Rows without a valid code stay as they are."""
    w = Window.partitionBy("source_file", "art_no").orderBy(F.col("row_score").desc(), *ORDER)
    own = rows.withColumn("row_score", F.when(is_product(), row_score(rows)))
    df = own.withColumn("dup_rank", F.when(is_product(), F.row_number().over(w)))
    price_like = F.col("price_like") | F.col("price").isNotNull()
    verdict = F.when(F.coalesce(F.col("dup_rank"), F.lit(1)) == 1, "").when(~price_like, "technical_sheet_line").when(F.col("is_header"), "header_noise_conflict").otherwise("real_price_conflict")
    df = df.withColumn("dup_verdict", verdict)
    real, more = F.col("dup_verdict") == "real_price_conflict", F.col("dup_verdict") != ""
    notes = F.concat_ws("; ", F.when(F.col("notes") != "", F.col("notes")), F.when(real, "SOFT_REVIEW:duplicate_variant"), F.when(more, F.col("dup_verdict")))
    return df.withColumns({"noise": more & ~real, "exported": F.when(more, real).otherwise(F.col("exported")), "needs_review": F.when(more, False).otherwise(F.col("needs_review")), "notes": notes})


def ensure_prices(rows: DataFrame, target: str = CONFIG.target_currency, price_col: str = "price") -> DataFrame:
    """Exported rows without a price in the target currency need review, with a note."""
    missing, note = F.col("exported") & F.col(price_col).isNull(), f"missing_price_{target.lower()}"
    known = F.array_contains(F.split("notes", "; "), note)
    return rows.withColumns({"needs_review": F.col("needs_review") | missing, "notes": F.when(missing & ~known, F.concat_ws("; ", F.when(F.col("notes") != "", F.col("notes")), F.lit(note))).otherwise(F.col("notes"))})


def sheet_order():
    """The order of the sheets: by page, then by section in lower case where rows have one, then by code."""
    return Window.partitionBy("source_file").orderBy("page_number", "art_no", "line_no")


def duplicates_summary(rows: DataFrame, most: int = 20) -> DataFrame:
    """The codes of a document with most rows: how many, the best score, and how many rows each verdict has. rows: apply_duplicates."""
    some = rows.filter(is_product()).groupBy("source_file", "art_no").agg(
        F.count("*").alias("n_rows"), F.max("row_score").alias("best_score"), F.min_by(F.substring("line", 1, 160), "dup_rank").alias("best_line"),
        *[F.count_if(F.col("dup_verdict") == v).alias(v) for v in ("technical_sheet_line", "header_noise_conflict", "real_price_conflict")],
    )
    w = Window.partitionBy("source_file").orderBy(F.col("n_rows").desc(), "art_no")
    return some.filter("n_rows > 1").withColumn("dup_order", F.row_number().over(w)).filter(F.col("dup_order") <= most)


def price_in(currency: str):
    """The price in a currency; euros for any that rows have no column for."""
    known = currency.upper() if currency.upper() in rx.ROW_CURRENCIES else "EUR"
    return F.col(f"price_{known.lower()}")


def has_price():
    return F.coalesce(*[F.col(f"price_{c.lower()}") for c in rx.ROW_CURRENCIES]).isNotNull()


def keep_target(rows: DataFrame, target: str = CONFIG.target_currency, mode: str = CONFIG.export_mode, signal=None) -> DataFrame:
    """Rows with the target currency's price, and without the others. Where partial rows may stay, those without any price do if something
    else speaks of one (signal, a column)."""
    stays = F.lit(False) if signal is None or mode != PARTIAL else ~has_price() & signal
    return currency_filter(rows.filter(price_in(target).isNotNull() | stays), target)


def corrected_codes(rows: DataFrame, text_col: str = "line") -> DataFrame:
    """Codes of six digits or more that differ from the one in the text's code field give way to that, with a note."""
    field = F.regexp_extract(text_col, r"(?i)Art\.?\s*no\.?\s*:\s*([A-Z0-9]+(?:-[A-Z0-9]+)*)", 1)
    wrong = F.col("art_no").rlike(r"^\d{6,}$") & (field != "") & (field != F.col("art_no"))
    return rows.withColumns({"art_no": F.when(wrong, tx.canonical_code(field)).otherwise(F.col("art_no")), "notes": F.when(wrong, F.concat_ws("; ", F.when(F.col("notes") != "", F.col("notes")), F.lit("art_no_corrected"))).otherwise(F.col("notes"))})


def apply_page_gates(rows: DataFrame, gates: DataFrame) -> DataFrame:
    """Rows of pages that aren't running text, with a note on pages that are for review alone. gates: page_gates."""
    own = gates.select("source_file", "page_number", "text_like", "review_only")
    note = F.when(F.col("review_only"), F.concat_ws("; ", F.when(F.col("notes") != "", F.col("notes")), F.lit("page_review_only"))).otherwise(F.col("notes"))
    return rows.join(own, ["source_file", "page_number"]).filter(~F.col("text_like")).withColumn("notes", note).drop("text_like", "review_only")


def duplicate_conflicts(rows: DataFrame) -> DataFrame:
    """Codes of a document with more than one name and price. A missing price counts as a value of its own."""
    variant = F.struct(F.lower(F.btrim("name")), F.coalesce(F.col("price").cast("string"), F.lit("")))
    return rows.filter(is_product()).groupBy("source_file", "art_no").agg(F.count("*").alias("n_rows"), F.countDistinct(variant).alias("n_variants")).filter("n_rows > 1")


def marker_fields(lines: DataFrame) -> DataFrame:
    """Fields of lines in the marker format: colli, sizes, and the last price of each currency."""
    line = F.col("line")
    prices = F.regexp_extract_all(line, F.lit(rx.CURRENCY_PRICE), F.lit(2))
    names = F.regexp_extract_all(line, F.lit(rx.CURRENCY_PRICE), F.lit(1))
    both = F.zip_with(names, prices, lambda n, p: F.struct(F.upper(n).alias("currency"), tx.parse_price(F.regexp_replace(p, "[.,]+$", "")).alias("price")))
    out = lines.withColumns({
        "colli": F.regexp_extract(line, r"(?i)Colli\s*:\s*(\d+)", 1).try_cast("int"),
        "marker_code": tx.canonical_code(F.regexp_extract(line, r"(?i)Art\.?\s*no\.?\s*:\s*([A-Za-z0-9\-]+)", 1)),
        "size_raw": F.regexp_extract(line, r"(?i)Size\s*:\s*(.*)$", 1), "__prices": both,
    }).withColumns({
        "width_cm": tx.extract_dimension(F.col("size_raw"), "W"), "height_cm": tx.extract_dimension(F.col("size_raw"), "H"), "length_cm": tx.extract_dimension(F.col("size_raw"), "L"),
    })

    def last(currency: str):
        priced = F.filter("__prices", lambda p: (p.getField("currency") == currency) & p.getField("price").isNotNull())
        return F.try_element_at(priced, F.lit(-1)).getField("price")

    own = {f"price_{c.lower()}": last(c) for c in rx.ROW_CURRENCIES}
    return out.withColumns(own).drop("__prices")


def currency_filter(priced: DataFrame, target: str = CONFIG.target_currency) -> DataFrame:
    """Only the target currency's price stays."""
    return priced.withColumns({f"price_{c.lower()}": F.when(F.lit(c == target), F.col(f"price_{c.lower()}")) for c in rx.ROW_CURRENCIES})
