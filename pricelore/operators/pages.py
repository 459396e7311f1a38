"""Signals of pages and documents, the pages worth reading, and the way to read a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelore.config import CONFIG
from pricelore.functions import patterns as rx
from pricelore.functions import text as tx

PAGE = ("source_file", "page_number")


def cooccurrence(info: DataFrame, reach: int = 1) -> DataFrame:
    """For each line, whether it has a plausible code and a price within `reach` lines."""
    near = Window.partitionBy(*PAGE).orderBy("line_no").rowsBetween(-reach, reach)
    df = info.withColumn("priced_near", F.max(F.col("price_like").cast("int")).over(near) == 1)
    return df.withColumns({"cooccurs": F.col("price_like") & (F.col("code_hits") > 0), "row_candidate": F.col("priced_near") & (F.col("code_hits") > 0)})


def page_signals(info: DataFrame) -> DataFrame:
    """One row a page."""
    df = cooccurrence(info)
    digits = F.length(F.regexp_replace("line", "[^0-9²³¹]", ""))
    sums = {
        "n_lines": F.count("*"), "digits": F.sum(digits), "chars": F.sum(F.length("line")),
        "price_like_count": F.sum(F.col("price_like").cast("int")), "mixed_code_count": F.sum("code_hits"),
        "cooccurrence_count": F.sum(F.col("cooccurs").cast("int")), "row_candidate_count": F.sum(F.col("row_candidate").cast("int")),
        "currency_tokens": F.sum(F.regexp_count("line", F.lit(r"€|\b(?:EUR|DKK|SEK|NOK|USD|GBP|CHF|JPY|CAD|AUD)\b"))),
        "pair_count": F.sum(F.size("toc_pairs")), "year_hits": F.sum("year_hits"), "short_numbers": F.sum("short_numbers"), "plausible_tokens": F.sum("plausible_tokens"),
        "numeric_lines": F.sum((F.regexp_count("line", F.lit(r"\d+(?:[.,]\d+)?")) >= 2).cast("int")),
        "legal_hits": sum((F.max(F.col("line").rlike(p).cast("int")) for p in rx.LEGAL), F.lit(0)),
        "page_legal_words": sum((F.max(F.lower("line").contains(w).cast("int")) for w in rx.PAGE_LEGAL_WORDS), F.lit(0)),
        "has_stopword": F.max((tx.count_words(F.col("line"), rx.STOPWORDS) > 0).cast("int")) == 1,
    }
    pages = df.groupBy(*PAGE).agg(*[c.alias(n) for n, c in sums.items()])
    # The lines of a page stand with a space between them.
    pages = pages.withColumn("numeric_density", F.col("digits") / (F.col("chars") + F.col("n_lines") - 1)).withColumn("table_hint", F.col("numeric_lines") >= CONFIG.table_ratio_min * F.col("n_lines"))
    score = 4.0 * F.col("cooccurrence_count") + 2.0 * F.col("price_like_count") + F.col("mixed_code_count") + 1.5 * F.col("currency_tokens") + 40.0 * F.col("numeric_density") + F.when(F.col("table_hint"), 5.0).otherwise(0.0)
    score = score * F.when(F.col("page_legal_words") > 0, CONFIG.legal_penalty).otherwise(1.0) * F.when(F.col("has_stopword"), CONFIG.stopword_penalty).otherwise(1.0)
    toc = 2 * F.col("pair_count") + F.col("year_hits") + (F.col("short_numbers") >= CONFIG.toc_short_numbers_min).cast("int") + (F.col("pair_count") >= CONFIG.toc_pairs_min).cast("int") + F.when((F.col("mixed_code_count") <= 0) & (F.col("plausible_tokens") == 0), 2).otherwise(0)
    pages = pages.withColumns({"signal_score": score, "toc_score": toc})
    pages = pages.withColumn("toc_like", F.col("toc_score") >= CONFIG.toc_score_min)
    hard = F.col("toc_like") & (F.col("pair_count") >= CONFIG.toc_pairs_min) & (F.col("row_candidate_count") <= CONFIG.toc_hard_rows_max) & (F.col("mixed_code_count") <= CONFIG.toc_hard_codes_max)
    return pages.withColumn("toc_hard", hard)


def page_gates(pages: DataFrame) -> DataFrame:
    """Whether a page is running text, and whether it is for review alone."""
    idle = (F.col("row_candidate_count") == 0) & (F.col("mixed_code_count") == 0)
    text = idle & ((F.col("cooccurrence_count") == 0) & (F.col("price_like_count") < 2) & (F.col("numeric_density") < 0.08) | (F.col("legal_hits") >= 2) & (F.col("cooccurrence_count") == 0) & (F.col("price_like_count") < 3))
    return pages.withColumns({"text_like": text, "review_only": (F.col("legal_hits") >= 2) & ((F.col("cooccurrence_count") < 2) | ~F.col("table_hint"))})


def top_pages(pages: DataFrame) -> DataFrame:
    """The best pages of each document: half of them, within bounds; pages of contents come last."""
    doc = Window.partitionBy("source_file")
    order = doc.orderBy(F.col("toc_hard").cast("int"), F.col("cooccurrence_count").desc(), F.col("mixed_code_count").desc(), F.col("price_like_count").desc(), F.col("signal_score").desc(), "page_number")
    df = pages.withColumn("n_pages", F.count("*").over(doc)).withColumn("page_rank", F.row_number().over(order))
    k = F.least(F.col("n_pages"), F.greatest(F.lit(CONFIG.top_k_min), F.least(F.lit(CONFIG.top_k_max), F.floor(F.col("n_pages") / 2))))
    return df.filter(F.col("page_rank") <= k)


def sample_counts(documents: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """n_sample: how many of a document's n_pages pages a scan reads."""
    n = F.col("n_pages")
    small = F.least(F.lit(10), F.greatest(F.lit(4), F.ceil(n * 15 / 100)))
    middle = F.least(F.lit(20), F.greatest(F.lit(8), F.ceil(n / 10)))
    large = F.least(F.lit(25), F.greatest(F.lit(8), F.ceil(n / 100)))
    base = F.when(n < 20, small).when(n < 100, middle).otherwise(large)
    base = F.ceil(base * F.lit(float(max(1.0, multiplier))))
    return documents.withColumn("n_sample", F.when(n <= 0, 0).otherwise(F.greatest(F.lit(1), F.least(base, F.lit(CONFIG.sample_cap), n))).cast("long"))


def currency_choice(lines: DataFrame, fallback: str = CONFIG.target_currency) -> DataFrame:
    """The currency of each document by counts of priced codes, and whether others must be filtered out."""
    counts = lines.select("source_file", F.explode(F.regexp_extract_all("line", F.lit(rx.CURRENCY_PRICE), F.lit(1))).alias("c"))
    counts = counts.groupBy("source_file").agg(*[F.sum((F.upper("c") == c).cast("int")).alias(c.lower()) for c in rx.ROW_CURRENCIES], F.count("*").alias("total"))
    names = [c.lower() for c in rx.ROW_CURRENCIES]
    most = F.greatest(*names)
    best = F.coalesce(*[F.when(F.col(c) == most, c.upper()) for c in names])
    several = sum((F.col(c) > 0).cast("int") for c in names) >= 2
    detected = F.when((F.col("total") < CONFIG.currency_count_min) | (most / F.col("total") < CONFIG.currency_ratio_min), fallback).otherwise(best)
    return counts.withColumns({"target_currency": F.when(several & (F.col("eur") > 0), "EUR").otherwise(detected), "filter_currency": several})


def _suits_marker():
    return (F.col("marker_score") >= CONFIG.marker_score_min) & (F.col("art_no_count") >= CONFIG.marker_count_min) & (F.col("rrp_count") >= CONFIG.marker_count_min)


def _suits_code_price():
    return (F.col("code_price_score") >= CONFIG.code_price_score_min) & (F.col("price_count") >= CONFIG.price_count_min)


def triage(lines: DataFrame) -> DataFrame:
    """Scores of two ways to read a document by its text alone, and the way that suits it: the marker format, or lines of codes
    and prices. Of equal scores the earlier way holds. triage_with_tables also knows tables."""
    count = lambda p: F.sum(F.regexp_count("line", F.lit(p)))
    signals = lines.groupBy("source_file").agg(
        count(r"(?i)\bart\.?\s*no\.?").alias("art_no_count"), count(r"(?i)\brrp\b").alias("rrp_count"), count(r"(?i)\bcolli\b").alias("colli_count"),
        count(r"(?i)\bdesigner\b").alias("designer_count"), count(r"(?i)\bcode\b").alias("code_count"), count(r"(?i)\bdescription\b").alias("description_count"),
        count(r"(?i)\bprice\b").alias("price_label_count"), count(rx.CURRENCY_PRICE).alias("price_count"), count(r"\b(?:EUR|DKK|SEK|NOK)\b").alias("currency_count"),
    )
    signals = signals.withColumns({
        "marker_score": 2 * F.col("rrp_count") + 2 * F.col("art_no_count") + F.col("colli_count") + F.col("designer_count"),
        "code_price_score": 2 * (F.col("code_count") + F.col("description_count")) + F.col("price_label_count") + F.col("price_count") + F.col("currency_count"),
    })
    marker, code_price = _suits_marker(), _suits_code_price()
    profile = (
        F.when((F.col("art_no_count") >= 20) & (F.col("rrp_count") >= 20), "marker")
        .when(marker & (~code_price | (F.col("marker_score") >= F.col("code_price_score"))), "marker")
        .when(code_price, "code_price_based")
        .otherwise("unknown")
    )
    return signals.withColumns({"profile": profile, "support_score": F.greatest("marker_score", "code_price_score")})


def triage_with_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """triage with the third way, tables, by the table_metrics of the documents' pages; and the decision whether a document
    can be read: OK, FORSE (perhaps) or NO."""
    texts = lines.groupBy("source_file").agg(
        F.countDistinct("page_number").alias("n_pages"), F.sum(F.length("line")).alias("chars"), F.count("*").alias("n_lines"),
        F.sum(F.regexp_count("line", F.lit("€"))).alias("euro_count"),
    )
    texts = texts.select("source_file", "n_pages", "euro_count", (F.col("chars") + F.col("n_lines") - F.col("n_pages")).alias("text_len"))
    wide = tables.groupBy("source_file").agg(F.max("n_columns").alias("columns"), F.sum("numeric_line_ratio").alias("ratios"))
    df = triage(lines).drop("profile", "support_score").join(texts, "source_file").join(wide, "source_file", "left")
    # A page without words counts as one without columns.
    df = df.withColumns({"table_columns": F.coalesce("columns", F.lit(0)), "numeric_line_ratio": F.coalesce("ratios", F.lit(0.0)) / F.col("n_pages")}).drop("columns", "ratios", "n_pages")
    enough = F.col("table_columns") >= CONFIG.table_columns_min
    df = df.withColumn("table_score", F.when(enough, F.col("table_columns")).otherwise(0) + 5.0 * F.col("numeric_line_ratio"))
    ways = (("marker", _suits_marker(), "marker_score"), ("table_based", enough & (F.col("table_score") >= CONFIG.table_score_min), "table_score"), ("code_price_based", _suits_code_price(), "code_price_score"))
    best = F.greatest(*[F.when(suits, F.col(score).cast("double")).otherwise(-1.0) for _, suits, score in ways])
    forced = F.when((F.col("art_no_count") >= 20) & (F.col("rrp_count") >= 20), "marker")
    profile = F.coalesce(forced, *[F.when(suits & (F.col(score) == best), name) for name, suits, score in ways], F.lit("unknown"))
    df = df.withColumns({"profile": profile, "support_score": F.greatest(*[F.col(score).cast("double") for _, _, score in ways])})
    signal = F.greatest("art_no_count", "rrp_count", "price_count", "code_count", "description_count", "support_score") > 0
    weak = (F.col("profile") == "table_based") & (F.greatest("price_count", "euro_count", "currency_count") < 1) & (F.col("numeric_line_ratio") < CONFIG.table_numeric_ratio_min)
    decision = (
        F.when((F.col("text_len") < CONFIG.text_len_min) & ~signal, "NO")
        .when(weak, "FORSE")
        .when(F.col("profile") != "unknown", "OK")
        .when(signal, "FORSE")
        .otherwise("NO")
    )
    return df.withColumn("decision", decision)


def table_metrics(words: DataFrame, x_bin: int = 20, y_bin: int = 5, min_hits: int = 10) -> DataFrame:
    """Of words with positions: a page's table columns (bins of x with enough words) and the share of its lines (bins of y)
    that have numbers in two such columns or more."""
    binned = words.select(*PAGE, F.floor(F.col("x0") / x_bin).alias("xb"), F.floor(F.col("top") / y_bin).alias("yb"), F.col("text").rlike(r"\d").alias("numeric"))
    columns = binned.groupBy(*PAGE, "xb").agg(F.count("*").alias("hits")).filter(F.col("hits") >= min_hits)
    strong = binned.join(columns, [*PAGE, "xb"], "left_semi").filter("numeric")
    rows = strong.groupBy(*PAGE, "yb").agg(F.countDistinct("xb").alias("n")).groupBy(*PAGE).agg(F.sum((F.col("n") >= 2).cast("int")).alias("table_lines"))
    total = binned.groupBy(*PAGE).agg(F.countDistinct("yb").alias("n_lines"))
    wide = columns.groupBy(*PAGE).agg(F.count("*").alias("n_columns"))
    out = total.join(wide, list(PAGE), "left").join(rows, list(PAGE), "left")
    return out.select(*PAGE, "n_lines", F.coalesce("n_columns", F.lit(0)).alias("n_columns"), F.coalesce("table_lines", F.lit(0)).alias("table_lines"), (F.coalesce("table_lines", F.lit(0)) / F.col("n_lines")).alias("numeric_line_ratio"))


def section_carry(lines: DataFrame) -> DataFrame:
    """The section of each page: the first heading-like line among its first eight, else that of the page before."""
    low, c = F.lower("line"), F.col("line")
    heading = ~c.rlike(r"\d") & F.length("line").between(3, 40) & (tx.count_words(c, rx.NOT_SECTION_WORDS) == 0) & ~low.rlike(r"\b(?:dkk|sek|nok|eur)\s*\d")
    own = lines.filter("line_no < 8").groupBy(*PAGE).agg(F.min_by("line", F.when(heading, F.col("line_no"))).alias("own_section"))
    w = Window.partitionBy("source_file").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("section", F.last("own_section", ignorenulls=True).over(w))


def stitch_pairs(words: DataFrame) -> DataFrame:
    """Of words on a line: each line's code and the price that is nearest to it; prices to the right come before any other."""
    cleaned = tx.strip_currency(F.col("text"))
    codes = words.filter(tx.is_plausible_code(F.col("text"))).select(*PAGE, "line_no", F.col("x0").alias("code_x"), F.col("text").alias("code"))
    prices = words.filter(cleaned.rlike(rx.PRICE_TOKEN) & tx.parse_price(cleaned).isNotNull()).select(*PAGE, "line_no", F.col("x0").alias("price_x"), tx.parse_price(cleaned).alias("price"))
    gap = F.col("price_x") - F.col("code_x")
    pairs = codes.join(prices, [*PAGE, "line_no"]).withColumn("cost", F.when(gap >= 0, gap).otherwise(-gap + 10000))
    w = Window.partitionBy(*PAGE, "line_no").orderBy("cost", "code_x", "price_x")
    return pairs.withColumn("n", F.row_number().over(w)).filter("n = 1").select(*PAGE, "line_no", "code", "price", "cost")


def cluster_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """The words of a page as lines, by height: see tables.clusters."""
    from pricelore.operators.tables import clusters

    in_order = F.transform(F.array_sort(F.transform("words", lambda w: F.struct(w["x0"].alias("x0"), w["text"].alias("text")))), lambda w: w["text"])
    return clusters(words, tolerance).select(*PAGE, "cluster", F.array_join(in_order, " ").alias("line"))


def currency_counts(lines: DataFrame) -> DataFrame:
    """How often each document names each currency; the euro sign counts by itself."""
    names = F.regexp_extract_all("line", F.lit(r"€|\b(?:" + "|".join(rx.CURRENCIES) + r")\b"), F.lit(0))
    one = lines.select("source_file", F.explode(names).alias("c")).withColumn("currency", F.when(F.col("c") == "€", "EUR_symbol").otherwise(F.col("c")))
    return one.groupBy("source_file", "currency").agg(F.count("*").alias("n"))
