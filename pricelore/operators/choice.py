"""Which way a document is read: what each way yields, the scores by which they compete, and what is tried after a failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelore.config import CONFIG

DOC = "source_file"
#: The ways of reading, in the order in which they are tried.
WAYS = ("marker", "table_based", "code_price_based")
#: Reasons after which a larger sample may help.
RETRY_REASONS = ("too_few_rows", "no_valid_rows_found", "low_unique_code_ratio", "low_key_fields_rate", "table_precheck_failed", "early_discard_low_unique", "early_discard_low_key_fields")


def order_of_ways(profile: Column, art_no_count: Column, rrp_count: Column) -> Column:
    """The ways in the order for a document: the marker format first if its marks abound, then the profile that suits, then the rest."""
    first = F.when((art_no_count >= 20) & (rrp_count >= 20), F.array(F.lit("marker"))).otherwise(F.array().cast("array<string>"))
    suits = F.when(profile.isin(*WAYS), F.array(profile)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(first, suits, F.array(*map(F.lit, WAYS))))


def metrics(rows: DataFrame, by: tuple[str, ...] = (DOC, "parser")) -> DataFrame:
    """What a way yields, of rows with art_no, name, price, exported and needs_review: rates over exported rows, and the rate of reviews
    over all. Codes with different names or prices are conflicts. Of no exported row the rates are 0, of no row the reviews 1."""
    out, code = F.col("exported"), F.when(F.col("art_no") != "", F.col("art_no"))
    base = rows.groupBy(*by).agg(
        F.count("*").alias("eval_rows"), F.count_if(out).alias("rows_exported"), F.countDistinct(F.when(out, code)).alias("__codes"),
        F.count_if(out & (F.col("art_no") != "") & F.col("price").isNotNull()).alias("__key"), F.count_if("needs_review").alias("__review"),
    )
    variant = F.struct(F.lower(F.btrim("name")), F.coalesce(F.col("price").cast("string"), F.lit("")))
    codes = rows.filter("art_no <> ''").groupBy(*by, "art_no").agg(F.countDistinct(variant).alias("__v")).groupBy(*by).agg(F.count_if(F.col("__v") > 1).alias("duplicate_conflicts_count"))
    df = base.join(codes, list(by), "left").withColumn("duplicate_conflicts_count", F.coalesce("duplicate_conflicts_count", F.lit(0)))
    share = lambda c: F.when(F.col("rows_exported") > 0, F.col(c) / F.col("rows_exported")).otherwise(0.0)
    df = df.withColumns({"unique_code_ratio": share("__codes"), "key_fields_rate": share("__key"), "duplicate_conflicts_rate": share("duplicate_conflicts_count"), "review_rate": F.when(F.col("eval_rows") > 0, F.col("__review") / F.col("eval_rows")).otherwise(1.0)})
    return df.drop("__codes", "__key", "__review")


def run_score() -> Column:
    """A review rate of nothing counts as one that isn't known: the worst."""
    review = F.when(F.col("review_rate") == 0, 1.0).otherwise(F.col("review_rate"))
    return F.col("key_fields_rate") + CONFIG.score_unique * F.col("unique_code_ratio") - CONFIG.score_review * review - CONFIG.score_conflicts * F.col("duplicate_conflicts_rate")


def judged(attempts: DataFrame) -> DataFrame:
    """metrics with reason ("passed", or why not), ok, score and excellent. Of few pages (eval_pages) one row is enough."""
    least = F.when((F.col("eval_pages") > 0) & (F.col("eval_pages") <= CONFIG.eval_pages_weak), 1).otherwise(CONFIG.rows_min)
    reason = (
        F.when(F.col("rows_exported") == 0, "no_valid_rows_found")
        .when(F.col("rows_exported") < least, "too_few_rows")
        .when(F.col("unique_code_ratio") < CONFIG.unique_ratio_min, "low_unique_code_ratio")
        .when(F.col("key_fields_rate") < CONFIG.key_rate_min, "low_key_fields_rate")
        .otherwise("passed")
    )
    df = attempts.withColumn("reason", reason)
    excellent = (F.col("key_fields_rate") >= CONFIG.excellent_key_rate) & (F.col("review_rate") <= CONFIG.excellent_review_rate)
    return df.withColumns({"ok": F.col("reason") == "passed", "score": run_score(), "excellent": excellent})


def early_discards(rows: DataFrame, by: tuple[str, ...] = (DOC, "parser"), min_pages: int = 2) -> DataFrame:
    """Of rows with eval_rank, the rank of their page: at which page a way is given up, and why; ways that aren't do not appear.

    After each page from min_pages on, all exported rows so far count: none at all, or enough of them with too few codes or key fields.
    """
    # A code counts at the page where it first appears, so that running sums give distinct codes.
    out = F.col("exported")
    first = Window.partitionBy(*by, "art_no", "exported").orderBy("eval_rank", "page_number", "line_no")
    df = rows.withColumn("__new", (out & (F.col("art_no") != "") & (F.row_number().over(first) == 1)).cast("int"))
    pages = df.groupBy(*by, "eval_rank").agg(F.count_if(out).alias("n"), F.sum("__new").alias("codes"), F.count_if(out & (F.col("art_no") != "") & F.col("price").isNotNull()).alias("keys"))
    run = Window.partitionBy(*by).orderBy("eval_rank").rowsBetween(Window.unboundedPreceding, 0)
    pages = pages.select(*by, "eval_rank", *[F.sum(c).over(run).alias(c) for c in ("n", "codes", "keys")])
    why = (
        F.when(F.col("n") == 0, "early_discard_no_rows")
        .when(F.col("n") < CONFIG.rows_min, None)
        .when(F.col("codes") / F.col("n") < CONFIG.unique_ratio_min * CONFIG.early_discard_factor, "early_discard_low_unique")
        .when(F.col("keys") / F.col("n") < CONFIG.key_rate_min * CONFIG.early_discard_factor, "early_discard_low_key_fields")
    )
    found = pages.withColumn("reason", why).filter((F.col("eval_rank") >= max(2, min_pages)) & F.col("reason").isNotNull())
    return found.groupBy(*by).agg(F.min(F.struct("eval_rank", "reason")).alias("f")).select(*by, F.col("f.eval_rank").alias("discarded_at"), F.col("f.reason").alias("reason"))


def tried(attempts: DataFrame, order: DataFrame) -> DataFrame:
    """The attempts that are made: ways in the document's order (order: source_file and ways) up to the first excellent one."""
    ranked = order.select(DOC, F.posexplode("ways").alias("way_rank", "parser"))
    df = attempts.join(ranked, [DOC, "parser"])
    before = Window.partitionBy(DOC).orderBy("way_rank").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.coalesce(F.max((F.col("ok") & F.col("excellent")).cast("int")).over(before), F.lit(0))
    return df.withColumn("__s", stop).filter("__s = 0").drop("__s")


def best_runs(attempts: DataFrame, profiles: DataFrame) -> DataFrame:
    """One attempt a document: of those that are ok the best by score, rows and reviews; else, for review alone, the one that suits the profile
    or has the most rows; none of a document without rows."""
    df = attempts.join(profiles.select(DOC, "profile"), DOC, "left")
    suits = (F.col("parser") == F.col("profile")).cast("int")
    order = [
        F.col("ok").cast("int").desc(),
        F.when(F.col("ok"), F.col("score")).desc(), F.when(F.col("ok"), F.col("rows_exported")).desc(), F.when(F.col("ok"), F.col("review_rate")),
        suits.desc(), F.col("eval_rows").desc(), F.col("score").desc(), F.col("way_rank"),
    ]
    few = df.filter(F.col("ok") | (F.col("eval_rows") > 0)).withColumn("__n", F.row_number().over(Window.partitionBy(DOC).orderBy(*order))).filter("__n = 1")
    status = F.when(F.col("ok"), F.concat(F.lit("CONVERTED(parser="), F.col("parser"), F.lit(")"))).otherwise(F.concat(F.lit("REVIEW_ONLY(parser="), F.col("parser"), F.lit(")")))
    return few.withColumn("final_status", status).drop("__n", "profile")


def attempt_text() -> Column:
    """An attempt in one line: (parser:status|reason|metrics|score=...)."""
    rate = lambda c: F.concat(F.lit(f"{c}="), F.format_string("%.2f", F.col(c)))
    count = lambda c: F.concat(F.lit(f"{c}="), F.col(c).cast("string"))
    figures = F.concat_ws(",", count("rows_exported"), rate("unique_code_ratio"), rate("key_fields_rate"), rate("review_rate"), rate("duplicate_conflicts_rate"), count("duplicate_conflicts_count"))
    status = F.when(F.col("ok"), "ok").otherwise("failed")
    return F.concat(F.lit("("), F.concat_ws("|", F.concat_ws(":", "parser", status), F.col("reason"), figures, F.concat(F.lit("score="), F.format_string("%.3f", F.col("score")))), F.lit(")"))


def last_failure(attempt: Column) -> Column:
    """The reason in an attempt's line."""
    return F.coalesce(F.get(F.split(F.regexp_replace(attempt, r"^[()]+|[()]+$", ""), r"\|"), F.lit(1)), F.lit(""))


def retry_plan(attempts: DataFrame, samples: DataFrame) -> DataFrame:
    """What is tried next for each document: "" if a way passed; a scan for codes beside prices if too few such pages were found (samples:
    source_file, cooccurrence_pages and cooccurrence_required), a larger sample after a failure that it may mend, a sample that keeps more
    pages if no way gave a row; with the factor of the sample, and what comes after if that fails too: a sweep."""
    by = attempts.groupBy(DOC).agg(
        F.max(F.col("ok").cast("int")).alias("__ok"), F.max(F.when(F.col("eval_rows") > 0, 1).otherwise(0)).alias("__rows"),
        F.array_sort(F.collect_list(F.when(F.col("reason").isin(*RETRY_REASONS), F.struct("way_rank", "reason")))).alias("__why"),
    )
    df = by.join(samples, DOC, "left")
    short = F.coalesce((F.col("cooccurrence_required") > 0) & (F.col("cooccurrence_pages") < F.col("cooccurrence_required")), F.lit(False))
    mode = F.when(F.col("__rows") == 0, "retry_no_rows").when(short, "retry_cooc").when(F.col("__ok") == 1, "").when(F.size("__why") > 0, "retry").otherwise("")
    df = df.withColumn("next_mode", mode)
    again = F.col("next_mode") != ""
    return df.select(DOC, "next_mode", F.when(again, CONFIG.retry_multiplier).otherwise(1.0).alias("multiplier"), F.when(again, F.coalesce(F.get("__why", F.lit(0))["reason"], F.lit(""))).otherwise("").alias("reason"), F.when(again, "sweep").otherwise("").alias("then_mode"))
