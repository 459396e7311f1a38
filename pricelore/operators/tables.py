"""Tables: lines in columns by wide gaps, and rows put together from words by where they stand on the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelore.config import CONFIG
from pricelore.functions import labels as lb
from pricelore.functions import markers as mk
from pricelore.functions import patterns as rx
from pricelore.functions import text as tx

PAGE = ("source_file", "page_number")
FIELDS = ("code", "description", "price")


def columns_of(line: Column) -> Column:
    """The columns of a line; the line alone if it has no gaps."""
    parts = F.filter(F.transform(F.split(line, rx.COLUMN_GAP), mk.trimmed), lambda x: x != "")
    return tx.let(parts, lambda p: F.when(F.size(p) > 1, p).when(line.rlike(r"\S"), F.array(mk.trimmed(line))).otherwise(F.array().cast("array<string>")))


def estimate_columns(lines: DataFrame) -> DataFrame:
    """The most columns that a line of each page has."""
    return lines.groupBy(*PAGE).agg(F.max(F.size(F.filter(F.split("line", r"\s{2,}"), lambda x: x != ""))).cast("int").alias("table_columns"))


def table_lines(lines: DataFrame, dictionary: dict | None = None) -> DataFrame:
    """Lines with two columns or more: columns, and header: the places of the fields if the line is a heading, else null;
    other lines that look like headings go. Lines come as they were read: normalised ones have no gaps left."""
    known = lb.patterns(dictionary or lb.DEFAULT)
    hit = lambda c, *fields: sum((lb.hits(c, f, known) for f in fields), F.lit(0)) > 0
    df = lines.withColumn("columns", columns_of(F.col("line"))).filter(F.size("columns") >= 2)
    marks = F.transform("columns", lambda c, i: F.struct(i.alias("i"), hit(c, "code").alias("code"), hit(c, "description").alias("description"), hit(c, "price", "currency").alias("price")))
    df = df.withColumn("__marks", marks)
    at = lambda f: F.transform(F.filter("__marks", lambda m: m[f]), lambda m: m["i"])
    # The last column that fits holds, but for prices the first.
    header = F.struct(F.array_max(at("code")).alias("code"), F.array_max(at("description")).alias("description"), F.array_min(at("price")).alias("price"))
    df = df.withColumn("__header", header)
    found = sum((F.col(f"__header.{f}").isNotNull().cast("int") for f in FIELDS), F.lit(0))
    df = df.withColumn("header", F.when(found >= 2, F.col("__header")))
    hits = sum((lb.hits(F.col("line"), f, known) for f in ("code", "description", "price", "currency")), F.lit(0))
    looks = ~F.col("line").rlike(rx.COLUMN_PRICE) & (hits >= 2)
    return df.filter(F.col("header").isNotNull() | ~looks).drop("__marks", "__header")


def table_rows(lines: DataFrame, dictionary: dict | None = None, last_header: bool = True) -> DataFrame:
    """code, name and price of each line in columns. Fields stand where the document's heading says: its last one, as a whole document
    is cut before it is read, or with last_header=False the last before the line. Without a heading the first column is the code, the last
    the price, and those between the name."""
    w = Window.partitionBy("source_file").orderBy("page_number", "line_no")
    frame = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing if last_header else Window.currentRow)
    df = table_lines(lines, dictionary).withColumn("__map", F.last("header", ignorenulls=True).over(frame)).filter(F.col("header").isNull())
    c = F.col("columns")
    at = lambda f: F.coalesce(F.get(c, F.col(f"__map.{f}")), F.lit(""))
    price_of = lambda v: tx.parse_price(F.try_element_at(F.regexp_extract_all(v, F.lit(rx.COLUMN_PRICE), F.lit(1)), F.lit(-1)))
    middle = F.when(F.size(c) > 2, F.array_join(F.slice(c, F.lit(2), F.size(c) - 2), " ")).otherwise("")
    df = df.withColumns({"art_no_raw": F.when(at("code") != "", at("code")).otherwise(F.get(c, F.lit(0))), "name": F.when(at("description") != "", at("description")).otherwise(middle)})
    df = df.withColumns({"art_no": mk.validated_code(F.col("art_no_raw")), "price": F.coalesce(price_of(at("price")), price_of(F.element_at(c, -1)))})
    return df.select(*PAGE, "line_no", "art_no", "art_no_raw", "name", F.array_join("columns", " ").alias("name_raw"), "price")


def precheck(lines: DataFrame, columns: DataFrame, dictionary: dict | None = None) -> DataFrame:
    """Of each document whether it is worth reading as tables: a heading, or three lines in columns, or wide pages (columns:
    source_file and table_columns)."""
    own = table_lines(lines, dictionary).groupBy("source_file").agg(F.max(F.col("header").isNotNull().cast("int")).alias("__h"), F.count_if(F.size("columns") >= CONFIG.table_columns_min).alias("__n"))
    df = lines.select("source_file").distinct().join(own, "source_file", "left").join(columns.groupBy("source_file").agg(F.max("table_columns").alias("__c")), "source_file", "left")
    ok = (F.coalesce("__h", F.lit(0)) == 1) | (F.coalesce("__c", F.lit(0)) >= CONFIG.table_columns_min) | (F.coalesce("__n", F.lit(0)) >= 3)
    return df.select("source_file", ok.alias("ok"), F.when(ok, "").otherwise("table_precheck_failed").alias("reason"))


def clusters(words: DataFrame, tolerance: float = CONFIG.stitch_tolerance) -> DataFrame:
    """Words with cluster: lines by height. A word begins a new one if it is farther than tolerance from the running middle, which
    depends on the order: the words of a page are folded over, and only where a cluster begins is kept."""
    page = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))).alias("__w"))
    start = F.struct(F.lit(None).cast("double").alias("mid"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, x: Column) -> Column:
        new = s["mid"].isNull() | (F.abs(x["top"] - s["mid"]) > tolerance)
        return F.struct(F.when(new, x["top"]).otherwise((s["mid"] + x["top"]) / 2).alias("mid"), (s["i"] + 1).alias("i"), F.when(new, F.concat(s["starts"], F.array(s["i"]))).otherwise(s["starts"]).alias("starts"))

    df = page.withColumn("__s", F.aggregate("__w", start, step, lambda s: s["starts"])).withColumn("__n", F.size("__w"))
    one = df.select(*PAGE, "__w", "__n", "__s", F.posexplode("__s").alias("cluster", "__at"))
    to = F.coalesce(F.get("__s", F.col("cluster") + 1), F.col("__n"))
    return one.select(*PAGE, "cluster", F.slice("__w", F.col("__at") + 1, to - F.col("__at")).alias("words"))


def stitch_rows(words: DataFrame, target: str = CONFIG.target_currency, most: int = CONFIG.stitch_rows_max, tolerance: float = CONFIG.stitch_tolerance) -> DataFrame:
    """Rows from words with positions (text, x0, top): line_text, ambiguous, code_count, price_count and windowed.

    A line with codes and prices gives the pair that stands closest, prices to the right first, with the words between as a name. A
    line with one price alone takes the one code of the last line that had codes alone, at most two lines above, unless
    that code has been used. A page gives `most` rows.
    """
    ordered = F.array_sort(F.col("words"), lambda a, b: F.when(a["x0"] < b["x0"], -1).when(a["x0"] > b["x0"], 1).otherwise(0))
    real = lambda w: F.filter(F.transform(w, lambda x, i: F.struct(i.alias("idx"), mk.trimmed(x["text"]).alias("text"), x["x0"].alias("x0"))), lambda t: t["text"] != "")
    df = clusters(words, tolerance).withColumn("__o", ordered).withColumn("t", real(F.col("__o"))).filter(F.size("t") > 0)
    line = F.array_join(F.transform("t", lambda t: t["text"]), " ")
    df = df.withColumn("__line", line).withColumns({"__label": F.col("__line").rlike(rx.CODE_LABEL), "__spec": F.col("__line").rlike(rx.SPEC)})
    unit = lambda s: F.lower(s).isin(*rx.STITCH_UNITS) | s.contains('"')
    full = F.transform("t", lambda t: tx.let(tx.strip_currency(t["text"]), lambda cleaned: F.struct(
        t["idx"].alias("idx"), t["text"].alias("text"), t["x0"].alias("x0"), t["text"].rlike(rx.CURRENCY_WORD).alias("currency"), unit(t["text"]).alias("unit"), t["text"].rlike(rx.CURRENCY_INSIDE).alias("inside"),
        cleaned.alias("cleaned"), tx.canonical_code(t["text"]).alias("code"), (cleaned.rlike(rx.PRICE_TOKEN) & ~tx.is_year(cleaned, t["text"]) & tx.parse_price(cleaned).isNotNull()).alias("price"), t["text"].rlike(r"\p{L}").alias("letters"))))
    df = df.withColumn("t", full)
    short = lambda c: c.rlike(rx.SHORT_GRADE)
    code = lambda t: (t["code"] != "") & ~(short(t["code"]) & ~F.col("__label")) & ~(F.col("__spec") & ~F.col("__label") & (F.length(t["code"]) <= 5)) & (tx.is_valid_code(t["code"]) | F.col("__label") & short(t["code"]))
    df = df.withColumn("codes", F.transform(F.filter("t", code), lambda t: F.struct(t["x0"].alias("x0"), t["idx"].alias("idx"), t["code"].alias("token"))))
    places = lambda f: F.transform(F.filter("t", lambda t: t[f]), lambda t: t["idx"])
    df = df.withColumns({"__cur": places("currency"), "__unit": places("unit")})
    near = lambda t, where: F.array_contains(where, t["idx"] - 1) | F.array_contains(where, t["idx"] + 1)
    price = lambda t: ~t["currency"] & ~t["unit"] & ~(t["letters"] & ~t["inside"]) & t["price"] & ~near(t, F.col("__unit"))

    def currency(t: Column) -> Column:
        beside = lambda d: F.when(F.array_contains("__cur", t["idx"] + d), F.upper(F.get("t", t["idx"] + d)["text"]))
        own = F.upper(t["text"])
        inside = F.when(own.contains("EUR") | t["text"].contains("€"), "EUR").when(own.contains("DKK"), "DKK").when(own.contains("SEK"), "SEK").when(own.contains("NOK"), "NOK")
        return F.coalesce(F.when(t["inside"], inside), beside(1), beside(-1), F.lit(target.upper()))

    df = df.withColumn("prices", F.transform(F.filter("t", price), lambda t: F.struct(t["x0"].alias("x0"), t["idx"].alias("idx"), t["cleaned"].alias("token"), currency(t).alias("currency"))))
    # Within a line all codes meet all prices: a line holds few.
    cost = lambda c, p: F.when(p["x0"] >= c["x0"], p["x0"] - c["x0"]).otherwise(c["x0"] - p["x0"] + 10000.0)
    pairs = F.flatten(F.transform("codes", lambda c, i: F.transform("prices", lambda p, j: F.struct(cost(c, p).alias("cost"), i.alias("i"), j.alias("j"), c.alias("code"), p.alias("price")))))
    df = df.withColumns({"n_codes": F.size("codes"), "n_prices": F.size("prices"), "pair": F.array_min(pairs)})
    by = Window.partitionBy(*PAGE).orderBy("cluster")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    # The last line before that had codes alone, or a pair: a line with prices alone changes nothing.
    note = F.struct("cluster", F.when((F.col("n_codes") == 1) & (F.col("n_prices") == 0), F.get("codes", F.lit(0))["token"]).alias("token"))
    df = df.withColumn("__last", F.last(F.when(F.col("n_codes") > 0, note), ignorenulls=True).over(before))
    lone = (F.col("n_codes") == 0) & (F.col("n_prices") == 1) & F.col("__last.token").isNotNull() & (F.col("cluster") - F.col("__last.cluster") <= 2)
    df = df.withColumn("__token", F.coalesce(F.when(F.col("pair").isNotNull(), F.col("pair.code.token")), F.when(lone, F.col("__last.token"))))
    df = df.filter(F.col("__token").isNotNull()).withColumn("windowed", F.col("pair").isNull())
    # A code that any row before has used is not carried.
    used = Window.partitionBy(*PAGE, "__token").orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__used", F.coalesce(F.count("*").over(used), F.lit(0))).filter(~F.col("windowed") | (F.col("__used") == 0))
    df = df.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= most)
    low, high = F.least("pair.code.idx", "pair.price.idx"), F.greatest("pair.code.idx", "pair.price.idx")
    between = F.filter("t", lambda t, i: (i > low) & (i < high) & ~t["currency"] & ~t["text"].rlike("^(?:" + rx.NUMBER + ")$") & t["letters"])
    pair_line = F.concat_ws(" ", F.col("pair.code.token"), F.array_join(F.transform(between, lambda t: t["text"]), " "), F.col("pair.price.currency"), F.col("pair.price.token"))
    lone_line = F.concat_ws(" ", "__token", F.get("prices", F.lit(0))["currency"], F.get("prices", F.lit(0))["token"])
    text = F.regexp_replace(F.when(F.col("windowed"), lone_line).otherwise(pair_line), " {2,}", " ")
    ambiguous = ~F.col("windowed") & ((F.col("n_codes") != 1) | (F.col("n_prices") != 1))
    return df.select(*PAGE, "cluster", text.alias("line_text"), ambiguous.alias("ambiguous"), F.col("n_codes").alias("code_count"), F.col("n_prices").alias("price_count"), "windowed")


def stitched_pages(pages: DataFrame) -> DataFrame:
    """The pages whose lines give no row by themselves although they have codes and prices, and which look like tables."""
    return pages.filter((F.col("cooccurrence_count") == 0) & (F.col("mixed_code_count") >= CONFIG.stitch_codes_min) & (F.col("price_like_count") >= CONFIG.stitch_prices_min) & (F.col("table_likelihood") >= CONFIG.table_likelihood_min))
