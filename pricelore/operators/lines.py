"""What a line says: tokens, candidates for prices and codes, and the flags that later steps decide by.

Everything is a projection over arrays, so no step shuffles. Each stage's columns are made once and named, and later ones refer to
them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelore.functions import patterns as rx
from pricelore.functions import text as tx


def settled(df: DataFrame) -> DataFrame:
    """df with its columns made once: filters on them stay above. Pushed down through many stages of array
    expressions they would repeat those without end."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _around(tokens: Column, i: Column, offset: int, field: str) -> Column:
    """A field of a neighbour; false beyond the ends."""
    at = i + offset
    return F.coalesce(F.when(at >= 0, F.get(tokens, at).getField(field)), F.lit(False))


def _points(token: Column, currency: Column) -> Column:
    return F.when(currency, 3).otherwise(0) + F.when(token.getField("thousands"), 2).otherwise(0) + token.getField("two_decimals").cast("int") + (token.getField("number") >= 100).cast("int")


def token_info(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """lines with toks: an array of structs, one for each token, that hold what the token is by itself and by its neighbours."""

    def alone(t: Column, i: Column) -> Column:
        return tx.let(tx.strip_currency(t), lambda cleaned: tx.let(cleaned.rlike(rx.PRICE_TOKEN), lambda price: F.struct(
            i.alias("i"), t.alias("token"), cleaned.alias("cleaned"), price.alias("price"), (price & tx.is_year(cleaned, t)).alias("year"),
            F.when(price, tx.parse_number(cleaned)).alias("number"), (price & cleaned.rlike(rx.THOUSANDS)).alias("thousands"), (price & cleaned.rlike(rx.DECIMAL_2)).alias("two_decimals"),
            t.rlike(rx.CURRENCY_WORD).alias("currency"), t.rlike(rx.CURRENCY_INSIDE).alias("has_currency"),
            (t.rlike(rx.NUMBER_WITH_UNIT) | t.rlike(rx.UNIT_CONTEXT) | t.contains('"')).alias("unit"),
            tx.is_dimension_candidate(t).alias("dimension"), F.coalesce(t.rlike("[0-9]") & tx.parse_number(t).isNotNull(), F.lit(False)).alias("is_number"),
            t.isin("x", "X", "×").alias("is_x"), t.rlike(rx.DIMENSION_LABEL).alias("is_label"), t.rlike(rx.UNIT_TOKEN).alias("is_unit"),
            tx.canonical_code(t).alias("code"),
        )))

    df = lines.withColumn("tokens", tx.tokenize(F.col(line_col))).withColumn("toks", F.transform("tokens", alone))
    toks = F.col("toks")

    def spans(t: Column, i: Column) -> Column:
        """Where a dimension written over several tokens would begin and end: n x n, n x n x n, or a label and a number, and a unit."""
        at = lambda k, field: _around(toks, i, k, field)
        cross = t.getField("is_number") & ~t.getField("dimension") & at(1, "is_x") & at(2, "is_number")
        third = at(3, "is_x") & at(4, "is_number")
        size = F.when(cross & third, 5 + at(5, "is_unit").cast("int")).when(cross, 3 + at(3, "is_unit").cast("int")).when(t.getField("is_label") & at(1, "is_number"), 2 + at(2, "is_unit").cast("int"))
        return F.struct(i.alias("a"), (i + size).alias("z"))

    df = df.withColumn("__spans", F.filter(F.transform("toks", spans), lambda s: s.getField("z").isNotNull()))
    # From the left, each span begins after the one before.
    free = F.aggregate("__spans", F.array().cast("array<struct<a:int,z:int>>"), lambda done, s: F.when(s.getField("a") >= F.coalesce(F.try_element_at(done, F.lit(-1)).getField("z"), F.lit(0)), F.concat(done, F.array(s))).otherwise(done))
    df = df.withColumn("__taken", free)

    def consumed(t: Column, i: Column) -> Column:
        return t.getField("dimension") | F.exists("__taken", lambda s: (s.getField("a") <= i) & (i < s.getField("z")))

    def full(t: Column, i: Column) -> Column:
        unit = t.getField("unit")
        for k in (-2, -1, 1, 2):
            unit = unit | _around(toks, i, k, "unit")
        near = t.getField("has_currency") | _around(toks, i, -1, "currency") | _around(toks, i, 1, "currency")
        return F.struct(*[t.getField(n).alias(n) for n in ("i", "token", "cleaned", "price", "year", "number", "thousands", "two_decimals", "currency", "dimension", "code")], unit.alias("unit"), near.alias("near_currency"), consumed(t, i).alias("consumed"))

    df = df.withColumn("has_dimension_candidate", (F.size("__spans") > 0) | F.exists("toks", lambda t: t.getField("dimension")))
    return settled(df.withColumn("__full", F.transform("toks", full)).withColumn("toks", F.col("__full")).drop("__full", "__spans", "__taken"))


def line_info(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """lines with the flags and candidates of each line."""
    line = F.col(line_col)
    df = token_info(lines, line_col)
    in_line = line.rlike(rx.DIMENSION_IN_LINE) | line.rlike(rx.UNIT)
    measure = in_line | line.rlike(rx.MEASURE) | line.contains('"') | F.exists("tokens", lambda t: t.rlike(rx.AXIS_TOKEN))
    df = df.withColumns({
        "has_currency": line.rlike(rx.CURRENCY), "__dimension": in_line, "__measure": measure,
        "number_count": F.regexp_count(line, F.lit(rx.NUMBER)),
        "toc_pairs": tx.toc_pairs(line), "year_hits": F.regexp_count(line, F.lit(rx.YEAR_EUR)), "short_numbers": F.regexp_count(line, F.lit(rx.SHORT_NUMBER)),
        "plausible_tokens": F.size(F.filter("tokens", lambda t: tx.is_plausible_code(t))),
        "codes": F.filter(F.regexp_extract_all(line, F.lit(rx.CODE_TOKEN), F.lit(0)), lambda t: tx.is_plausible_code(t)),
        "code_label": line.rlike(rx.CODE_LABEL), "__spec": line.rlike(rx.SPEC),
    })
    df = df.withColumn("candidates", F.transform(F.filter("toks", lambda t: ~t.getField("unit") & t.getField("price") & ~t.getField("year") & t.getField("number").isNotNull()), lambda t: F.struct(_points(t, F.col("has_currency")).alias("score"), t.getField("i").alias("i"), t.getField("number").alias("value"), t.getField("cleaned").alias("token"))))
    df = df.withColumns({
        "best": F.coalesce(F.array_max(F.transform("candidates", lambda c: c.getField("score"))), F.lit(0)),
        "max_value": F.coalesce(F.array_max(F.transform("candidates", lambda c: c.getField("value"))), F.lit(0.0)),
    })
    likely = F.when(F.col("best") >= 3, True).when(F.col("best") == 2, (F.col("max_value") >= 10) | F.col("has_currency")).when(F.col("best") == 1, ~F.col("__dimension") & (F.col("number_count") <= 3) & (F.col("max_value") >= 10)).otherwise(False)
    toc_line = (line.contains("€") | F.upper(line).contains("EUR")) & (F.col("year_hits") > 0) & (F.col("short_numbers") >= 3) & (F.col("plausible_tokens") == 0)
    df = df.withColumns({
        "price_like": likely & ~(F.col("__measure") & ~F.col("has_currency")),
        "dimension_line": F.col("__measure") | (F.col("number_count") >= 4) & (F.col("best") <= 2) | (F.col("number_count") >= 3) & (F.col("max_value") < 10) & ~F.col("has_currency"),
        "toc_line": (F.size("toc_pairs") >= 2) & (F.size(F.array_distinct("toc_pairs")) >= 2) | toc_line,
        "code_hits": F.size("codes"),
        "legal_hits": tx.count_patterns(line, rx.LEGAL), "is_legal": tx.is_legal(line), "is_header": tx.is_header(line),
        "legend_hits": tx.count_words(line, rx.LEGEND_WORDS),
    })
    prices = F.filter("toks", lambda t: ~t.getField("consumed") & ~t.getField("unit") & t.getField("price") & ~t.getField("year") & tx.parse_price(t.getField("cleaned")).isNotNull())
    short = lambda t: (t.getField("code").rlike(rx.SHORT_GRADE) & ~F.col("code_label")) | F.col("__spec") & ~F.col("code_label") & (F.length(t.getField("code")) <= 5)
    codes = F.filter("toks", lambda t: ~t.getField("consumed") & ~t.getField("currency") & (t.getField("code") != "") & ~short(t) & tx.is_valid_code(t.getField("code")))
    return settled(df.withColumns({
        "price_candidates": F.transform(prices, lambda t: F.struct(_points(t, t.getField("near_currency")).alias("score"), t.getField("number").alias("value"), (-t.getField("i")).alias("minus_i"), t.getField("cleaned").alias("token"))),
        "code_candidates": F.transform(codes, lambda t: F.struct(F.length(t.getField("code")).alias("length"), (-t.getField("i")).alias("minus_i"), t.getField("code").alias("token"))),
    }).drop("__dimension", "__spec").withColumnRenamed("__measure", "measure_context"))


def resolve_fields(info: DataFrame) -> DataFrame:
    """The price and the code that a line most likely gives, each the best candidate and the first among equals, and as
    its name the tokens that are left."""
    df = info.withColumns({"best_price": F.array_max("price_candidates"), "best_code": F.array_max("code_candidates")})
    price_at, code_at = -F.col("best_price.minus_i"), -F.col("best_code.minus_i")

    def left(t: Column) -> Column:
        i = t.getField("i")
        return ~t.getField("consumed") & ~t.getField("currency") & ~F.coalesce(i == price_at, F.lit(False)) & ~F.coalesce(i == code_at, F.lit(False))

    return df.withColumn("resolved_name", F.array_join(F.transform(F.filter("toks", left), lambda t: t.getField("token")), " "))


def parse_rows(info: DataFrame, line_col: str = "line") -> DataFrame:
    """The row of each line as the parser for code and price lines reads it: the last of the best price candidates, the
    first plausible code that isn't that price, and the line without both as its name."""
    chosen = F.array_max("candidates")
    df = resolve_fields(info).withColumn("__chosen", F.when(chosen.getField("score") > 0, chosen))
    df = df.withColumn("price", tx.parse_price(F.col("__chosen.token")))
    df = df.withColumn("price_raw", F.when(F.col("price").isNotNull(), F.col("__chosen.token")).otherwise(""))
    df = df.withColumn("code_raw", F.coalesce(F.get(F.filter("codes", lambda c: (F.col("price_raw") == "") | (c != F.col("price_raw"))), F.lit(0)), F.lit("")))
    df = df.withColumn("art_no", tx.canonical_code(F.col("code_raw")))

    def without(c: Column, part: Column) -> Column:
        at = F.instr(c, part)
        return F.when((part == "") | (at == 0), c).otherwise(F.concat(F.substring(c, F.lit(1), at - 1), F.lit(" "), F.substring(c, at + F.length(part), F.length(c))))

    name = without(without(F.col(line_col), F.col("code_raw")), F.col("price_raw"))
    df = df.withColumn("name", F.btrim(F.regexp_replace(name, r"\s{2,}", " "))).drop("__chosen")
    # What the parser has not found the line's best candidates give.
    filled = {"art_no": F.when(F.col("art_no") == "", F.coalesce("best_code.token", F.lit(""))).otherwise(F.col("art_no")), "name": F.when(F.col("name") == "", F.col("resolved_name")).otherwise(F.col("name"))}
    return settled(df.withColumns(filled))
