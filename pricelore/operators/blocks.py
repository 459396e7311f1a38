"""Blocks of lines that stand for one product each, and the rows that parsers make of them.

Boundaries are found by windows over a page's lines, so pages are the largest thing that one task sorts; where a rule looks
back to what it has decided before, it is put so that no decision but the last candidate's matters, or folded over the
few blocks between two that are certain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelore.functions import markers as mk
from pricelore.functions import patterns as rx
from pricelore.functions import text as tx

PAGE = ("source_file", "page_number")
#: Lines after a title in which the packing must follow.
LOOKAHEAD = 4


def _joined(lines: DataFrame, *by: str) -> DataFrame:
    """The lines of each group as one text, and the first of their numbers."""
    own = lines.groupBy(*PAGE, *by).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("__l"))
    return own.select(*PAGE, *by, F.col("__l")[0]["line_no"].alias("line_no"), F.array_join(F.transform("__l", lambda x: x["line"]), "\n").alias("block"))


def titled_blocks(lines: DataFrame) -> DataFrame:
    """source_file, page_number, line_no and block: a new block begins at a title that packing follows, once the block
    before has a code field. Blocks without a price mark, or with neither code nor price, are none."""
    order = Window.partitionBy(*PAGE).orderBy("line_no")
    ahead = order.rowsBetween(0, LOOKAHEAD)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = lines.withColumn("__colli", F.max(F.col("line").contains("Colli").cast("int")).over(ahead) == 1)
    df = df.withColumn("__may", mk.is_title(F.col("line")) & F.col("__colli")).withColumn("__codes", F.coalesce(F.sum(mk.contains_art_no(F.col("line")).cast("int")).over(before), F.lit(0)))
    # Only what lies between a candidate and the one before it counts: had there been a code earlier, that one would have begun a block.
    last = F.last(F.when(F.col("__may"), F.col("__codes")), ignorenulls=True).over(before)
    df = df.withColumn("__new", F.col("__may") & (F.col("__codes") > F.coalesce(last, F.lit(0))))
    df = df.withColumn("__n", F.sum(F.col("__new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return _joined(df.filter(F.col("line").rlike(r"\S")), "__n").drop("__n").filter(mk.is_block_valid(F.col("block")))


def marker_blocks(lines: DataFrame) -> DataFrame:
    """source_file, page_number, line_no, part and block: blocks begin at price marks with a name before them, and are split at
    their code fields. A page without such marks is cut by titles."""
    order = Window.partitionBy(*PAGE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("line").rlike(r"^.*?\S.*?\*\*\s*(?i:RRP)") & ~F.col("line").rlike(r"^\s*\*\*\s*(?i:RRP)")
    df = lines.withColumn("__n", F.sum(start.cast("int")).over(order)).withColumn("__any", F.max(start.cast("int")).over(Window.partitionBy(*PAGE)) == 1)
    marked = _joined(df.filter("__any AND __n > 0"), "__n").select(*PAGE, "line_no", F.posexplode(mk.split_by_codes(F.col("block"))).alias("part", "block"))
    titled = titled_blocks(df.filter("NOT __any").drop("__n", "__any")).withColumn("part", F.lit(0))
    return marked.filter(F.col("block").rlike(r"\S")).unionByName(titled)


def code_price_blocks(info: DataFrame) -> DataFrame:
    """Every line that looks priced or has a plausible code is a block, but for headings: a label and no number."""
    heading = ~F.col("line").rlike(rx.COLUMN_PRICE) & F.col("line").rlike(r"(?i)\b(?:code|description|price)\b")
    return info.filter(~heading & (F.col("price_like") | (F.col("code_hits") > 0))).select(*PAGE, "line_no", F.lit(0).alias("part"), F.col("line").alias("block"))


def attach_continuations(blocks: DataFrame) -> DataFrame:
    """Blocks with a price and no code go to the block before them, if that began on the same page or the one before; others
    stand for themselves and are noted as orphans. Columns: those of blocks, and note.

    A block that goes on may not be far from where it began, so it matters which block took the last one in: this is folded over
    the blocks between two that have codes or no price.
    """
    seq = Window.partitionBy("source_file").orderBy("page_number", "line_no", "part").rowsBetween(Window.unboundedPreceding, 0)
    goes_on = ~mk.contains_art_no(F.col("block")) & mk.is_price_line(F.col("block"))
    df = blocks.withColumn("__on", goes_on).withColumn("__island", F.sum((~F.col("__on")).cast("int")).over(seq))
    one = F.struct("page_number", "line_no", "part", "block", F.col("__on").alias("goes_on"))
    islands = df.groupBy("source_file", "__island").agg(F.array_sort(F.collect_list(one)).alias("__b"))
    out = "struct<page_number:int,line_no:int,part:int,block:string,note:string>"

    def step(done: Column, b: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        taken = b["goes_on"] & F.coalesce((b["page_number"] - last["page_number"]).isin(0, 1), F.lit(False))
        note = F.when(F.instr(last["note"], "continuation_attached") > 0, last["note"]).when(last["note"] == "", "continuation_attached").otherwise(F.concat(last["note"], F.lit("; continuation_attached")))
        more = F.struct(last["page_number"].alias("page_number"), last["line_no"].alias("line_no"), last["part"].alias("part"), F.concat(last["block"], F.lit("\n"), b["block"]).alias("block"), note.alias("note"))
        new = F.struct(b["page_number"].cast("int").alias("page_number"), b["line_no"].cast("int").alias("line_no"), b["part"].cast("int").alias("part"), b["block"].alias("block"), F.when(b["goes_on"], "orphan_block_no_art_no").otherwise("").alias("note"))
        return F.when(taken, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(more))).otherwise(F.concat(done, F.array(new)))

    heads = islands.withColumn("__h", F.aggregate("__b", F.array().cast(f"array<{out}>"), step))
    return heads.select("source_file", F.inline("__h"))


def split_merged(blocks: DataFrame) -> DataFrame:
    """Blocks with several code fields in parts, with a note."""
    several = F.regexp_count("block", F.lit(rx.ART_NO_MARK)) > 1
    note = F.when(several, F.concat_ws("; ", F.when(F.col("note") != "", F.col("note")), F.lit("merged_block_split_by_art_no"))).otherwise(F.col("note"))
    rows = blocks.withColumn("note", note).withColumn("__parts", mk.split_by_codes(F.col("block")))
    return rows.drop("block").select("*", F.posexplode("__parts").alias("sub_part", "block")).drop("__parts")


def marker_rows(blocks: DataFrame) -> DataFrame:
    """The fields of each block of the marker format."""
    block = F.col("block")
    df = blocks.withColumns({"art_no_raw": mk.code_field_raw(block), "colli": mk.colli(block), "size_raw": mk.labelled(block, "Size"), "designer": mk.labelled(block, "Designer"), "__prices": mk.prices(block), "__titles": mk.title_lines(block)})
    df = df.withColumns({"art_no": mk.validated_code(F.col("art_no_raw")), "__name": mk.name_and_variant(F.coalesce(F.get("__titles", F.lit(0)), F.lit(""))), "name_raw": F.array_join("__titles", " | "), "__sizes": mk.sizes(F.col("size_raw"))})
    invalid = F.transform(F.filter("__prices", lambda p: p["price"].isNull()), lambda p: F.concat(F.lit("invalid_price_"), F.lower(p["currency"])))
    priced = {f"price_{c.lower()}": mk.last_price(F.col("__prices"), c) for c in rx.ROW_CURRENCIES}
    df = df.withColumns({"name": F.col("__name.name"), "variant": F.col("__name.variant"), "width_cm": F.col("__sizes.width_cm"), "height_cm": F.col("__sizes.height_cm"), "length_cm": F.col("__sizes.length_cm"), "parse_notes": F.array_join(invalid, "; "), **priced})
    sized = F.coalesce("width_cm", F.lit(0.0)) + F.coalesce("height_cm", F.lit(0.0)) + F.coalesce("length_cm", F.lit(0.0))
    return df.withColumn("size_unparsed", (F.col("size_raw") != "") & (sized == 0)).drop("__prices", "__titles", "__name", "__sizes")
