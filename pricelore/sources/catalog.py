"""Sources: page tables, page ranges, and the catalogue view over the part table that tests and benchmarks use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same text in Spark and in DuckDB: lines of a price list, one for each part, brand by brand.
CATALOG_SQL = """
WITH a AS (
 SELECT p_partkey AS k, p_brand AS source_file, p_name,
  CAST(substr(p_brand, 7) AS INT) AS bn,
  CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS rn,
  chr(CAST(65 + (p_partkey % 1500) % 26 AS INT)) || chr(CAST(65 + (p_partkey % 1500) % 7 AS INT))
    || lpad(CAST(((p_partkey % 1500) * 7919) % 100000 AS VARCHAR(10)), 5, '0') AS code,
  CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR(20)) AS price,
  CAST(p_size AS VARCHAR(5)) AS sz
 FROM part),
b AS (SELECT *, CAST(floor(rn / 20) AS INT) + 1 AS page_number, rn % 20 AS line_no FROM a)
SELECT source_file, page_number, line_no,
 CASE
  WHEN page_number = 2 AND bn % 5 = 0 THEN CAST(100 + line_no AS VARCHAR(5)) || ' 2026 EUR'
  WHEN page_number = 2 AND bn % 5 = 1 THEN 'Warranty and liability: governing law and jurisdiction'
  WHEN page_number = 3 AND bn % 5 = 2 THEN 'A plain story about the ' || p_name
  WHEN page_number = 3 AND bn % 5 = 3 THEN CASE line_no % 5
    WHEN 0 THEN p_name || ', black ** RRP'
    WHEN 1 THEN 'Colli: ' || sz
    WHEN 2 THEN 'Size: W ' || sz || ' cm H 20 cm L 30,5 cm'
    WHEN 3 THEN 'Art. no: ' || code
    ELSE 'DKK ' || price || ' SEK 12,50 EUR ' || sz || '.90' END
  WHEN line_no = 0 AND bn % 5 = 4 THEN 'Lounge Collection'
  WHEN k % 16 = 7 THEN code || ' ' || p_name || ' 2700K E27 ' || sz || 'W EUR 1.' || lpad(sz, 3, '0') || ',00'
  WHEN k % 16 = 8 THEN p_name || ' ' || sz || '0 x ' || sz || '5 cm'
  WHEN k % 16 = 9 THEN CAST(1000 + k % 900 AS VARCHAR(10)) || ' ' || p_name || ' EUR ' || price
  WHEN k % 16 = 10 THEN '100 2026 EUR 101 2026 EUR 102 2026 EUR'
  WHEN k % 16 = 11 THEN 'Terms and conditions; warranty and liability apply: ' || p_name
  WHEN k % 16 = 12 THEN 'Code Description Price'
  WHEN k % 16 = 13 THEN 'Weight kg 93,40'
  WHEN k % 16 = 14 THEN '1 × corner ' || code || ' 2 × central Z' || code
  WHEN k % 16 = 15 THEN code || ' ' || p_name || ' DKK ' || price || ' EUR ' || sz || ',50'
  ELSE code || ' ' || p_name || ' EUR ' || price END AS line
FROM b
"""


def catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_file, page_number, line_no and line of the catalogue view."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_name", "p_retailprice", "p_size")
    return spark.sql(CATALOG_SQL.replace("FROM part)", "FROM {part})"), part=part)


def page_lines(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """Lines of a table of pages (source_file, page_number and a text), normalised and numbered from 0."""
    from pricelore.functions.text import normalize_text, split_lines

    return pages.select("source_file", "page_number", F.posexplode(split_lines(normalize_text(F.col(text_col)))).alias("line_no", "line"))


def parse_page_range(text: str | None) -> list[int] | None:
    """"2-5,7" to sorted page numbers; reversed ranges count, parts that can't be read don't. None if nothing is left."""
    pages: set[int] = set()
    for part in (text or "").split(","):
        ends = [e.strip() for e in part.split("-")]
        if not all(e.isdigit() for e in ends) or len(ends) > 2:
            continue
        low, high = sorted((int(ends[0]), int(ends[-1])))
        pages.update(range(low, high + 1))
    pages.discard(0)
    return sorted(pages) or None


def prune_pages(pages: DataFrame, page_range: str | None) -> DataFrame:
    """Only the pages of a range; the filter reaches the scan."""
    chosen = parse_page_range(page_range)
    return pages if chosen is None else pages.filter(F.col("page_number").isin(chosen))


def needs_ocr(pages: DataFrame) -> DataFrame:
    return pages.withColumn("needs_ocr", (F.length("text") < 40) & (F.col("images_count") > 0))


def file_hash(content):
    return F.substring(F.sha1(content), 1, 8)
