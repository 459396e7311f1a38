"""Documents as they come in: pages that land in a folder become products, each once, without reading the old ones again.

Everything from a page's text to an exported row looks at one line alone, so the stream needs no state and no watermark. What looks at
whole documents, duplicates and reports, reads the table that the stream writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pricelore.operators import lines as ln
from pricelore.operators import rows as rw
from pricelore.sources.catalog import page_lines

PAGES = "source_file string, page_number int, text string"


def pages_stream(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Pages (source_file, page_number and text) of Parquet files as they land in a folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def products(pages: DataFrame) -> DataFrame:
    """The exported and reviewed rows of pages, of a stream or of a table."""
    rows = rw.export_rows(ln.parse_rows(ln.line_info(page_lines(pages))))
    return rows.select("source_file", "page_number", "line_no", "line", "art_no", "name", "price", "confidence", "exported", "needs_review", "notes")


def write_products(pages: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write a stream's rows under path. The checkpoint says what has been read, so a stream that is begun again goes on where it was; with
    once it ends when all that has landed is read."""
    out = products(pages).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
