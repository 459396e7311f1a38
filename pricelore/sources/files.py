"""Files: folders of documents, page readers that are plugged in, and stored signals that are read again while nothing has changed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelore.config import CONFIG
from pricelore.functions import labels as lb

PAGES = "source_file string, page_number int, text string, images_count int, words array<struct<text:string,x0:double,top:double>>, error string"
#: A reader turns a file's bytes into pages: page number from 1, text, number of pictures, and words with positions.
Reader = Callable[[bytes], Iterable[tuple]]


def text_pages(content: bytes) -> Iterable[tuple]:
    """Plain text, a page up to each form feed."""
    for n, text in enumerate(content.decode("utf-8").split("\f"), 1):
        yield n, text, 0, []


#: Readers by the ending of a file's name.
READERS: dict[str, Reader] = {"txt": text_pages}


def register(ending: str, reader: Reader) -> None:
    READERS[ending.lower()] = reader


def files(spark: SparkSession, folder: str, pattern: str = "*.txt", recursive: bool = False) -> DataFrame:
    """path, name (below the folder), length, modified, content and sha1_8 of a folder's files."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    root = folder.rstrip("/").removeprefix("file:") + "/"
    name = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + "".join(f"\\{c}" if not c.isalnum() and c != "/" else c for c in root), "")
    return df.select("path", name.alias("name"), "length", F.col("modificationTime").alias("modified"), "content", F.substring(F.sha1("content"), 1, 8).alias("sha1_8"))


def read_pages(found: DataFrame, pages: list[int] | None = None, readers: dict[str, Reader] | None = None) -> DataFrame:
    """The pages of files, read by the reader for their ending. A file that can't be read gives one row with an error and no page, so one
    bad file stops nothing. pages: only those numbers."""
    known = dict(READERS if readers is None else readers)
    wanted = None if pages is None else frozenset(pages)

    def run(batches):
        schema = pa.schema([("source_file", pa.string()), ("page_number", pa.int32()), ("text", pa.string()), ("images_count", pa.int32()), ("words", pa.list_(pa.struct([("text", pa.string()), ("x0", pa.float64()), ("top", pa.float64())]))), ("error", pa.string())])
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                try:
                    for number, text, images, words in known[name.rpartition(".")[2].lower()](content):
                        if wanted is None or number in wanted:
                            rows.append((name, number, text, images, [{"text": t, "x0": x, "top": y} for t, x, y in words], None))
                except Exception as e:  # noqa: BLE001 - whatever a reader raises becomes the file's row
                    rows = [(name, None, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return found.select("name", "content").mapInArrow(run, PAGES)


def with_ocr(pages: DataFrame, recognise: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """pages with text_len, needs_ocr and ocr_used: pages of little text and some pictures get the text that `recognise` finds (source_file, page_number and
    ocr_text of the pages it is given), if it finds any, and lose their words, which have other positions."""
    df = pages.withColumn("text_len", F.length(F.trim(F.coalesce("text", F.lit("")))))
    df = df.withColumn("needs_ocr", (F.col("text_len") < CONFIG.ocr_text_max) & (F.coalesce("images_count", F.lit(0)) > 0))
    if recognise is None:
        return df.withColumn("ocr_used", F.lit(False))
    read = recognise(df.filter("needs_ocr")).select("source_file", "page_number", "ocr_text")
    df = df.join(read, ["source_file", "page_number"], "left").withColumn("ocr_used", F.coalesce(F.col("ocr_text") != "", F.lit(False)))
    df = df.withColumn("text", F.when(F.col("ocr_used"), F.col("ocr_text")).otherwise(F.col("text")))
    df = df.withColumn("text_len", F.length(F.trim(F.coalesce("text", F.lit("")))))
    if "words" in df.columns:
        df = df.withColumn("words", F.when(~F.col("ocr_used"), F.col("words")))
    return df.drop("ocr_text")


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("source_file").agg(F.coalesce(F.max("page_number"), F.lit(0)).alias("n_pages"))


def error_rows(pages: DataFrame) -> DataFrame:
    """A triage row for each file that could not be read."""
    return pages.filter(F.col("error").isNotNull()).select("source_file", F.lit("NO").alias("decision"), F.lit("error").alias("profile"), F.concat(F.lit("triage_error:"), F.col("error")).alias("reasons"))


def fingerprint(found: DataFrame, version: str, **settings) -> str:
    """A hash of which files there are, when they were changed and how large they are, and of the settings: while it stays the same, so do signals.
    Hashes are summed where the rows lie, so no list of files reaches the driver."""
    row = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("path", "modified", "length").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s")).first()
    return hashlib.sha1(json.dumps([version, row.n, row.s, settings], sort_keys=True).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of that key in the folder; made and stored there if it isn't complete."""
    path = f"{folder.rstrip('/')}/{key}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    done = hadoop(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def purge(spark: SparkSession, folder: str, keep: str) -> int:
    """Delete the stored tables of a folder but the one of that key; says how many went."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for status in fs.listStatus(root) if fs.exists(root) else ():
        if status.isDirectory() and status.getPath().getName() != keep and len(status.getPath().getName()) == 40:
            gone += bool(fs.delete(status.getPath(), True))
    return gone


def dictionaries(base: str | None, profile: str | None) -> dict:
    """The label dictionary with a profile's labels."""
    return lb.merged(lb.load(base), lb.load(profile, {}))
