"""Sinks: the sheets of products and of what needs review, triage and corpus reports, debug payloads, and workbooks of bounded size."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in a sheet of a workbook, at most: workbooks are for looking at, tables of any size go to Parquet.
MOST_ROWS = 1_048_575
#: Items of a list that a cell shows.
MOST_ITEMS = 200


def by_sheet_order(rows: DataFrame) -> DataFrame:
    """rows with __section and __code, by which sheets are sorted after the page."""
    section = F.lower(F.coalesce(F.col("section"), F.lit(""))) if "section" in rows.columns else F.lit("")
    return rows.withColumns({"__section": section, "__code": F.coalesce(F.col("art_no"), F.lit(""))})


def sheets(rows: DataFrame) -> dict[str, DataFrame]:
    """PRODUCTS: exported rows; REVIEW: those that need review or aren't exported. A row may be in both; noise is in neither."""
    visible = rows.filter(~F.coalesce(F.col("noise"), F.lit(False))) if "noise" in rows.columns else rows
    return {"PRODUCTS": visible.filter("exported"), "REVIEW": visible.filter("needs_review OR NOT exported")}


def write_sheets(rows: DataFrame, path: str, allow_empty: bool = False, format: str = "parquet") -> bool:
    """Write both sheets under path, a folder each, in order within a document. Spark's committer puts a whole sheet in place of the last
    one. Without an exported row nothing is written, unless allow_empty; says whether anything was."""
    both = sheets(rows)
    if not allow_empty and both["PRODUCTS"].isEmpty():
        return False
    for name, sheet in both.items():
        ordered = by_sheet_order(sheet).repartition("source_file").sortWithinPartitions("source_file", "page_number", "__section", "__code", "line_no").drop("__section", "__code")
        ordered.write.mode("overwrite").option("header", "true").format(format).save(f"{path}/{name.lower()}")
    return True


def list_text(c, most: int = MOST_ITEMS):
    """A list as text, cut after so many items."""
    shown = F.array_join(F.transform(F.slice(c, 1, most), lambda x: x.cast("string")), ",")
    return F.when(F.size(c) > most, F.concat(shown, F.lit(",..."))).otherwise(shown)


def flat(df: DataFrame) -> DataFrame:
    """df with lists and maps as text, for formats that have none."""
    def plain(name: str, kind: str):
        if kind.startswith("array<struct") or kind.startswith("map") or kind.startswith("struct"):
            return F.to_json(F.col(f"`{name}`")).alias(name)
        return list_text(F.col(f"`{name}`")).alias(name) if kind.startswith("array") else F.col(f"`{name}`")

    return df.select(*[plain(n, k) for n, k in df.dtypes])


def write_triage_report(results: DataFrame, attempts: DataFrame, path: str) -> None:
    """A row a document, and a row an attempt, as CSV with headings: sheets triage and attempts."""
    flat(results).write.mode("overwrite").option("header", "true").csv(f"{path}/triage")
    flat(attempts).write.mode("overwrite").option("header", "true").csv(f"{path}/attempts")


def write_corpus_report(report: DataFrame, path: str) -> None:
    flat(report).write.mode("overwrite").option("header", "true").csv(f"{path}/corpus")


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a line: groups, missing labels, suggested profiles, debug payloads."""
    df.write.mode("overwrite").json(path)


def debug_payloads(documents: DataFrame, key: str = "source_file", order: str = "seq") -> DataFrame:
    """The last payload of each document, by its place in `order`: path and payload, a JSON text."""
    columns = [c for c in documents.columns if c != order]
    return documents.groupBy(F.col(key).alias("path")).agg(F.max_by(F.to_json(F.struct(*columns)), order).alias("payload"))


def summary(results: DataFrame) -> DataFrame:
    """Keys and values of a one-row table, in order."""
    pairs = [F.struct(F.lit(i).alias("n"), F.lit(n).alias("key"), (F.to_json(F.col(n)) if k.startswith(("array", "map", "struct")) else F.col(n).cast("string")).alias("value")) for i, (n, k) in enumerate(results.dtypes)]
    return results.select(F.inline(F.array(*pairs)))


def manifest(spark: SparkSession, inputs: DataFrame, config: dict, run: str) -> DataFrame:
    """One row that says what a run read and with which settings: run, documents with their hashes, and the settings as JSON."""
    files = inputs.agg(F.array_sort(F.collect_list(F.struct("path", "sha1_8", "length"))).alias("inputs"), F.count("*").alias("n_inputs"))
    return files.select(F.lit(run).alias("run_id"), "n_inputs", F.to_json("inputs").alias("inputs"), F.lit(json.dumps(config, sort_keys=True)).alias("config"))


def _cell(column: int, row: int, value) -> str:
    name = ""
    n = column + 1
    while n:
        n, rest = divmod(n - 1, 26)
        name = chr(65 + rest) + name
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{name}{row}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{name}{row}"><v>{value}</v></c>'
    text = "".join(ch for ch in str(value) if ch in "\t\n\r" or ord(ch) >= 32)
    return f'<c r="{name}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def workbook(parts: dict[str, tuple[list[str], Iterable]]) -> bytes:
    """A workbook in the Open XML format: for each sheet its headings and rows."""
    out = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, (columns, rows) in enumerate(parts.values(), 1):
            with z.open(f"xl/worksheets/sheet{n}.xml", "w") as f:
                f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                for i, row in enumerate([columns, *([*r] for r in rows)] if not hasattr(rows, "__next__") else _headed(columns, rows), 1):
                    f.write(f'<row r="{i}">{"".join(_cell(c, i, v) for c, v in enumerate(row))}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
        names = "".join(f'<sheet name="{escape(name)}" sheetId="{n}" r:id="rId{n}"/>' for n, name in enumerate(parts, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{n}" Type="{rel}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(parts) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets_xml = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in range(1, len(parts) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{sheets_xml}</Types>')
    return out.getvalue()


def _headed(columns, rows):
    yield columns
    yield from rows


def write_workbook(tables: dict[str, DataFrame], path: str, most: int = MOST_ROWS) -> None:
    """Tables as one workbook on the driver, a sheet each, for one document or a report: a table of more than `most` rows is refused. Rows
    stream through the driver, and the file takes the place of the last one at once."""
    import os

    for name, df in tables.items():
        if df.limit(most + 1).count() > most:
            raise ValueError(f"{name} has more rows than a sheet holds; write it as a table")
    body = workbook({name: (list(df.columns), (tuple(r) for r in flat(df).toLocalIterator())) for name, df in tables.items()})
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.tmp", "wb") as f:
        f.write(body)
    os.replace(f"{path}.tmp", path)
