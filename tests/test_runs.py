"""A folder of documents from files to sheets."""

import json

from pricelore.plans import runs


def test_folder_to_sheets(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "codes.txt").write_text("Garden Furniture\n" + "\n".join(f"QX44{i}1 Garden bench EUR {i}10,00" for i in range(1, 9)) + "\fQX4491 Stool EUR 12,50")
    (folder / "marks.txt").write_text("\n".join(f"Vase {n}, black ** RRP\nColli: 4\nArt. no: AB-4{n}71\nEUR {n}9,00" for n in range(1, 8)))
    (folder / "prose.txt").write_text("once upon a time")
    (folder / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    row = runs.run_folder(spark, str(folder), str(out)).first()
    assert (row.documents, row.converted, row.skipped) == (3, 2, 1)
    products = {(r.source_file, r.art_no, r.name, r.price, r.parser, r.section) for r in spark.read.parquet(str(out / "sheets" / "products")).collect()}
    assert ("codes.txt", "QX4491", "Stool EUR", 12.5, "code_price_based", "Garden Furniture") in products
    assert ("marks.txt", "AB-4171", "Vase 1", 19.0, "marker", None) in products and len(products) == 16
    report = {r.source_file: (r.decision, r.final_status) for r in spark.read.option("header", "true").csv(str(out / "reports" / "triage")).collect()}
    assert report == {"codes.txt": ("OK", "CONVERTED(parser=code_price_based)"), "marks.txt": ("OK", "CONVERTED(parser=marker)"), "prose.txt": ("NO", "SKIPPED"), "bad.txt": ("NO", "FAILED")}
    manifest = spark.read.json(str(out / "manifest")).first()
    assert manifest.n_inputs == 4 and json.loads(manifest.config)["target_currency"] == "EUR"
    only = runs.run_folder(spark, str(folder), str(out), pattern="codes.txt", page_range="2").first()
    assert only.documents == 1 and spark.read.parquet(str(out / "sheets" / "products")).count() == 1
