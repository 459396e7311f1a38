"""Lines and pages with known readings."""

from pricelore.operators import lines as ln
from pricelore.operators import pages as pg
from pricelore.operators import reports as rp
from pricelore.operators import rows as rw
from pricelore.sources.catalog import page_lines, parse_page_range


def judged(spark, *texts):
    lines = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(texts)], "source_file string, page_number int, line_no int, line string")
    return rw.hard_validation(rw.noise_class(rw.discard_reason(ln.parse_rows(ln.line_info(lines))))).orderBy("line_no").collect()


def test_lines(spark):
    known = {
        "QX4471 Garden bench EUR 310": ("", ""),
        "2025 EUR": (None, None),
        "40 2024 EUR 41 2024 EUR": ("noise_toc_line", None),
        "Tom & Lou 88": ("noise_index", None),
        "EUR 2": ("noise_price_only", None),
        "Peso L2 4.070": ("noise_weight_dim", None),
        "3 × end unit 7QXRA220 1 × middle unit 7QXRM220": ("noise_composition", None),
        "7QXRM220 EUR 2": ("noise_header_eur1", None),
        "Secondo l'articolo 9 della Direttiva 1999/44/EC EUR 80": (None, "hard_legal"),
        "870 larg. larg. EUR 960": (None, "dim_only_row"),
    }
    rows = judged(spark, *known)
    for row, (noise, hard) in zip(rows, known.values()):
        assert noise is None or row.noise_class == noise, row.line
        assert hard is None or row.hard_reason == hard, row.line
    by = {r.line: r for r in rows}
    assert by["2025 EUR"].price_candidates == []
    assert by["QX4471 Garden bench EUR 310"].art_no == "QX4471" and by["QX4471 Garden bench EUR 310"].price == 310.0


def test_codes_that_are_none(spark):
    for row in judged(spark, "LED 4000K.", "M2", "35W", "E14/E12", "T05/T08", "K", "2290 Plain stool EUR 75"):
        assert row.code_candidates == [] and row.art_no == "", row.line
    assert judged(spark, "Weight kg 93,40")[0].price_candidates == []


def test_contents_page(spark):
    lines = spark.createDataFrame([("d", p, i, t) for p, texts in enumerate((["40 2024 EUR", "41 2024 EUR", "42 2024 EUR"], ["QX44-71 Bench 310 2024 EUR", "QX44-72 Bench 311 2024 EUR", "QX44-73 Bench 312 2024 EUR"])) for i, t in enumerate(texts)], "source_file string, page_number int, line_no int, line string")
    hard, soft = pg.page_signals(ln.line_info(lines)).orderBy("page_number").collect()
    assert hard.toc_hard and soft.toc_like and not soft.toc_hard


def test_triage_with_tables(spark):
    lines = [("table", 1, i, f"{i} {i + 1} {i + 2} {i + 3}") for i in range(12)] + [("weak", 1, i, "a b c d e f g") for i in range(12)]
    lines += [("marker", 1, i, "Art. no. 1 RRP EUR 10") for i in range(20)] + [("short", 1, 0, "x"), ("prose", 1, 0, "EUR 5 " + "word " * 30)]
    df = spark.createDataFrame(lines, "source_file string, page_number int, line_no int, line string")
    words = [(d, p, w, 40.0 * x, 10.0 * n) for d, p, n, line in lines for x, w in enumerate(line.split(" "))]
    tables = pg.table_metrics(spark.createDataFrame(words, "source_file string, page_number int, text string, x0 double, top double"))
    got = {r.source_file: (r.profile, r.table_columns, r.table_score, r.decision) for r in pg.triage_with_tables(df, tables).collect()}
    assert got["table"] == ("table_based", 4, 9.0, "OK") and got["weak"] == ("table_based", 7, 7.0, "FORSE")
    assert got["marker"][0] == "marker" and got["marker"][3] == "OK"
    assert got["short"] == ("unknown", 0, 0.0, "NO") and got["prose"] == ("unknown", 0, 0.0, "FORSE")


def test_run_scores(spark):
    rows = [("d", "AB1234", "Chair", 10.0, True, True), ("d", "AB1234", "Chair", 12.0, True, True), ("d", "CD5678", "Sofa", 9.0, True, True), ("d", "CD5678", "sofa ", 9.0, False, True), ("e", "EF9012", "Lamp", 3.0, True, False), ("f", "GH3456", "Rug", 3.0, False, True), ("f", "GH3456", "Mat", 3.0, False, True)]
    df = spark.createDataFrame(rows, "source_file string, art_no string, name string, price double, exported boolean, needs_review boolean")
    got = {r.source_file: (r.n_conflicts, r.duplicate_conflicts_rate, r.run_score) for r in rp.run_scores(df, rw.duplicate_conflicts(df)).collect()}
    assert got["d"][:2] == (1, 1 / 3) and abs(got["d"][2] - (1 + 0.6 * 0.5 - 0.5 - 0.8 / 3)) < 1e-9
    assert got["e"][:2] == (0, 0.0) and got["f"][:2] == (1, 0.0)


def test_sample_counts(spark):
    df = pg.sample_counts(spark.createDataFrame([(40,), (150,), (350,), (900,)], "n_pages long")).orderBy("n_pages")
    assert [r.n_sample for r in df.collect()] == [8, 8, 8, 9]


def test_page_ranges():
    assert parse_page_range("2-5,7") == [2, 3, 4, 5, 7] and parse_page_range("5-2,x") == [2, 3, 4, 5] and parse_page_range("") is None


def test_page_lines(spark):
    pages = spark.createDataFrame([("d", 1, " a  b \n\nc-\nd\tø"), ("d", 2, None)], "source_file string, page_number int, text string")
    assert [r.line for r in page_lines(pages).orderBy("line_no").collect()] == ["a b", "cd o"]


def test_dimensions_are_taken_from_the_left(spark):
    """n x n x n is one dimension; of four numbers the last stands alone. A label and a number go with their unit."""
    rows = judged(spark, "10 x 20 x 30 x 40", "H 45 cm 7 x 8", "W 12 H 3 mm", "5 x 6 x 7 cm 9")
    taken = [[t.token for t in r.toks if t.consumed] for r in rows]
    assert taken == [["10", "x", "20", "x", "30"], ["H", "45", "cm", "7", "x", "8"], ["W", "12", "H", "3", "mm"], ["5", "x", "6", "x", "7", "cm"]]


def test_units_of_area_and_contents_with_euro_signs(spark):
    rug, pairs = judged(spark, "Rug 120 m² wool", "40 2024 €1 41 2024 €1 x")
    assert rug.dimension_line and not rug.price_like and pairs.toc_pairs == ["40", "41"]
