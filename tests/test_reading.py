"""Blocks, parsers, tables, samples, the choice of a way, reports, sources and sinks, on small cases and against plain versions."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from pricelore.functions import labels as lb
from pricelore.functions import markers as mk
from pricelore.functions import text as tx
from pricelore.operators import blocks as bl
from pricelore.operators import choice as ch
from pricelore.operators import lines as ln
from pricelore.operators import pages as pg
from pricelore.operators import reports as rp
from pricelore.operators import rows as rw
from pricelore.operators import sampling as sm
from pricelore.operators import tables as tb
from pricelore.sinks import writers
from pricelore.sources import files

LINES = "source_file string, page_number int, line_no int, line string"


def lines_of(spark, pages):
    return spark.createDataFrame([(d, p, i, t) for (d, p), texts in pages.items() for i, t in enumerate(texts)], LINES)


# Blocks


def test_marker_blocks(spark):
    df = lines_of(spark, {("d", 1): ["intro", "Vase, black ** RRP", "Colli: 4", "Art. no: AB-12345", "Bowl ** RRP", "** RRP", "Art. no: CD-12345 EUR 3", "x", "Art. no: EF-12345"], ("d", 2): ["nothing here"]})
    got = [(r.line_no, r.part, r.block) for r in bl.marker_blocks(df).orderBy("line_no", "part").collect()]
    assert got == [
        (1, 0, "Vase, black ** RRP\nColli: 4\nArt. no: AB-12345"),
        (4, 0, "Bowl ** RRP\n** RRP\nArt. no: CD-12345 EUR 3\nx"),
        (4, 1, "Art. no: EF-12345"),
    ]


def plain_titled(lines):
    def title(x):
        return bool(x.strip()) and not any(m in x for m in ("Colli:", "Size:", "Designer:", "Art. no:", "RRP")) and "EUR 1" not in x

    blocks, current, have = [], [], False
    for i, line in enumerate(lines):
        if have and title(line) and any("Colli" in x for x in lines[i : i + 5]):
            blocks.append(current)
            current, have = [], False
        current.append(line)
        have = have or "Art. no:" in line
    blocks.append(current)
    texts = ["\n".join(x for x in b if x.strip()) for b in blocks]
    return [t for t in texts if "RRP" in t and ("Art. no:" in t or "EUR 1" in t)]


def test_titled_blocks_against_a_fold(spark):
    rnd = random.Random(3)
    pages = {("d", p): [rnd.choice(["Lamp", "Chair tall", "Colli: 2", "Art. no: AB-12345", "RRP", "EUR 1,50", " "]) for _ in range(rnd.randint(1, 25))] for p in range(1, 60)}
    got = {}
    for r in bl.titled_blocks(lines_of(spark, pages)).orderBy("page_number", "line_no").collect():
        got.setdefault(r.page_number, []).append(r.block)
    assert got == {p: b for (_, p), texts in pages.items() if (b := plain_titled(texts))}


def test_continuations_against_a_fold(spark):
    rnd = random.Random(4)
    rows = []
    for d in range(30):
        page = 1
        for i in range(rnd.randint(1, 14)):
            page += rnd.choice((0, 0, 1, 1, 2))
            rows.append((f"d{d}", page, i, 0, rnd.choice(["Art. no: AB-12345", "EUR 5", "plain", "EUR 7 x"])))
    df = spark.createDataFrame(rows, "source_file string, page_number int, line_no int, part int, block string")
    want = []
    for d in range(30):
        heads = []
        for _, page, i, part, text in [r for r in rows if r[0] == f"d{d}"]:
            if "EUR" in text and heads and page - heads[-1][1] in (0, 1):
                heads[-1][4] += "\n" + text
                heads[-1][5] = "; ".join(x for x in (heads[-1][5], "" if "continuation_attached" in heads[-1][5] else "continuation_attached") if x)
            else:
                heads.append([f"d{d}", page, i, part, text, "orphan_block_no_art_no" if "EUR" in text else ""])
        want += map(tuple, heads)
    got = [tuple(r) for r in bl.attach_continuations(df).select("source_file", "page_number", "line_no", "part", "block", "note").collect()]
    assert sorted(got) == sorted(want)


def test_merged_blocks(spark):
    df = spark.createDataFrame([("d", 1, 0, 0, "Lamp\nArt. no: AB-12345\nArt.no: CD-12345 x", "n"), ("d", 1, 5, 0, "Art no: EF-12345", "")], "source_file string, page_number int, line_no int, part int, block string, note string")
    got = [(r.line_no, r.sub_part, r.block, r.note) for r in bl.split_merged(df).orderBy("line_no", "sub_part").collect()]
    assert got == [(0, 0, "Lamp\nArt. no: AB-12345", "n; merged_block_split_by_art_no"), (0, 1, "Art.no: CD-12345 x", "n; merged_block_split_by_art_no"), (5, 0, "Art no: EF-12345", "")]


def test_marker_fields_of_a_block(spark):
    block = "Tall vase - light grey ** RRP\nDesigner:\nJane Doe\nColli: 6\nSize: W 12,5 cm H 30 cm D 8 cm\nArt. no: AB-4471\nDKK 100 EUR 12,50 SEK 2026 EUR 13"
    df = spark.createDataFrame([("d", 1, 0, 0, block), ("d", 1, 9, 0, "Cup (2 l) ** RRP\nSize: O 20 cm\nArt. no: none")], "source_file string, page_number int, line_no int, part int, block string")
    a, b = bl.marker_rows(df).orderBy("line_no").collect()
    assert (a.art_no, a.art_no_raw, a.name, a.variant, a.designer, a.colli) == ("AB-4471", "AB-4471", "Tall vase", "light grey", "Jane Doe", 6)
    assert (a.width_cm, a.height_cm, a.length_cm, a.size_unparsed) == (12.5, 30.0, 8.0, False)
    assert (a.price_dkk, a.price_sek, a.price_eur, a.parse_notes) == (100.0, None, 13.0, "invalid_price_sek")
    assert (b.art_no, b.name, b.variant, b.width_cm, b.height_cm) == ("", "Cup", "2 l", 20.0, None)


@pytest.mark.parametrize("title, want", [
    ("Bowl, oak", ("Bowl", "oak")), ("Bowl, tall", ("Bowl, tall", "")), ("Tray (matte black)", ("Tray", "matte black")), ("Jug light grey", ("Jug", "light grey")),
    ("Jug steel", ("Jug", "steel")), ("steel", ("", "steel")), ("Can 5 cm / 5 cm", ("Can 5 cm", "5 cm")), ("", ("", "")), ("Set-up, a-b", ("Set-up, a-b", "")),
])
def test_variants(spark, title, want):
    row = spark.range(1).select(mk.name_and_variant(F.lit(title)).alias("r")).first().r
    assert (row.name, row.variant) == want


def test_sizes(spark):
    texts = ["W20 x H30 x L40 cm", "L20 cm x W30 cm x H40,5 cm", "W 0 cm", "about 20", "H 3 cm"]
    got = [tuple(r.s) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mk.sizes(F.col("t")).alias("s")).collect()]
    assert got == [(20.0, 30.0, 40.0), (30.0, 40.5, 20.0), (None, None, None), (None, None, None), (None, 3.0, None)]


# Tables


def test_table_rows(spark):
    df = lines_of(spark, {("d", 1): ["AB-4471  Lamp  tall  EUR 12,50", "one column", "CD-4471\tx"], ("d", 2): ["Price  Code  Description", "9,00  EF-4471  Chair"], ("e", 1): ["GH-4471  Rug  1.200,00"]})
    got = [(r.source_file, r.page_number, r.art_no, r.name, r.price) for r in tb.table_rows(df).orderBy("source_file", "page_number", "line_no").collect()]
    assert got == [("d", 1, "", "tall", 4471.0), ("d", 1, "", "", 4471.0), ("d", 2, "EF-4471", "Chair", 9.0), ("e", 1, "GH-4471", "Rug", 1200.0)]
    first = tb.table_rows(df, last_header=False).filter("page_number = 1 AND source_file = 'd'").orderBy("line_no").first()
    assert (first.art_no, first.name, first.price) == ("AB-4471", "Lamp tall", 12.5)
    checks = {r.source_file: (r.ok, r.reason) for r in tb.precheck(df, tb.estimate_columns(df)).collect()}
    assert checks == {"d": (True, ""), "e": (True, "")}


def word_rows(pages):
    return [(d, p, t, float(x), float(y)) for (d, p), words in pages.items() for t, x, y in words]


WORDS = "source_file string, page_number int, text string, x0 double, top double"


def test_stitched_rows(spark):
    pages = {
        ("d", 1): [("QX-4471", 10, 5), ("Lamp", 60, 6), ("tall", 80, 5), ("EUR", 220, 5), ("120", 250, 7)],
        ("d", 2): [("QX-4471", 10, 5), ("Lamp", 60, 5), ("35,00", 90, 25), ("36,00", 90, 45), ("QX-4472", 10, 65), ("a", 1, 85), ("b", 1, 105), ("c", 1, 125), ("9,00", 90, 145)],
        ("d", 3): [("10,00", 0, 5), ("QX-4473", 30, 5), ("QX-4474", 60, 5), ("2026", 90, 5), ("12", 120, 5), ("cm", 130, 5), ("wide", 150, 5), ("44,00€", 200, 5)],
    }
    got = [(r.page_number, r.line_text, r.ambiguous, r.windowed) for r in tb.stitch_rows(spark.createDataFrame(word_rows(pages), WORDS)).orderBy("page_number", "cluster").collect()]
    assert got == [(1, "QX-4471 Lamp tall EUR 120", False, False), (2, "QX-4471 EUR 35,00", False, True), (3, "QX-4474 cm wide EUR 44,00", True, False)]
    many = {("d", 1): [w for i in range(60) for w in ((f"QX-{4000 + i}", 10, 20 * i), ("5,00", 90, 20 * i))]}
    assert tb.stitch_rows(spark.createDataFrame(word_rows(many), WORDS)).count() == 40


def test_clusters_by_a_running_middle(spark):
    tops = [0, 2.9, 4.4, 6.5, 20, 22, 26.1]
    df = spark.createDataFrame([("d", 1, str(t), 1.0, t) for t in map(float, tops)], WORDS)
    got = [[w.top for w in r.words] for r in tb.clusters(df).orderBy("cluster").collect()]
    want, mid = [], None
    for t in map(float, tops):
        if mid is None or abs(t - mid) > 3:
            want.append([])
            mid = t
        else:
            mid = (mid + t) / 2
        want[-1].append(t)
    assert got == want


# Samples


def signals(rows):
    names = ("source_file", "page_number", "row_candidate_count", "cooccurrence_near_count", "mixed_code_count", "cooccurrence_count", "signal_score", "toc_hard", "toc_like", "has_stopword", "text_len", "images_count", "needs_ocr", "table_hint")
    return [tuple(float(r.get(n, 0)) if n == "signal_score" else r.get(n, 0) if n not in ("toc_hard", "toc_like", "has_stopword", "needs_ocr", "table_hint") else bool(r.get(n)) for n in names) for r in rows], "source_file string, page_number int, row_candidate_count int, cooccurrence_near_count int, mixed_code_count int, cooccurrence_count int, signal_score double, toc_hard boolean, toc_like boolean, has_stopword boolean, text_len int, images_count int, needs_ocr boolean, table_hint boolean"


def test_samples(spark):
    for n, count in ((900, 9), (37, 8), (8, 8), (5, 9), (0, 3), (100, 60)):
        got = sm.sample_of(n, count, 7)
        assert got == sorted(set(got)) and len(got) == min(n, count) and all(1 <= p <= n for p in got)
    assert sm.seed_of("a", 1.0, "initial") == sm.seed_of("a", 1.0, "initial") != sm.seed_of("a", 2.0, "initial")
    docs = spark.createDataFrame([("a", 900, 9), ("b", 3, 3), ("c", 0, 0)], "source_file string, n_pages int, n_sample int")
    got = {}
    for r in sm.sample_pages(docs).collect():
        got.setdefault(r.source_file, []).append(r.page_number)
    assert {225, 450, 675} <= set(got["a"]) and 9 <= len(got["a"]) <= 12 and sorted(got["b"]) == [1, 2, 3] and "c" not in got
    swept = {r.source_file: (r.n, r.step) for r in sm.sweep_pages(docs).groupBy("source_file", "step").agg(F.count("*").alias("n")).collect()}
    assert swept == {"a": (40, 23), "b": (1, 10)}


def test_early_stops_and_sweeps(spark):
    strong = {"signal_score": 13.0, "cooccurrence_count": 1}
    pages = [{"source_file": "a", "page_number": p} | (strong if p % 2 else {}) for p in range(1, 30)] + [{"source_file": "b", "page_number": p} | strong | {"has_stopword": True} for p in range(1, 15)]
    df = spark.createDataFrame(*signals(pages))
    got = sm.early_stop(df)
    assert {r.source_file: r.n for r in got.groupBy("source_file").agg(F.count("*").alias("n")).collect()} == {"a": 8, "b": 14}
    assert [r.page_number for r in got.filter("stopped").collect()] == [8]
    swept = spark.createDataFrame([("a", p) for p in range(2, 30, 5)], "source_file string, page_number int")
    got = sorted((r.page_number, r.hit) for r in sm.sweep_hits(df, swept).collect())
    assert got == [(2, False), (5, False), (6, False), (7, True), (8, False), (9, False)]


def plain_best(pages, k, least=0, exclude=False):
    key = lambda p: (-p["row_candidate_count"], -p["cooccurrence_near_count"], -p["mixed_code_count"], -p["cooccurrence_count"], -p["signal_score"], p["page_number"])
    again = lambda p: (-p["row_candidate_count"], -p["cooccurrence_near_count"], -p["mixed_code_count"], -p["signal_score"], p["page_number"])
    left = [p for p in pages if not p["toc_hard"]]
    pool = left if exclude and len(left) >= k else pages
    beside = [p for p in pool if p["cooccurrence_count"] > 0] or [p for p in pool if p["cooccurrence_near_count"] > 0]
    out = sorted(beside, key=key)[: min(3, k, len(beside))]
    out += sorted([p for p in pool if p not in out], key=key)[: max(0, k - len(out))]
    out += sorted([p for p in pool if p not in out], key=again)[: max(0, least - len(out))]
    return [p["page_number"] for p in out]


def test_best_pages_against_a_plain_version(spark):
    rnd = random.Random(6)
    docs = {f"d{d}": [{"source_file": f"d{d}", "page_number": p, "toc_hard": rnd.random() < 0.4, "signal_score": float(rnd.randint(0, 5))} | {c: rnd.choice((0, 0, 1, 2)) for c in ("row_candidate_count", "cooccurrence_near_count", "mixed_code_count", "cooccurrence_count")} for p in range(1, rnd.randint(2, 20))] for d in range(25)}
    df = spark.createDataFrame(*signals([p for d in docs.values() for p in d]))
    for k, least, exclude in ((1, 8, False), (5, 0, True), (4, 6, True)):
        got = {}
        for r in sm.best_pages(df, k, least=least, exclude_toc=exclude).orderBy("source_file", "page_rank").collect():
            got.setdefault(r.source_file, []).append(r.page_number)
        assert got == {d: plain_best(p, k, least, exclude) for d, p in docs.items()}
    only = sm.best_pages(df, 2, only_cooccurring=True)
    assert only.groupBy("source_file").count().filter("count > 2").count() == 0
    order = sm.eval_order(df).filter("eval_rank = 1").count()
    assert order == 25


def test_readable_and_ocr_pages(spark):
    pages = [{"source_file": "a", "page_number": p, "text_len": 100 * (p != 3), "has_stopword": p == 2} for p in range(1, 6)] + [{"source_file": "b", "page_number": p, "text_len": p} for p in range(1, 5)]
    pages += [{"source_file": "c", "page_number": p, "text_len": 5 - p, "images_count": p, "needs_ocr": True} for p in range(1, 5)]
    df = spark.createDataFrame(*signals(pages))
    got = [(r.source_file, r.page_number, r.fallback) for r in sm.readable_pages(df, 2).orderBy("source_file", "page_rank").collect()]
    assert got == [("a", 1, False), ("a", 4, False), ("b", 4, True), ("b", 3, True), ("c", 1, True), ("c", 2, True)]
    assert [r.page_number for r in sm.ocr_pages(df).orderBy("ocr_rank").collect()] == [4, 3]


def test_adjusted_scores(spark):
    pages = [{"source_file": "a", "page_number": 1, "signal_score": 8.0, "toc_hard": True, "toc_like": True}, {"source_file": "a", "page_number": 2, "signal_score": 10.0, "table_hint": True}, {"source_file": "a", "page_number": 3, "signal_score": 10.0, "toc_like": True, "mixed_code_count": 1}]
    tables = spark.createDataFrame([("a", 2, 6, 0.2), ("a", 3, 6, 0.2)], "source_file string, page_number int, n_columns int, numeric_line_ratio double")
    got = {r.page_number: (r.signal_score, r.table_likelihood) for r in sm.adjusted_scores(spark.createDataFrame(*signals(pages)), tables).collect()}
    assert got == {1: (2.0, 0.0), 2: (9.0, 7.0), 3: (8.5, 0.0)}


# Choice


ROWS = "source_file string, parser string, page_number int, line_no int, eval_rank int, art_no string, name string, price double, exported boolean, needs_review boolean"


def test_metrics_and_judgement(spark):
    rows = [("d", "marker", 1, i, 1, f"AB-000{i}", "n", 1.0, True, False) for i in range(6)] + [("d", "marker", 1, 9, 1, "AB-0000", "other", 2.0, False, True)]
    rows += [("d", "table_based", 1, i, 1, "AB-0001", "n", 1.0, True, False) for i in range(3)]
    got = {r.parser: r for r in ch.judged(ch.metrics(spark.createDataFrame(rows, ROWS)).withColumn("eval_pages", F.lit(0))).collect()}
    a, b = got["marker"], got["table_based"]
    assert (a.reason, a.ok, a.duplicate_conflicts_count, a.rows_exported, a.eval_rows, a.excellent) == ("passed", True, 1, 6, 7, True)
    assert abs(a.score - (1 + 0.6 - 0.5 / 7 - 0.8 / 6)) < 1e-9
    assert (b.reason, b.ok) == ("too_few_rows", False) and abs(b.score - (1 + 0.6 / 3 - 0.5)) < 1e-9
    few = ch.judged(ch.metrics(spark.createDataFrame(rows[-1:], ROWS)).withColumn("eval_pages", F.lit(4))).first()
    assert few.ok and few.reason == "passed"


def test_choice_of_a_way(spark):
    def attempt(d, parser, ok, score, rows, review, excellent=False, reason="passed"):
        return (d, parser, ok, score, rows, rows, review, excellent, reason)

    attempts = spark.createDataFrame([
        attempt("a", "marker", True, 1.2, 9, 0.1, True), attempt("a", "table_based", True, 1.5, 9, 0.5), attempt("a", "code_price_based", True, 1.6, 9, 0.0),
        attempt("b", "marker", True, 1.0, 9, 0.5), attempt("b", "table_based", True, 1.0, 9, 0.4), attempt("b", "code_price_based", False, 9.0, 99, 0.0, False, "low_key_fields_rate"),
        attempt("c", "marker", False, 0.1, 3, 1.0, False, "too_few_rows"), attempt("c", "table_based", False, 0.0, 0, 1.0, False, "no_valid_rows_found"), attempt("c", "code_price_based", False, 0.2, 2, 1.0, False, "too_few_rows"),
        attempt("d", "marker", False, 0.0, 0, 1.0, False, "no_valid_rows_found"),
    ], "source_file string, parser string, ok boolean, score double, rows_exported int, eval_rows int, review_rate double, excellent boolean, reason string")
    triage = spark.createDataFrame([("a", "table_based", 0, 0), ("b", "unknown", 20, 20), ("c", "code_price_based", 0, 0), ("d", "marker", 0, 0)], "source_file string, profile string, art int, rrp int")
    order = triage.select("source_file", ch.order_of_ways(F.col("profile"), F.col("art"), F.col("rrp")).alias("ways"))
    assert {r.source_file: r.ways for r in order.collect()} == {"a": ["table_based", "marker", "code_price_based"], "b": ["marker", "table_based", "code_price_based"], "c": ["code_price_based", "marker", "table_based"], "d": ["marker", "table_based", "code_price_based"]}
    tried = ch.tried(attempts, order)
    assert tried.filter("source_file = 'a'").count() == 2  # the third way comes after an excellent one
    best = {r.source_file: (r.parser, r.final_status) for r in ch.best_runs(tried, triage).collect()}
    assert best == {"a": ("table_based", "CONVERTED(parser=table_based)"), "b": ("table_based", "CONVERTED(parser=table_based)"), "c": ("code_price_based", "REVIEW_ONLY(parser=code_price_based)")}
    samples = spark.createDataFrame([("a", 5, 3), ("b", 1, 3), ("c", 5, 3), ("d", 5, 3)], "source_file string, cooccurrence_pages int, cooccurrence_required int")
    plan = {r.source_file: (r.next_mode, r.multiplier, r.reason, r.then_mode) for r in ch.retry_plan(tried, samples).collect()}
    assert plan == {"a": ("", 1.0, "", ""), "b": ("retry_cooc", 2.0, "low_key_fields_rate", "sweep"), "c": ("retry", 2.0, "too_few_rows", "sweep"), "d": ("retry_no_rows", 2.0, "no_valid_rows_found", "sweep")}


def test_early_discards(spark):
    rows = [("a", "p", p, i, p, "" if i else "AB-0001", "n", None, True, False) for p in (1, 2, 3) for i in range(4)]
    rows += [("b", "p", p, i, p, "", "n", None, False, True) for p in (1, 2) for i in range(3)] + [("c", "p", p, i, p, f"AB-{p}{i}00", "n", 1.0, True, False) for p in (1, 2) for i in range(4)]
    got = {r.source_file: (r.discarded_at, r.reason) for r in ch.early_discards(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {"a": (2, "early_discard_low_key_fields"), "b": (2, "early_discard_no_rows")}


def test_attempt_text(spark):
    df = spark.createDataFrame([("marker", True, "passed", 7, 0.5, 1.0, 0.25, 0.0, 0, 1.2345)], "parser string, ok boolean, reason string, rows_exported int, unique_code_ratio double, key_fields_rate double, review_rate double, duplicate_conflicts_rate double, duplicate_conflicts_count int, score double")
    row = df.select(ch.attempt_text().alias("t")).select("t", ch.last_failure(F.col("t")).alias("why")).first()
    assert row.t.startswith("(marker:ok|passed|rows_exported=7,unique_code_ratio=0.50") and row.t.endswith("|score=1.235)") or row.t.endswith("|score=1.234)")
    assert row.why == "passed"


# Export


def exported(spark, texts, **options):
    rows = ln.parse_rows(ln.line_info(lines_of(spark, {("d", 1): texts})))
    return {r.line: r for r in rw.export_rows(rows, **options).collect()}


def test_export_rules(spark):
    got = exported(spark, ["QX4471 Garden bench", "QX4472 Garden bench EUR 310", "QX4473 Bench 310 cm depth 40 cm EUR 99", "Garden warranty terms QX4475 EUR 30"])
    bare, full = got["QX4471 Garden bench"], got["QX4472 Garden bench EUR 310"]
    assert not bare.exported and bare.needs_review and "missing_price" in bare.notes.split("; ") and "partial_export_weak_signal" in bare.notes
    assert full.exported and not full.needs_review and full.notes == "price_detected; artno_detected"
    assert all(len(set(r.notes.split("; "))) == len(r.notes.split("; ")) for r in got.values())
    legal = got.get("Garden warranty terms QX4475 EUR 30")
    assert legal is None or legal.exported and legal.confidence <= 0.3 and "hard_legal" in legal.notes
    strict = exported(spark, ["QX4471 Garden bench", "QX4472 Garden bench EUR 310", "QX4476 ab EUR 310"], mode="strict")
    assert "QX4471 Garden bench" not in strict and strict["QX4472 Garden bench EUR 310"].exported


def test_duplicate_policy(spark):
    rows = ln.parse_rows(ln.line_info(lines_of(spark, {("d", 1): ["QX4471 Garden bench EUR 310", "QX4471 Bench of oak EUR 320", "QX4471 see bench", "QX4472 Stool EUR 9,50"]})))
    got = {r.line: r for r in rw.apply_duplicates(rw.export_rows(rows)).collect()}
    best, other, sheet, alone = (got[t] for t in ("QX4471 Garden bench EUR 310", "QX4471 Bench of oak EUR 320", "QX4471 see bench", "QX4472 Stool EUR 9,50"))
    assert best.dup_verdict == alone.dup_verdict == "" and best.exported and not best.noise
    assert other.dup_verdict == "real_price_conflict" and other.exported and "SOFT_REVIEW:duplicate_variant" in other.notes
    assert sheet.dup_verdict == "technical_sheet_line" and sheet.noise and not sheet.exported and not sheet.needs_review
    summary = rw.duplicates_summary(rw.apply_duplicates(rw.export_rows(rows))).collect()
    assert [(r.art_no, r.n_rows, r.real_price_conflict, r.technical_sheet_line) for r in summary] == [("QX4471", 3, 1, 1)]


def test_missing_target_price(spark):
    df = spark.createDataFrame([("x", None, True, False), ("", None, True, False), ("x", 1.0, True, False), ("x", None, False, False)], "notes string, price double, exported boolean, needs_review boolean")
    assert [(r.notes, r.needs_review) for r in rw.ensure_prices(df, "DKK").collect()] == [("x; missing_price_dkk", True), ("missing_price_dkk", True), ("x", False), ("x", False)]


# Labels and reports


def test_labels(tmp_path, spark):
    path = tmp_path / "base.json"
    path.write_text(json.dumps({"version": "2", "fields": {"code": ["ref", "re:x+y"]}, "stopwords": ["a"]}))
    got = lb.merged(lb.load(str(path)), {"fields": {"code": ["ref", "sku"], "size": ["dim."]}})
    assert got == {"version": "2", "fields": {"code": ["ref", "re:x+y", "sku"], "size": ["dim."]}, "stopwords": ["a"]}
    assert lb.load(str(tmp_path / "none.json")) is lb.DEFAULT and lb.terms(got) == ["dim.", "ref", "sku"]
    (tmp_path / "bad.json").write_text("{")
    assert lb.load(str(tmp_path / "bad.json"), {}) == {}
    known = lb.patterns(got)
    row = spark.createDataFrame([("Ref and refs, xxy; DIM. 3  list   price",)], "t string").select(lb.hits(F.col("t"), "code", known).alias("c"), lb.hits(F.col("t"), "size", known).alias("s"), lb.hits(F.col("t"), "price", lb.patterns(lb.DEFAULT)).alias("p"), lb.hits(F.col("t"), "none", known).alias("n")).first()
    assert tuple(row) == (2, 1, 1, 0)


def test_small_names(spark):
    words = spark.createDataFrame([("prezzo",), ("taille",), ("code",), ("xyz",), ("article",), ("Listing",)], "w string")
    assert [r[0] for r in words.select(lb.language(F.col("w"))).collect()] == ["it", "fr", "en", "unknown", "unknown", "unknown"]
    assert [r[0] for r in words.select(lb.field_of(F.col("w"))).collect()] == ["price", "", "code", "", "art_no", "rrp"]
    row = spark.range(1).select(lb.safe_name(F.lit("._a b/c.pdf_")).alias("a"), lb.safe_name(F.lit("..")).alias("b"), lb.profile_id(F.lit("My File.pdf")).alias("c"), lb.run_id(F.lit("t"), F.lit("m"), F.lit("h")).alias("d"), lb.counts_text(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1))).alias("e")).first()
    assert tuple(row) == ("a_b_c.pdf", "pdf", "generated_my_file_pdf", "t_m_h", "a=1;b=2")


def test_risk_flags_and_groups(spark):
    docs = spark.createDataFrame([("a", 0, 0, False, False), ("b", 2, 10, True, True), ("c", 2, 500, True, True)], "source_file string, n_pages_read int, text_len int, needs_ocr boolean, has_stopword boolean")
    assert {r.source_file: r.risk_flags for r in rp.risk_flags(docs).collect()} == {"a": "no_content", "b": "low_text;scanned_likely;intro_only", "c": ""}
    docs = spark.createDataFrame([(f"d{i}", "marker", c, n, m) for i, (c, n, m) in enumerate([(0, 0.01, 0), (1, 0.05, 1), (7, 0.2, 2), (7, 0.3, 5), (4, 0.2, 1)])], "source_file string, parser string, table_columns int, numeric_density double, currencies int")
    got = [(r.group_id, r.size, r.avg_table_columns, r.examples) for r in rp.document_groups(docs).collect()]
    assert got[0] == ("marker_c6p_nhigh_cmulti", 2, 7.0, "d2,d3") and {g[0] for g in got[1:]} == {"marker_c0_nlow_cnone", "marker_c1_nmid_csingle", "marker_c4_nhigh_csingle"}


def test_words_that_no_dictionary_has(spark):
    df = lines_of(spark, {("a", 1): ["BREITE HOEHE", "Breite:", "plain text here", "PREIS 12,50:", "the and:"], ("b", 1): ["BREITE TIEFE"]})
    known = spark.createDataFrame([("tiefe",)], "word string")
    got = [(r.word, r.n, r.language, r.examples) for r in rp.unknown_words(df, known, ("the", "and")).orderBy(F.col("n").desc(), "word").collect()]
    assert got == [("breite", 3, "de", "BREITE HOEHE | Breite: | BREITE TIEFE"), ("hoehe", 1, "de", "BREITE HOEHE")]
    labels = rp.label_candidates(lines_of(spark, {("a", 1): ["Size:"] * 3 + ["Once:"] + ["a b c d e f g:"] * 4}))
    assert [tuple(r) for r in labels.collect()] == [("Size:", 3)]
    terms = rp.profile_terms(lines_of(spark, {("a", 1): ["PREZZO CODICE", "PREZZO NOME", "prezzo codice", "CODICE X"]}), {"fields": {"code": ["codice"]}})
    assert [tuple(r) for r in terms.collect()] == [("price", "prezzo", 2)]
    assert json.loads(rp.suggested_profile(terms).first().profile) == {"version": "1.0", "fields": {"price": ["prezzo"]}}


def test_snippets_fall_through(spark):
    df = lines_of(spark, {("a", 1): ["Art. no 1 costs 2,50"] * 3 + ["price 3,50", "Code", "other"]})
    got = [(r.kind, r.line) for r in rp.snippets(df, each=2).orderBy("n").collect()]
    assert got == [("a", "Art. no 1 costs 2,50")] * 2 + [("p", "Art. no 1 costs 2,50"), ("p", "price 3,50"), ("h", "Code")]


def test_code_quality_and_summary(spark):
    df = spark.createDataFrame([("d", "QX-4471", "Art. no: QX-4471", ""), ("d", "QX-4472", "Art. no: QX-4470", "art_no_corrected"), ("d", "447111", "Art. no: 447111", ""), ("d", "", "none", "")], "source_file string, art_no string, line string, notes string")
    row = rp.code_quality(df).first()
    assert (row.bad_art_no_count, row.corrected_art_no_count, row.suspicious_numeric_art_no_seen) == (2, 1, True)
    results = spark.createDataFrame([("CONVERTED(parser=marker)", 5, 1, False), ("REVIEW_ONLY(parser=marker)", 0, 3, True), ("FAILED", 0, 0, False)], "final_status string, rows_exported int, review_rows int, suspicious_numeric_art_no_seen boolean")
    row = rp.run_summary(results).first()
    assert (row.documents, row.converted, row.review_only, row.failed, row.rows_exported, row.review_rows, row.suspicious) == (3, 1, 1, 1, 5, 4, True)
    assert rp.run_summary(results.limit(0)).first().documents == 0


def test_section_line_goes_once(spark):
    df = spark.createDataFrame([(["a", "S", "b", "S"],), (["x"],)], "l array<string>")
    assert [r[0] for r in df.select(tx.strip_section_line(F.col("l"), F.lit("S"))).collect()] == [["a", "b", "S"], ["x"]]


# Sources and sinks


def test_folders_and_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one\ftwo")
    (tmp_path / "sub" / "b.txt").write_text("three")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    assert files.files(spark, str(tmp_path)).count() == 2
    found = files.files(spark, str(tmp_path), recursive=True)
    pages = files.read_pages(found)
    got = sorted((r.source_file, r.page_number, r.text) for r in pages.filter("error IS NULL").collect())
    assert got == [("a.txt", 1, "one"), ("a.txt", 2, "two"), ("sub/b.txt", 1, "three")]
    errors = files.error_rows(pages).collect()
    assert [(r.source_file, r.decision, r.profile) for r in errors] == [("bad.txt", "NO", "error")] and errors[0].reasons.startswith("triage_error:UnicodeDecodeError")
    assert [r.text for r in files.read_pages(found, pages=[2]).filter("error IS NULL").collect()] == ["two"]
    assert {r.source_file: r.n_pages for r in files.page_counts(pages).collect()} == {"a.txt": 2, "sub/b.txt": 1, "bad.txt": 0}


def test_ocr_where_text_is_missing(spark):
    df = spark.createDataFrame([("a", 1, "x", 2, []), ("a", 2, "x" * 50, 2, []), ("a", 3, "x", 0, []), ("a", 4, "", 1, [])], "source_file string, page_number int, text string, images_count int, words array<string>")
    read = lambda pages: pages.filter("page_number <> 4").withColumn("ocr_text", F.lit("read text"))
    got = {r.page_number: (r.needs_ocr, r.ocr_used, r.text[:9], r.words) for r in files.with_ocr(df, read).collect()}
    assert got == {1: (True, True, "read text", None), 2: (False, False, "x" * 9, []), 3: (False, False, "x", []), 4: (True, False, "", [])}
    assert files.with_ocr(df, None).filter("ocr_used").count() == 0


def test_stored_signals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    key = lambda **s: files.fingerprint(files.files(spark, str(tmp_path / "in")), "v1", **s)
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    first = key(size=1)
    assert first == key(size=1) != key(size=2)
    assert files.cached(spark, str(tmp_path / "out"), first, make).count() == files.cached(spark, str(tmp_path / "out"), first, make).count() == 3 and len(made) == 1
    (tmp_path / "in" / "a.txt").write_text("other")
    assert key(size=1) != first
    files.cached(spark, str(tmp_path / "out"), key(size=1), make)
    assert files.purge(spark, str(tmp_path / "out"), key(size=1)) == 1 and len(made) == 2


def test_sheets(spark, tmp_path):
    rows = [("d", 2, 0, "B-1", True, False, False), ("d", 1, 1, "A-2", True, True, False), ("d", 1, 0, "A-9", False, True, False), ("d", 1, 2, "A-0", True, True, True)]
    df = spark.createDataFrame(rows, "source_file string, page_number int, line_no int, art_no string, exported boolean, needs_review boolean, noise boolean")
    assert writers.write_sheets(df, str(tmp_path / "out"))
    codes = lambda name: [r.art_no for r in spark.read.parquet(str(tmp_path / "out" / name)).collect()]
    assert codes("products") == ["A-2", "B-1"] and codes("review") == ["A-2", "A-9"]
    assert not writers.write_sheets(df.filter("NOT exported"), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    assert writers.write_sheets(df.filter("NOT exported"), str(tmp_path / "some"), allow_empty=True, format="csv")


def test_workbooks(spark, tmp_path):
    path = tmp_path / "x" / "book.xlsx"
    df = spark.createDataFrame([(1, "a<b", True, [1, 2], None), (2, "é\x01", False, list(range(300)), 2.5)], "n int, t string, b boolean, l array<int>, d double")
    writers.write_workbook({"ONE": df, "TWO": df.limit(0)}, str(path))
    with zipfile.ZipFile(io.BytesIO(path.read_bytes())) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert "a&lt;b" in sheet and ",..." in sheet and '<c r="C2" t="b"><v>1</v></c>' in sheet and "\x01" not in sheet and 'name="TWO"' in z.read("xl/workbook.xml").decode()
    assert not path.with_name("book.xlsx.tmp").exists()
    with pytest.raises(ValueError):
        writers.write_workbook({"ONE": df}, str(path), most=1)


def test_reports_as_files(spark, tmp_path):
    results = spark.createDataFrame([("a", [1, 2], {"EUR": 3})], "source_file string, pages array<int>, counts map<string,int>")
    writers.write_triage_report(results, spark.createDataFrame([("a", "marker")], "source_file string, parser string"), str(tmp_path / "t"))
    row = spark.read.option("header", "true").csv(str(tmp_path / "t" / "triage")).first()
    assert (row.pages, row.counts) == ("1,2", '{"EUR":3}')
    writers.write_json(results, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().pages == [1, 2]
    runs = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "source_file string, seq int, v string")
    assert {r.path: json.loads(r.payload)["v"] for r in writers.debug_payloads(runs).collect()} == {"a": "new", "b": "x"}
    assert [(r.key, r.value) for r in writers.summary(results.select("source_file", "pages")).orderBy("n").collect()] == [("source_file", "a"), ("pages", "[1,2]")]
    row = writers.manifest(spark, spark.createDataFrame([("p", "0a", 3)], "path string, sha1_8 string, length long"), {"x": 1}, "run").first()
    assert row.n_inputs == 1 and json.loads(row.config) == {"x": 1} and json.loads(row.inputs)[0]["path"] == "p"


def test_corpus_report(spark):
    df = spark.createDataFrame([("a", 4, [1, 3], 2, 1, 0, 0, {"EUR": 2, "DKK": 1}, 0.1, 7, 3, 0.5, 5.5, "marker", "low_text")], "source_file string, page_count int, pages_sampled array<int>, art_no_count int, code_count int, rrp_count int, size_count int, currency_counts map<string,int>, numeric_density double, price_count int, table_columns int, numeric_line_ratio double, table_score double, recommended_parser string, risk_flags string")
    row = rp.corpus_report(df).first()
    assert (row.pages_sampled, row.marker_hits, row.currency_tokens, row.table_likelihood) == ("1,3", "art_no=2;code=1;rrp=0;size=0", "DKK=1;EUR=2", "columns=3;numeric_ratio=0.500;score=5.50")


def test_stitched_pages(spark):
    df = spark.createDataFrame([(0, 3, 3, 6.0), (1, 3, 3, 6.0), (0, 2, 3, 6.0), (0, 3, 3, 5.9)], "cooccurrence_count int, mixed_code_count int, price_like_count int, table_likelihood double")
    assert tb.stitched_pages(df).count() == 1


def test_page_signals_of_an_empty_table(spark):
    assert pg.page_signals(ln.line_info(lines_of(spark, {("d", 1): ["x"]}).limit(0))).count() == 0


def test_target_currency_and_corrections(spark):
    prices = [(1.0, None, None, 2.0), (1.0, None, None, None), (None, None, None, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(prices)], "i int, price_dkk double, price_sek double, price_nok double, price_eur double")
    assert [r.i for r in rw.keep_target(df, "EUR").collect()] == [0] and rw.keep_target(df, "EUR").first().price_dkk is None
    assert [r.i for r in rw.keep_target(df, "DKK", signal=F.lit(True)).orderBy("i").collect()] == [0, 1, 2]
    assert [r.i for r in rw.keep_target(df, "xyz", mode="strict", signal=F.lit(True)).collect()] == [0]
    df = spark.createDataFrame([("447100", "Art. no: QX-4471", "x"), ("447100", "Art. no: 447100", ""), ("QX-1", "Art. no: QX-2", "")], "art_no string, line string, notes string")
    assert [(r.art_no, r.notes) for r in rw.corrected_codes(df).collect()] == [("QX-4471", "x; art_no_corrected"), ("447100", ""), ("QX-1", "")]


def test_page_gates_on_rows(spark):
    rows = spark.createDataFrame([("d", 1, "a"), ("d", 2, ""), ("d", 3, "")], "source_file string, page_number int, notes string")
    gates = spark.createDataFrame([("d", 1, False, True), ("d", 2, True, False), ("d", 3, False, False)], "source_file string, page_number int, text_like boolean, review_only boolean")
    assert [(r.page_number, r.notes) for r in rw.apply_page_gates(rows, gates).orderBy("page_number").collect()] == [(1, "a; page_review_only"), (3, "")]


def test_diagnosis_and_parsers(spark, tmp_path):
    from pricelore.plans import runs

    results = spark.createDataFrame([("a", 3), ("b", 4)], "source_file string, rows_exported int")
    top = spark.createDataFrame([("a", 7, 2), ("a", 3, 1), ("b", 1, 1)], "source_file string, page_number int, page_rank int")
    attempts = spark.createDataFrame([("a", 0, "(marker:ok)")], "source_file string, way_rank int, attempt string")
    sheets = runs.diagnostics(results, top, attempts, "a")
    assert [tuple(r) for r in sheets["SUMMARY"].collect()] == [("source_file", "a"), ("rows_exported", "3")]
    assert [r.page_number for r in sheets["TOP_K"].collect()] == [3, 7] and sheets["ATTEMPTS"].count() == 1
    writers.write_workbook(sheets, str(tmp_path / "d.xlsx"))
    assert runs.segmenter() is runs.PARSERS["marker"] and runs.segmenter("code_price_based")(lines_of(spark, {("d", 1): ["QX4471 Garden bench EUR 310", "words"]})).count() == 1
    with pytest.raises(ValueError):
        runs.segmenter("none")
    pages = spark.createDataFrame([("d", 1, 2.5, True)], "source_file string, page_number int, signal_score double, toc_like boolean")
    assert json.loads(rp.page_metrics(pages).first().metrics) == {"signal_score": 2.5, "toc_like": True}
