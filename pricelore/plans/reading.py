"""Queries over the steps of reading documents: blocks, parsers, tables, samples, the choice of a way, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelore.config import CONFIG
from pricelore.functions import labels as lb
from pricelore.functions import markers as mk
from pricelore.functions import patterns as rx
from pricelore.functions import text as tx
from pricelore.operators import blocks as bl
from pricelore.operators import choice as ch
from pricelore.operators import pages as pg
from pricelore.operators import reports as rp
from pricelore.operators import rows as rw
from pricelore.operators import sampling as sm
from pricelore.operators import tables as tb
from pricelore.plans import oracle as o
from pricelore.sources.catalog import catalog_lines

KEY = ("source_file", "page_number", "line_no")
PAGE = ("source_file", "page_number")
#: Lines of the view with wide gaps between code, name and price, as a table has them: what is replaced, and by what.
GAPS = ((r"^([A-Z]{2}[0-9]{5}) (.*) EUR (.*)$", r"$1  $2  EUR $3"), (r"^Code Description Price$", "Code  Description  Price"))
STOPWORDS = ("the", "and", "with", "for", "from")


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    for pattern, by in GAPS:
        line = F.regexp_replace(line, pattern, by)
    return catalog_lines(spark, sf_dir).withColumn("line", line)


def scored_pages(signals: DataFrame) -> DataFrame:
    """Pages with what the sampler asks for beside their signals."""
    return signals.withColumns({"cooccurrence_near_count": F.col("row_candidate_count"), "text_len": F.col("chars") + F.col("n_lines") - 1})


def marker_parsed(blocks: DataFrame) -> DataFrame:
    """Rows of the marker format, exported if they have a valid code and a price."""
    rows = bl.marker_rows(blocks)
    priced = F.coalesce(*[F.col(f"price_{c.lower()}") for c in rx.ROW_CURRENCIES]).isNotNull()
    return rows.withColumn("exported", (F.col("art_no") != "") & priced).withColumn("needs_review", ~F.col("exported"))


def attempts(products: DataFrame, blocks: DataFrame, table: DataFrame) -> DataFrame:
    """What each way of reading yields, judged."""
    own = ("source_file", "parser", "art_no", "name", "price", "exported", "needs_review")
    lines = products.withColumn("parser", F.lit("code_price_based")).select(*own)
    marked = marker_parsed(blocks).withColumns({"parser": F.lit("marker"), "price": F.col("price_eur")}).select(*own)
    tabled = table.withColumns({"parser": F.lit("table_based"), "exported": (F.col("art_no") != "") & F.col("price").isNotNull()}).withColumn("needs_review", ~F.col("exported")).select(*own)
    return ch.judged(ch.metrics(lines.unionByName(marked).unionByName(tabled)).withColumn("eval_pages", F.lit(0)))


def queries(info, parsed, judged, exported, signals, words):
    """The queries, of the catalogue's steps as functions of (spark, sf_dir)."""
    lines = catalog_lines
    pages = lambda a, d: scored_pages(signals(a, d)).withColumn("n_sample", F.count("*").over(Window.partitionBy("source_file")))
    blocks = lambda a, d: bl.marker_blocks(lines(a, d))
    attached = lambda a, d: bl.attach_continuations(blocks(a, d))
    deduped = lambda a, d: rw.apply_duplicates(exported(a, d))
    n_pages = lambda a, d: lines(a, d).groupBy("source_file").agg(F.max("page_number").alias("n_pages"))
    tried = lambda a, d: ch.tried(attempts(exported(a, d), blocks(a, d), tb.table_rows(gapped(a, d))), ways(a, d))
    triage = lambda a, d: pg.triage(lines(a, d))
    ways = lambda a, d: triage(a, d).select("source_file", ch.order_of_ways(F.col("profile"), F.col("art_no_count"), F.col("rrp_count")).alias("ways"))
    metrics = ("source_file", "parser", "eval_rows", "rows_exported", "unique_code_ratio", "key_fields_rate", "review_rate", "duplicate_conflicts_count", "reason", "ok", "score")

    def documents(a, d):
        tables = pg.table_metrics(words(a, d)).groupBy("source_file").agg(F.max("n_columns").alias("table_columns"))
        own = pages(a, d).groupBy("source_file").agg(F.count("*").alias("n_pages_read"), F.sum("text_len").alias("text_len"), F.lit(False).alias("needs_ocr"), F.max("has_stopword").alias("has_stopword"), (F.sum("digits") / F.sum("text_len")).alias("numeric_density"))
        money = lines(a, d).select("source_file", F.explode(F.regexp_extract_all("line", F.lit(r"€|\b(?:" + "|".join(rx.CURRENCIES) + r")\b"), F.lit(0))).alias("c")).groupBy("source_file").agg(F.countDistinct("c").alias("currencies"))
        return own.join(tables, "source_file").join(money, "source_file", "left").join(triage(a, d), "source_file").withColumn("currencies", F.coalesce("currencies", F.lit(0))).withColumnRenamed("profile", "parser")

    def label_hits(a, d):
        known = lb.patterns(lb.DEFAULT)
        return lines(a, d).groupBy("source_file").agg(*[F.sum(lb.hits(F.col("line"), f, known)).alias(f) for f in sorted(known)])

    def corpus(a, d):
        own = documents(a, d).withColumn("numeric_density", F.round("numeric_density", 4))
        counts = pg.currency_counts(lines(a, d)).groupBy("source_file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("currency", "n")))).alias("currency_counts"))
        looked = lines(a, d).groupBy("source_file").agg(F.max("page_number").alias("page_count"), F.array_sort(F.collect_set("page_number")).alias("pages_sampled"), F.sum(F.regexp_count("line", F.lit(r"(?i)\bsize\b"))).alias("size_count"))
        own = own.join(looked, "source_file").join(counts, "source_file", "left").withColumns({"recommended_parser": F.col("parser"), "numeric_line_ratio": F.lit(0.0), "table_score": F.col("table_columns").cast("double")})
        return rp.corpus_report(rp.risk_flags(own))

    def sheet(a, d):
        visible = deduped(a, d).filter("NOT noise")
        return visible.select(*KEY, "art_no", "name", "price", "exported", "needs_review", "notes", F.row_number().over(rw.sheet_order()).alias("sheet_row"))

    return {
        "marker_blocks": lambda a, d: blocks(a, d),
        "titled_blocks": lambda a, d: bl.titled_blocks(lines(a, d).withColumn("line", F.regexp_replace("line", r"(?i)\*\*\s*RRP", "RRP"))),
        "continuation": attached,
        "split_merged": lambda a, d: bl.split_merged(attached(a, d)).select(*KEY, "part", "sub_part", "note", "block"),
        "code_price_blocks": lambda a, d: bl.code_price_blocks(info(a, d)),
        "marker_rows": lambda a, d: marker_parsed(blocks(a, d)).drop("block"),
        "degraded_codes": lambda a, d: blocks(a, d).select(*KEY, "part", mk.is_degraded(F.col("block"), F.regexp_replace(mk.code_field_raw(F.col("block")), "[^0-9]", "")).alias("degraded")),
        "table_columns": lambda a, d: tb.estimate_columns(gapped(a, d)),
        "table_rows": lambda a, d: tb.table_rows(gapped(a, d)),
        "table_precheck": lambda a, d: tb.precheck(gapped(a, d), tb.estimate_columns(gapped(a, d))),
        "stitch_rows": lambda a, d: tb.stitch_rows(words(a, d)),
        "sample_pages": lambda a, d: sm.sample_pages(pg.sample_counts(n_pages(a, d))),
        "sweep_pages": lambda a, d: sm.sweep_pages(n_pages(a, d)),
        "early_stop": lambda a, d: sm.early_stop(pages(a, d)).select(*PAGE, "scan_rank", "strong_hits", "stopped"),
        "sweep_hits": lambda a, d: sm.sweep_hits(pages(a, d), sm.sweep_pages(n_pages(a, d))),
        "adjusted_scores": lambda a, d: sm.adjusted_scores(pages(a, d), pg.table_metrics(words(a, d))).select(*PAGE, "signal_score", "table_likelihood"),
        "top_pages": lambda a, d: sm.best_pages(pages(a, d), sm.top_count(F.col("n_sample")), exclude_toc=True).select(*PAGE, "why", "page_rank"),
        "eval_order": lambda a, d: sm.eval_order(pages(a, d)).select(*PAGE, "eval_rank"),
        "readable_pages": lambda a, d: sm.readable_pages(pages(a, d)).select(*PAGE, "page_rank", "fallback"),
        "parser_attempts": lambda a, d: attempts(exported(a, d), blocks(a, d), tb.table_rows(gapped(a, d))).select(*metrics),
        "parser_choice": lambda a, d: ch.best_runs(tried(a, d), triage(a, d)).select("source_file", "parser", "way_rank", "score", "final_status"),
        "attempt_lines": lambda a, d: tried(a, d).select("source_file", "parser", "way_rank", ch.attempt_text().alias("attempt")),
        "early_discards": lambda a, d: ch.early_discards(exported(a, d).withColumn("parser", F.lit("code_price_based")).join(sm.eval_order(pages(a, d)).select(*PAGE, "eval_rank"), list(PAGE))),
        "retry_plan": lambda a, d: ch.retry_plan(tried(a, d), pages(a, d).groupBy("source_file").agg(F.count_if(F.col("row_candidate_count") > 0).alias("cooccurrence_pages"), F.lit(CONFIG.cooccurrence_pages_min).alias("cooccurrence_required"))),
        "gated_rows": lambda a, d: rw.apply_page_gates(exported(a, d), pg.page_gates(signals(a, d))).select(*KEY, "art_no", "exported", "notes"),
        "page_metrics": lambda a, d: rp.page_metrics(pages(a, d)),
        "dedup_rows": lambda a, d: deduped(a, d).select(*KEY, "art_no", "dup_verdict", "noise", "exported", "needs_review", "notes"),
        "duplicates_summary": lambda a, d: rw.duplicates_summary(deduped(a, d)),
        "products_sheet": lambda a, d: sheet(a, d),
        "run_report": lambda a, d: rp.run_report(judged(a, d), deduped(a, d)),
        "code_quality": lambda a, d: rp.code_quality(parsed(a, d).withColumn("notes", F.lit(""))),
        "discard_samples": lambda a, d: rp.discard_samples(judged(a, d)),
        "risk_flags": lambda a, d: rp.risk_flags(documents(a, d)).select("source_file", "n_pages_read", "text_len", "risk_flags"),
        "document_groups": lambda a, d: rp.document_groups(documents(a, d)).select("group_id", "size", "avg_table_columns", "avg_marker_score", "avg_price_count", "examples"),
        "currency_counts": lambda a, d: pg.currency_counts(lines(a, d)),
        "corpus_report": corpus,
        "run_summary": lambda a, d: rp.run_summary(ch.best_runs(tried(a, d), triage(a, d)).select("final_status", "rows_exported", F.lit(0).alias("review_rows"), F.lit(False).alias("suspicious_numeric_art_no_seen"))),
        "label_hits": label_hits,
        "label_candidates": lambda a, d: rp.label_candidates(lines(a, d).withColumn("line", F.upper("line"))),
        "header_candidates": lambda a, d: rp.header_candidates(gapped(a, d)),
        "unknown_words": lambda a, d: rp.unknown_words(gapped(a, d), a.createDataFrame([(t,) for t in lb.terms(lb.DEFAULT)], "word string"), STOPWORDS),
        "column_stats": lambda a, d: rp.column_stats(words(a, d)),
        "profile_terms": lambda a, d: rp.profile_terms(gapped(a, d).withColumn("line", F.upper("line")), {"fields": {}}),
        "suggested_profile": lambda a, d: rp.suggested_profile(rp.profile_terms(gapped(a, d).withColumn("line", F.upper("line")), {"fields": {}})),
        "snippets": lambda a, d: rp.snippets(lines(a, d)),
        "raw_block_ids": lambda a, d: blocks(a, d).select(*KEY, "part", tx.raw_block_id(F.col("page_number"), F.col("block")).alias("raw_block_id")),
        "section_lines": lambda a, d: lines(a, d).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l")).select(*PAGE, tx.strip_section_line(F.transform("l", lambda x: x["line"]), F.lit("Lounge Collection")).alias("l")).select(*PAGE, F.posexplode("l").alias("line_no", "line")),
    }


def has(x: str, p: str) -> str:
    return f"regexp_matches({x}, {o.q(p)})"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


P = "source_file, page_number"
K = "source_file, page_number, line_no"
TITLE = f"({has('line', r'[^\s]')} AND NOT {has('line', rx.MARKER_LINE)} AND NOT {has('line', rx.MARKER_PRICE)})"


def titled(lines: str) -> str:
    """Blocks by titles, of a relation of lines."""
    return f"""tt0 AS (SELECT *, bool_or(contains(line, 'Colli')) OVER (PARTITION BY {P} ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS near, {has('line', rx.ART_NO_MARK)} AS art FROM {lines}),
tt1 AS (SELECT *, near AND {TITLE} AS may, coalesce(sum(CAST(art AS INT)) OVER (PARTITION BY {P} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS codes FROM tt0),
tt2 AS (SELECT *, may AND codes > coalesce(last_value(CASE WHEN may THEN codes END IGNORE NULLS) OVER (PARTITION BY {P} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fresh FROM tt1),
tt3 AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY {P} ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS n FROM tt2),
titled AS (SELECT * FROM (SELECT {P}, min(line_no) AS line_no, string_agg(line, chr(10) ORDER BY line_no) AS block FROM tt3 WHERE regexp_matches(line, '[^\\s]') GROUP BY {P}, n) WHERE contains(block, 'RRP') AND ({has('block', rx.ART_NO_MARK)} OR {has('block', rx.MARKER_PRICE)}))"""


ART_GROUP = rx.ART_NO_MARK.replace("(?i)", "((?i:") + "))"
BLOCKS = f"""{o.CATALOG},
mb0 AS (SELECT *, regexp_matches(line, '^.*?[^\\s].*?\\*\\*\\s*(?i:RRP)') AND NOT regexp_matches(line, '^\\s*\\*\\*\\s*(?i:RRP)') AS st FROM cat),
mb1 AS (SELECT *, sum(CAST(st AS INT)) OVER (PARTITION BY {P} ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS n, bool_or(st) OVER (PARTITION BY {P}) AS marked FROM mb0),
mb2 AS (SELECT {P}, min(line_no) AS line_no, string_agg(line, chr(10) ORDER BY line_no) AS block FROM mb1 WHERE marked AND n > 0 GROUP BY {P}, n),
mb3 AS (SELECT *, list_transform(string_split(regexp_replace(block, {o.q(ART_GROUP)}, chr(1) || '\\1', 'g'), chr(1)), lambda x: {trim('x')}) AS parts FROM mb2),
mb4 AS (SELECT {K}, CASE WHEN len(parts) <= 2 THEN [block] ELSE list_concat([CASE WHEN parts[1] = '' THEN parts[2] ELSE parts[1] || chr(10) || parts[2] END], parts[3:]) END AS bs FROM mb3),
mb5 AS (SELECT {K}, CAST(i AS INT) AS part, bs[i + 1] AS block FROM (SELECT *, unnest(range(len(bs))) AS i FROM mb4)),
plain AS (SELECT {K}, line FROM mb1 WHERE NOT marked),
{titled('plain')},
blk AS (SELECT {K}, part, block FROM mb5 WHERE regexp_matches(block, '[^\\s]') UNION ALL SELECT {K}, 0, block FROM titled)"""
CODE_RAW = f"(SELECT CASE WHEN regexp_matches(v, '[0-9]') THEN v ELSE '' END FROM (SELECT coalesce(regexp_extract(list_filter(string_split(block, chr(10)), lambda x: {has('x', rx.ART_NO_MARK)})[1], {o.q(rx.ART_NO_VALUE)}, 1), '') AS v))"
SET = "[" + ", ".join(f"'{w}'" for w in rx.VARIANT_WORDS) + "]"


def variant_like(x: str) -> str:
    c = f"replace(lower({x}), '-', ' ')"
    return f"({x} <> '' AND length({x}) <= 25 AND (list_contains({SET}, {c}) OR len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '' AND NOT list_contains({SET}, w))) = 0 OR regexp_matches({c}, '[0-9]') AND regexp_matches({c}, '\\b(?:cm|mm|l)\\b') OR regexp_matches({c}, '\\b[0-9]+(?:[.,][0-9]+)?\\s*(?:l|cm|mm)\\b') OR regexp_matches({c}, '\\bo\\s*[0-9]+(?:[.,][0-9]+)?\\s*cm\\b')))"


def cm(letter: str) -> str:
    return f"TRY_CAST(replace(regexp_extract(size_raw, '(?i)\\b{letter}\\b\\s*([0-9]+(?:[.,][0-9]+)?)\\s*cm', 1), ',', '.') AS DOUBLE)"


MROWS = f"""{BLOCKS},
mr0 AS (SELECT *, {CODE_RAW} AS art_no_raw, TRY_CAST(regexp_extract(block, '(?i)Colli\\s*:\\s*(\\d+)', 1) AS INT) AS colli, {trim("regexp_extract(block, '(?im)^Size\\s*:\\s*(.*)$', 1)")} AS size_raw, {trim("regexp_extract(block, '(?im)^Designer\\s*:\\s*(.*)$', 1)")} AS designer,
  list_filter(list_transform(string_split(block, chr(10)), lambda x: {trim('x')}), lambda x: x <> '') AS ls FROM blk),
mr1 AS (SELECT *, list_position(list_transform(ls, lambda x: NOT {has('x', rx.RRP_MARK)} AND {has('x', rx.COLLI_MARK)}), true) AS e FROM mr0),
mr2 AS (SELECT *, list_filter(list_transform(list_filter(CASE WHEN coalesce(e, 0) = 0 THEN ls ELSE ls[1:e - 1] END, lambda x: {has('x', rx.RRP_MARK)} OR NOT ({has('x', rx.MARKER_LINE)} OR {has('x', rx.MARKER_PRICE)})),
  lambda x: CASE WHEN {has('x', rx.RRP_MARK)} THEN {trim("regexp_extract(x, '^(.*?)(?i:\\*\\*\\s*RRP)', 1)")} ELSE x END), lambda x: x <> '') AS tl FROM mr1),
mr3 AS (SELECT *, {trim("coalesce(tl[1], '')")} AS t FROM mr2),
mr4 AS (SELECT *, {trim("regexp_extract(t, '^(.*?)(?:\\s*[-,/]\\s*)([^-/,]+)$', 1)")} AS b1, {trim("regexp_extract(t, '^(.*?)(?:\\s*[-,/]\\s*)([^-/,]+)$', 2)")} AS v1, {trim("regexp_extract(t, '^(.*)\\(([^)]+)\\)\\s*$', 1)")} AS b2, {trim("regexp_extract(t, '^(.*)\\(([^)]+)\\)\\s*$', 2)")} AS v2,
  list_filter(string_split_regex(replace(lower(t), '-', ' '), '\\s+'), lambda x: x <> '') AS pw, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') AS ws FROM mr3),
mr5 AS (SELECT *, CASE WHEN {variant_like('v1')} THEN 1 WHEN {variant_like('v2')} THEN 2 WHEN len(pw) >= 2 AND list_contains({SET}, array_to_string(pw[-2:], ' ')) THEN 3 WHEN len(pw) >= 1 AND list_contains({SET}, pw[-1]) THEN 4 ELSE 0 END AS how,
  {cm('W')} AS w1, {cm('H')} AS h1, coalesce({cm('L')}, {cm('D')}) AS l1 FROM mr4),
pr0 AS (SELECT {K}, part, unnest(range(1, len(regexp_extract_all(block, {o.q(rx.MARKER_PRICE)})) + 1)) AS i, regexp_extract_all(block, {o.q(rx.MARKER_PRICE)}, 1) AS cs, regexp_extract_all(block, {o.q(rx.MARKER_PRICE)}, 2) AS vs FROM blk),
pr1 AS (SELECT {K}, part, i, cs[i] AS c, {o.number('vs[i]')} AS v, {o.year('vs[i]', 'vs[i]')} AS y FROM pr0),
pr2 AS (SELECT *, v >= 0.01 AND v < 1000000 AND NOT y AS fine FROM pr1),
pr3 AS (SELECT {K}, part, {', '.join(f"arg_max(v, i) FILTER (c = '{c}' AND fine) AS price_{c.lower()}" for c in rx.ROW_CURRENCIES)}, coalesce(string_agg('invalid_price_' || lower(c), '; ' ORDER BY i) FILTER (NOT coalesce(fine, false)), '') AS parse_notes FROM pr2 GROUP BY ALL),
mrw AS (SELECT {K}, part, art_no_raw, colli, size_raw, designer, CASE WHEN {o.plausible(o.code(trim('art_no_raw')))} AND {has(o.code(trim('art_no_raw')), rx.ART_NO_FORM)} THEN {o.code(trim('art_no_raw'))} ELSE '' END AS art_no, array_to_string(tl, ' | ') AS name_raw,
  CASE how WHEN 1 THEN b1 WHEN 2 THEN b2 WHEN 3 THEN array_to_string(ws[:greatest(len(ws) - 2, 0)], ' ') WHEN 4 THEN array_to_string(ws[:greatest(len(ws) - 1, 0)], ' ') ELSE t END AS name,
  CASE how WHEN 1 THEN v1 WHEN 2 THEN v2 WHEN 3 THEN array_to_string(ws[-2:], ' ') WHEN 4 THEN ws[-1] ELSE '' END AS variant,
  w1 AS width_cm, h1 AS height_cm, l1 AS length_cm, size_raw <> '' AND coalesce(w1, 0) + coalesce(h1, 0) + coalesce(l1, 0) = 0 AS size_unparsed, coalesce(parse_notes, '') AS parse_notes, price_dkk, price_sek, price_nok, price_eur
  FROM mr5 LEFT JOIN pr3 USING ({K}, part)),
mrx AS (SELECT *, art_no <> '' AND coalesce(price_dkk, price_sek, price_nok, price_eur) IS NOT NULL AS exported FROM mrw)"""
LABELS = lb.patterns(lb.DEFAULT)


def hits(x: str, *fields: str) -> str:
    return "(" + " + ".join(o.count(x, LABELS[f]) for f in fields) + ")"


GAPPED = f"""gp AS (SELECT {K}, regexp_replace(regexp_replace(line, '{GAPS[0][0]}', '\\1  \\2  EUR \\3'), '{GAPS[1][0]}', '{GAPS[1][1]}') AS line FROM cat)"""
LAST_NUMBER = lambda x: f"regexp_extract_all({x}, {o.q(rx.COLUMN_PRICE)}, 1)[-1]"
PRICE_IN = lambda x: f"CASE WHEN {o.number(x)} >= 0.01 AND {o.number(x)} < 1000000 AND NOT {o.year(x, x)} THEN {o.number(x)} END"
TABLE = f"""{o.CATALOG}, {GAPPED},
tb0 AS (SELECT *, list_filter(list_transform(string_split_regex(line, '\\s{{2,}}|\\t'), lambda x: {trim('x')}), lambda x: x <> '') AS cs FROM gp),
tb1 AS (SELECT * FROM tb0 WHERE len(cs) >= 2),
tb2 AS (SELECT *, list_filter(range(len(cs)), lambda i: {hits('cs[i + 1]', 'code')} > 0)[-1] AS hc, list_filter(range(len(cs)), lambda i: {hits('cs[i + 1]', 'description')} > 0)[-1] AS hd, list_filter(range(len(cs)), lambda i: {hits('cs[i + 1]', 'price', 'currency')} > 0)[1] AS hp FROM tb1),
tb3 AS (SELECT *, CAST(hc IS NOT NULL AS INT) + CAST(hd IS NOT NULL AS INT) + CAST(hp IS NOT NULL AS INT) >= 2 AS head FROM tb2),
tb4 AS (SELECT *, last_value(CASE WHEN head THEN {{'c': hc, 'd': hd, 'p': hp}} END IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY page_number, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS m FROM tb3 WHERE head OR regexp_matches(line, {o.q(rx.COLUMN_PRICE)}) OR {hits('line', 'code', 'description', 'price', 'currency')} < 2),
tb5 AS (SELECT *, coalesce(cs[m.c + 1], '') AS mc, coalesce(cs[m.d + 1], '') AS md, coalesce(cs[m.p + 1], '') AS mp FROM tb4 WHERE NOT head),
tb6 AS (SELECT *, CASE WHEN mc <> '' THEN mc ELSE cs[1] END AS art_no_raw, CASE WHEN md <> '' THEN md WHEN len(cs) > 2 THEN array_to_string(cs[2:len(cs) - 1], ' ') ELSE '' END AS name, {LAST_NUMBER('mp')} AS n1, {LAST_NUMBER('cs[-1]')} AS n2 FROM tb5),
tbr AS (SELECT {K}, CASE WHEN {o.plausible(o.code(trim('art_no_raw')))} AND {has(o.code(trim('art_no_raw')), rx.ART_NO_FORM)} THEN {o.code(trim('art_no_raw'))} ELSE '' END AS art_no, art_no_raw, name, array_to_string(cs, ' ') AS name_raw, coalesce({PRICE_IN('n1')}, {PRICE_IN('n2')}) AS price FROM tb6)"""
SPAGES = f"""{o.PAGES},
sp AS (SELECT *, row_candidate_count AS near_count, chars + n_lines - 1 AS text_len FROM pg)"""
BEST_KEY = "row_candidate_count DESC, near_count DESC, mixed_code_count DESC, cooccurrence_count DESC, signal_score DESC, page_number"
DEDUP = f"""{o.JUDGED},
dr0 AS (SELECT *, CASE WHEN ok THEN CASE WHEN name <> '' THEN 3 ELSE 0 END + CASE WHEN price IS NOT NULL OR price_like THEN 4 ELSE 0 END + CASE WHEN has_currency THEN 2 ELSE 0 END - CASE WHEN dimension_line THEN 3 ELSE 0 END
  - CASE WHEN len(string_split_regex(line, '\\s+')) > 10 AND NOT price_like THEN 2 ELSE 0 END - CAST(needs_review AS INT) - CAST(NOT exported AS INT) END AS row_score FROM ex),
dr1 AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY source_file, art_no ORDER BY row_score DESC, page_number, line_no) END AS dup_rank FROM dr0),
dr2 AS (SELECT *, CASE WHEN coalesce(dup_rank, 1) = 1 THEN '' WHEN NOT (price_like OR price IS NOT NULL) THEN 'technical_sheet_line' WHEN is_header THEN 'header_noise_conflict' ELSE 'real_price_conflict' END AS dup_verdict FROM dr1),
dr AS (SELECT * REPLACE (CASE WHEN dup_verdict <> '' THEN dup_verdict = 'real_price_conflict' ELSE exported END AS exported, CASE WHEN dup_verdict <> '' THEN false ELSE needs_review END AS needs_review,
  concat_ws('; ', CASE WHEN notes <> '' THEN notes END, CASE WHEN dup_verdict = 'real_price_conflict' THEN 'SOFT_REVIEW:duplicate_variant' END, CASE WHEN dup_verdict <> '' THEN dup_verdict END) AS notes), dup_verdict NOT IN ('', 'real_price_conflict') AS noise FROM dr2)"""
ATTEMPTS = f"""at0 AS (SELECT source_file, 'code_price_based' AS parser, art_no, name, price, exported, needs_review FROM ex UNION ALL SELECT source_file, 'marker', art_no, name, price_eur, exported, NOT exported FROM mrx UNION ALL SELECT source_file, 'table_based', art_no, name, price, art_no <> '' AND price IS NOT NULL, NOT (art_no <> '' AND price IS NOT NULL) FROM tbr),
at1 AS (SELECT source_file, parser, count(*) AS eval_rows, count(*) FILTER (exported) AS rows_exported, count(DISTINCT art_no) FILTER (exported AND art_no <> '') AS codes, count(*) FILTER (exported AND art_no <> '' AND price IS NOT NULL) AS keys, count(*) FILTER (needs_review) AS reviews FROM at0 GROUP BY ALL),
at2 AS (SELECT source_file, parser, count(*) FILTER (v > 1) AS duplicate_conflicts_count FROM (SELECT source_file, parser, art_no, count(DISTINCT (lower(trim(name)), coalesce(CAST(price AS VARCHAR), ''))) AS v FROM at0 WHERE art_no <> '' GROUP BY ALL) GROUP BY ALL),
at3 AS (SELECT source_file, parser, eval_rows, rows_exported, CASE WHEN rows_exported > 0 THEN CAST(codes AS DOUBLE) / rows_exported ELSE 0.0::DOUBLE END AS unique_code_ratio, CASE WHEN rows_exported > 0 THEN CAST(keys AS DOUBLE) / rows_exported ELSE 0.0::DOUBLE END AS key_fields_rate, CAST(reviews AS DOUBLE) / eval_rows AS review_rate, coalesce(duplicate_conflicts_count, 0) AS duplicate_conflicts_count,
  CASE WHEN rows_exported > 0 THEN CAST(coalesce(duplicate_conflicts_count, 0) AS DOUBLE) / rows_exported ELSE 0.0::DOUBLE END AS conflicts FROM at1 LEFT JOIN at2 USING (source_file, parser)),
atm AS (SELECT * EXCLUDE (conflicts), CASE WHEN rows_exported = 0 THEN 'no_valid_rows_found' WHEN rows_exported < 5 THEN 'too_few_rows' WHEN unique_code_ratio < 0.15::DOUBLE THEN 'low_unique_code_ratio' WHEN key_fields_rate < 0.5::DOUBLE THEN 'low_key_fields_rate' ELSE 'passed' END AS reason,
  key_fields_rate + 0.6::DOUBLE * unique_code_ratio - 0.5::DOUBLE * CASE WHEN review_rate = 0 THEN 1.0::DOUBLE ELSE review_rate END - 0.8::DOUBLE * conflicts AS score FROM at3)"""
LIST = lambda sql: sql.removeprefix(o.CATALOG).removeprefix(",")
ALL_WAYS = f"{o.JUDGED},{LIST(MROWS)},{LIST(TABLE)}, {ATTEMPTS}, {o.TRIAGE}"
CHOICE = f"""{ALL_WAYS},
wy AS (SELECT source_file, profile, list_distinct_ordered AS ways FROM (SELECT source_file, profile, list_filter(list_concat(CASE WHEN art_no_count >= 20 AND rrp_count >= 20 THEN ['marker'] ELSE [] END, CASE WHEN profile IN ('marker', 'table_based', 'code_price_based') THEN [profile] ELSE [] END, ['marker', 'table_based', 'code_price_based']), lambda x: true) AS list_distinct_ordered FROM tri)),
wr AS (SELECT source_file, profile, ways[i] AS parser, min(i) AS p FROM (SELECT *, unnest(range(1, len(ways) + 1)) AS i FROM wy) GROUP BY ALL),
wn AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_file ORDER BY p) - 1 AS INT) AS way_rank FROM wr),
td0 AS (SELECT atm.*, reason = 'passed' AS ok, way_rank, profile, reason = 'passed' AND key_fields_rate >= 0.8::DOUBLE AND review_rate <= 0.2::DOUBLE AS great FROM atm JOIN wn USING (source_file, parser)),
td AS (SELECT * FROM (SELECT *, coalesce(max(CAST(great AS INT)) OVER (PARTITION BY source_file ORDER BY way_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM td0) WHERE s = 0)"""


def oracle_sql() -> dict[str, str]:
    return more_sql() | {
        "marker_blocks": f"{BLOCKS} SELECT {K}, part, block FROM blk",
        "titled_blocks": f"{o.CATALOG}, rl AS (SELECT {K}, regexp_replace(line, '(?i)\\*\\*\\s*RRP', 'RRP', 'g') AS line FROM cat), {titled('rl')} SELECT {K}, block FROM titled",
        "code_price_blocks": f"{o.INFO} SELECT {K}, 0 AS part, line AS block FROM li WHERE NOT (NOT regexp_matches(line, {o.q(rx.COLUMN_PRICE)}) AND regexp_matches(line, '(?i)\\b(?:code|description|price)\\b')) AND (price_like OR code_hits > 0)",
        "marker_rows": f"{MROWS} SELECT *, NOT exported AS needs_review FROM mrx",
        "table_columns": f"{o.CATALOG}, {GAPPED} SELECT {P}, CAST(max(len(list_filter(string_split_regex(line, '\\s{{2,}}'), lambda x: x <> ''))) AS INT) AS table_columns FROM gp GROUP BY ALL",
        "table_rows": f"{TABLE} SELECT * FROM tbr",
        "sweep_pages": f"{o.CATALOG}, n AS (SELECT source_file, max(page_number) AS n FROM cat GROUP BY 1), s AS (SELECT *, CAST(greatest(10, ceil(n / 40)) AS INT) AS step FROM n) SELECT source_file, step, CAST(unnest(range(1, n + 1, step)) AS INT) AS page_number FROM s",
        "early_stop": f"{SPAGES}, a AS (SELECT *, count(*) OVER w AS scan_rank, CAST(sum(CAST(NOT has_stopword AND signal_score >= 12 AND (cooccurrence_count > 0 OR mixed_code_count > 0) AS INT)) OVER w AS BIGINT) AS strong_hits FROM sp WINDOW w AS (PARTITION BY source_file ORDER BY page_number ROWS UNBOUNDED PRECEDING)), b AS (SELECT *, scan_rank >= 8 AND strong_hits >= 4 AS stopped FROM a) SELECT {P}, scan_rank, strong_hits, stopped FROM (SELECT *, coalesce(max(CAST(stopped AS INT)) OVER (PARTITION BY source_file ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b) WHERE before = 0",
        "top_pages": f"""{SPAGES}, a AS (SELECT *, count(*) OVER (PARTITION BY source_file) AS t FROM sp), b AS (SELECT *, least(t, greatest(8, least(20, t // 2))) AS k FROM a), c AS (SELECT * FROM (SELECT *, count(*) FILTER (NOT toc_hard) OVER (PARTITION BY source_file) AS rest FROM b) WHERE rest < k OR NOT toc_hard),
d AS (SELECT *, CASE WHEN max(cooccurrence_count) OVER (PARTITION BY source_file) > 0 THEN cooccurrence_count > 0 ELSE near_count > 0 END AS beside FROM c), e AS (SELECT *, row_number() OVER (PARTITION BY source_file, beside ORDER BY {BEST_KEY}) AS q, count(*) FILTER (beside) OVER (PARTITION BY source_file) AS nb FROM d),
f AS (SELECT *, beside AND q <= least(3, k, nb) AS r FROM e), g AS (SELECT *, row_number() OVER (PARTITION BY source_file, r ORDER BY {BEST_KEY}) AS fr, count(*) FILTER (r) OVER (PARTITION BY source_file) AS taken FROM f), h AS (SELECT *, CASE WHEN r THEN 'reserved' WHEN fr <= k - taken THEN 'filled' END AS why FROM g)
SELECT {P}, why, CAST(row_number() OVER (PARTITION BY source_file ORDER BY why = 'filled', CASE WHEN r THEN q ELSE fr END) AS INT) AS page_rank FROM h WHERE why IS NOT NULL""",
        "eval_order": f"{SPAGES} SELECT {P}, CAST(row_number() OVER (PARTITION BY source_file ORDER BY row_candidate_count DESC, near_count DESC, cooccurrence_count DESC, mixed_code_count DESC, signal_score DESC, page_number) AS INT) AS eval_rank FROM sp",
        "readable_pages": f"{SPAGES}, a AS (SELECT *, text_len >= 80 AND NOT has_stopword AS good FROM sp), b AS (SELECT *, bool_or(good) OVER (PARTITION BY source_file) AS fit FROM a), c AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_file ORDER BY CASE WHEN NOT fit THEN text_len END DESC, page_number) AS INT) AS page_rank FROM b WHERE good OR NOT fit) SELECT {P}, page_rank, NOT fit AS fallback FROM c WHERE page_rank <= 20",
        "parser_attempts": f"{ALL_WAYS} SELECT *, reason = 'passed' AS ok FROM atm",
        "parser_choice": f"{CHOICE}, z AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY ok DESC, CASE WHEN ok THEN score END DESC, CASE WHEN ok THEN rows_exported END DESC, CASE WHEN ok THEN review_rate END, (parser = profile) DESC, eval_rows DESC, score DESC, way_rank) AS z FROM td WHERE ok OR eval_rows > 0) SELECT source_file, parser, way_rank, score, CASE WHEN ok THEN 'CONVERTED' ELSE 'REVIEW_ONLY' END || '(parser=' || parser || ')' AS final_status FROM z WHERE z = 1",
        "dedup_rows": f"{DEDUP} SELECT {K}, art_no, dup_verdict, noise, exported, needs_review, notes FROM dr",
        "duplicates_summary": f"{DEDUP}, s AS (SELECT source_file, art_no, count(*) AS n_rows, CAST(max(row_score) AS INT) AS best_score, arg_min(substr(line, 1, 160), dup_rank) AS best_line, {', '.join(f"count(*) FILTER (dup_verdict = '{v}') AS {v}" for v in ('technical_sheet_line', 'header_noise_conflict', 'real_price_conflict'))} FROM dr WHERE ok GROUP BY ALL HAVING count(*) > 1), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_file ORDER BY n_rows DESC, art_no) AS INT) AS dup_order FROM s) SELECT * FROM r WHERE dup_order <= 20",
        "products_sheet": f"{DEDUP} SELECT {K}, art_no, name, price, exported, needs_review, notes, CAST(row_number() OVER (PARTITION BY source_file ORDER BY page_number, art_no, line_no) AS INT) AS sheet_row FROM dr WHERE NOT noise",
        "run_report": f"""{DEDUP}, l AS (SELECT source_file, count(DISTINCT page_number) AS pages_processed, count(*) AS rows_candidate, count(*) FILTER (discard_reason = '') AS rows_after_parsing, count(*) FILTER (discard_reason = '' AND noise_class = '') AS rows_after_filters,
{', '.join(f"count(*) FILTER (discard_reason = '{r}') AS discard_{r}" for r in ('header_like', 'toc_year_price', 'bad_id', 'dimension_line', 'no_price'))}, count(*) FILTER (discard_reason = '' AND noise_class <> '') AS noise_total, count(*) FILTER (discard_reason = '' AND noise_class = 'noise_header_eur1') AS eur_1_kills,
count(*) FILTER (discard_reason = '' AND noise_class = '' AND hard_reason = 'numeric_dimension_artno') AS numeric_dimension_artno, count(*) FILTER (discard_reason = '' AND noise_class = '' AND hard_reason = 'hard_legal') AS hard_legal FROM jd GROUP BY 1),
y AS (SELECT source_file, count(*) FILTER (price AND year) AS year_price_blocked FROM t3 GROUP BY 1),
w AS (SELECT source_file, count(*) FILTER (exported) AS rows_exported, count(*) FILTER (needs_review) AS rows_needs_review, count(*) FILTER (noise) AS rows_noise, count(*) FILTER (art_no = '') AS missing_art_no, count(*) FILTER (exported AND price IS NULL) AS missing_price, count(*) FILTER (exported AND (name = '' OR price IS NULL)) AS partial_export, count(DISTINCT art_no) FILTER (art_no <> '') AS codes, avg(confidence) AS mean_confidence FROM dr GROUP BY 1),
c AS (SELECT source_file, count(*) FILTER (n > 1) AS duplicate_art_no_count, count(*) FILTER (v > 1) AS duplicate_conflicts_count FROM (SELECT source_file, art_no, count(*) AS n, count(DISTINCT (lower(trim(name)), coalesce(CAST(price AS VARCHAR), ''))) AS v FROM dr WHERE ok GROUP BY ALL) GROUP BY 1),
f AS (SELECT source_file, {o.code('art_no')} AS code, {o.code("regexp_extract(line, '(?i)Art\\.?\\s*no\\.?\\s*:\\s*([A-Z0-9]+(?:-[A-Z0-9]+)*)', 1)")} AS field, notes FROM dr),
u AS (SELECT source_file, count(*) FILTER (regexp_matches(code, '^[0-9]{{6,}}$') AND field <> '' OR code <> '' AND field <> '' AND code <> field) AS bad_art_no_count, count(*) FILTER (contains(notes, 'art_no_corrected')) AS corrected_art_no_count, bool_or(regexp_matches(code, '^[0-9]{{6,}}$') AND field <> '') AS suspicious_numeric_art_no_seen FROM f GROUP BY 1)
SELECT l.*, {', '.join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ('year_price_blocked', 'rows_exported', 'rows_needs_review', 'rows_noise', 'missing_art_no', 'missing_price', 'partial_export', 'codes', 'duplicate_art_no_count', 'duplicate_conflicts_count', 'bad_art_no_count', 'corrected_art_no_count'))}, mean_confidence, coalesce(suspicious_numeric_art_no_seen, false) AS suspicious_numeric_art_no_seen
FROM l LEFT JOIN y USING (source_file) LEFT JOIN w USING (source_file) LEFT JOIN c USING (source_file) LEFT JOIN u USING (source_file)""",
        "discard_samples": f"{o.JUDGED}, r AS (SELECT *, CASE WHEN discard_reason <> '' THEN discard_reason ELSE noise_class END AS reason FROM jd), s AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_file, reason ORDER BY page_number, line_no) AS INT) AS n FROM r WHERE reason <> '') SELECT source_file, reason, n, substr(line, 1, 200) AS sample FROM s WHERE n <= 5",
        "risk_flags": f"{SPAGES}, d AS (SELECT source_file, count(*) AS n_pages_read, CAST(sum(text_len) AS BIGINT) AS text_len, bool_or(has_stopword) AS stop FROM sp GROUP BY 1) SELECT source_file, n_pages_read, text_len, concat_ws(';', CASE WHEN text_len < 80 THEN 'low_text' END, CASE WHEN text_len < 80 AND stop THEN 'intro_only' END) AS risk_flags FROM d",
        "label_hits": f"{o.CATALOG} SELECT source_file, {', '.join(f'CAST(sum({o.count('line', LABELS[f])}) AS BIGINT) AS {f}' for f in sorted(LABELS))} FROM cat GROUP BY 1",
        "label_candidates": f"{o.CATALOG}, u AS (SELECT trim(upper(line)) AS l FROM cat) SELECT l AS label, count(*) AS n FROM u WHERE length(l) <= 90 AND l <> '' AND (l LIKE '%:' OR contains(l, '  ') OR regexp_matches(l, '[A-Z]') AND len(regexp_extract_all(l, '[A-Za-z]{{3,}}')) BETWEEN 2 AND 4) AND len(string_split_regex(l, '\\s+')) <= 6 GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, label LIMIT 30",
        "header_candidates": f"{o.CATALOG}, {GAPPED}, u AS (SELECT line, trim(line) AS l FROM gp) SELECT l AS header, count(*) AS n FROM u WHERE length(line) <= 120 AND (len(list_filter(string_split_regex(line, '\\s{{2,}}|\\t|\\|'), lambda x: trim(x) <> '')) >= 2 OR l = upper(l) AND regexp_matches(l, '[A-Z]')) AND NOT regexp_matches(line, '[0-9]+[.,][0-9]{{2}}') GROUP BY 1 ORDER BY n DESC, header LIMIT 15",
        "column_stats": f"{o.TOKENS}, {o.WORDS}, b AS (SELECT {P}, floor(x0 / 20) AS xb, count(*) AS n FROM wd GROUP BY ALL), p AS (SELECT {P}, count(*) FILTER (n >= 8) AS n_columns FROM b GROUP BY ALL) SELECT source_file, n_columns, count(*) AS n_pages FROM p GROUP BY ALL",
        "raw_block_ids": f"{BLOCKS} SELECT {K}, part, sha1(CAST(page_number AS VARCHAR) || ':' || block) AS raw_block_id FROM blk",
        "section_lines": f"{o.CATALOG}, a AS (SELECT *, line = 'Lounge Collection' AND row_number() OVER (PARTITION BY {P}, line ORDER BY line_no) = 1 AS gone FROM cat) SELECT {P}, CAST(row_number() OVER (PARTITION BY {P} ORDER BY line_no) - 1 AS INT) AS line_no, line FROM a WHERE NOT gone",
    }

TABLE_METRICS = f"""twb AS (SELECT {P}, floor(x0 / 20) AS xb, floor(top / 5) AS yb, regexp_matches(text, '[0-9]') AS numeric FROM wd), twc AS (SELECT {P}, xb FROM twb GROUP BY ALL HAVING count(*) >= 10),
tws AS (SELECT {P}, yb, count(DISTINCT xb) AS n FROM twb SEMI JOIN twc USING ({P}, xb) WHERE numeric GROUP BY ALL), twr AS (SELECT {P}, sum(CAST(n >= 2 AS INT)) AS t FROM tws GROUP BY ALL), twy AS (SELECT {P}, count(DISTINCT yb) AS n_lines FROM twb GROUP BY ALL), tww AS (SELECT {P}, count(*) AS n_columns FROM twc GROUP BY ALL),
twm AS (SELECT {P}, coalesce(n_columns, 0) AS n_columns, CAST(coalesce(t, 0) AS DOUBLE) / n_lines AS numeric_line_ratio FROM twy LEFT JOIN tww USING ({P}) LEFT JOIN twr USING ({P}))"""
GATES = o.PAGES[len(o.INFO) :].lstrip(", \n") + """,
gt AS (SELECT source_file, page_number, row_candidate_count = 0 AND mixed_code_count = 0 AND (cooccurrence_count = 0 AND price_like_count < 2 AND numeric_density < 0.08::DOUBLE OR legal_hits >= 2 AND cooccurrence_count = 0 AND price_like_count < 3) AS text_like, legal_hits >= 2 AND (cooccurrence_count < 2 OR NOT table_hint) AS review_only FROM pg)"""
MONEY = "€|\\b(?:" + "|".join(rx.CURRENCIES) + ")\\b"
FIELD_OF = """CASE WHEN regexp_matches(term, '^(?:art)') THEN 'art_no' WHEN regexp_matches(term, '^(?:rrp|list)') THEN 'rrp' WHEN regexp_matches(term, '^(?:coll|pack)') THEN 'colli' WHEN regexp_matches(term, '^(?:desig)') THEN 'designer' WHEN regexp_matches(term, '^(?:cod|item)') THEN 'code'
 WHEN regexp_matches(term, '^(?:desc|name|prod)') THEN 'description' WHEN regexp_matches(term, '^(?:price|prezz)') OR term IN ('eur', 'dkk', 'sek', 'nok') THEN 'price' WHEN regexp_matches(term, '^(?:size|dim)') THEN 'size' ELSE '' END"""


def more_sql() -> dict[str, str]:
    """SQL of queries that put several steps together."""
    triage = LIST(o.TRIAGE) if o.TRIAGE.startswith(o.CATALOG) else o.TRIAGE
    return {
        "currency_counts": f"{o.CATALOG}, a AS (SELECT source_file, unnest(regexp_extract_all(line, '{MONEY}')) AS c FROM cat) SELECT source_file, CASE WHEN c = '€' THEN 'EUR_symbol' ELSE c END AS currency, count(*) AS n FROM a GROUP BY ALL",
        "run_summary": f"{CHOICE}, z AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY ok DESC, CASE WHEN ok THEN score END DESC, CASE WHEN ok THEN rows_exported END DESC, CASE WHEN ok THEN review_rate END, (parser = profile) DESC, eval_rows DESC, score DESC, way_rank) AS z FROM td WHERE ok OR eval_rows > 0) SELECT count(*) AS documents, count(*) FILTER (ok) AS converted, count(*) FILTER (NOT ok) AS review_only, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS skipped, CAST(sum(rows_exported) AS BIGINT) AS rows_exported, CAST(0 AS BIGINT) AS review_rows, false AS suspicious FROM z WHERE z = 1",
        "gated_rows": f"{o.JUDGED},{GATES} SELECT {K}, art_no, exported, CASE WHEN review_only THEN concat_ws('; ', CASE WHEN notes <> '' THEN notes END, 'page_review_only') ELSE notes END AS notes FROM ex JOIN gt USING ({P}) WHERE NOT text_like",
        "run_scores": f"""{o.JUDGED}, m AS (SELECT source_file, count(*) AS n_rows, count(DISTINCT CASE WHEN art_no <> '' THEN art_no END) AS n_codes, CAST(sum(CAST(art_no <> '' AND price IS NOT NULL AS INT)) AS BIGINT) AS n_key, CAST(sum(CAST(needs_review AS INT)) AS BIGINT) AS n_review, count(*) FILTER (exported) AS n_out FROM ex GROUP BY 1),
k AS (SELECT *, CAST(n_codes AS DOUBLE) / n_rows AS unique_code_ratio, CAST(n_key AS DOUBLE) / n_rows AS key_fields_rate, CAST(n_review AS DOUBLE) / n_rows AS review_rate FROM m),
c AS (SELECT source_file, count(*) AS n FROM (SELECT source_file, art_no FROM ex WHERE ok GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT (lower(trim(name)), coalesce(CAST(price AS VARCHAR), ''))) > 1) GROUP BY 1),
j AS (SELECT k.*, coalesce(c.n, 0) AS n_conflicts, CASE WHEN n_out > 0 THEN CAST(coalesce(c.n, 0) AS DOUBLE) / n_out ELSE 0.0::DOUBLE END AS duplicate_conflicts_rate FROM k LEFT JOIN c USING (source_file))
SELECT * EXCLUDE (n_out), key_fields_rate + 0.6::DOUBLE * unique_code_ratio - 0.5::DOUBLE * CASE WHEN n_review = 0 THEN 1.0::DOUBLE ELSE review_rate END - 0.8::DOUBLE * duplicate_conflicts_rate AS run_score, n_rows >= 5 AND unique_code_ratio >= 0.15::DOUBLE AND key_fields_rate >= 0.5::DOUBLE AS ok FROM j""",
        "triage_decisions": f"""{o.TOKENS}, {o.WORDS}, {triage}, {TABLE_METRICS},
x AS (SELECT source_file, count(DISTINCT page_number) AS n_pages, CAST(sum(length(line)) + count(*) - count(DISTINCT page_number) AS BIGINT) AS text_len, CAST(sum({o.count('line', '€')}) AS BIGINT) AS euro_count FROM cat GROUP BY 1),
w AS (SELECT source_file, max(n_columns) AS cols, sum(numeric_line_ratio) AS ratios FROM twm GROUP BY 1),
a AS (SELECT tr1.*, text_len, euro_count, coalesce(cols, 0) AS table_columns, coalesce(ratios, 0.0::DOUBLE) / n_pages AS numeric_line_ratio FROM tr1 JOIN x USING (source_file) LEFT JOIN w USING (source_file)),
b AS (SELECT *, CASE WHEN table_columns >= 3 THEN table_columns ELSE 0 END + 5.0::DOUBLE * numeric_line_ratio AS table_score FROM a),
c AS (SELECT *, marker_score >= 6 AND art_no_count >= 2 AND rrp_count >= 2 AS sm, table_columns >= 3 AND table_score >= 6 AS st, code_price_score >= 6 AND price_count >= 3 AS sc FROM b),
d AS (SELECT *, greatest(CASE WHEN sm THEN marker_score ELSE -1 END, CASE WHEN st THEN table_score ELSE -1 END, CASE WHEN sc THEN code_price_score ELSE -1 END) AS top FROM c),
e AS (SELECT * EXCLUDE (sm, st, sc, top), CASE WHEN art_no_count >= 20 AND rrp_count >= 20 THEN 'marker' WHEN sm AND marker_score = top THEN 'marker' WHEN st AND table_score = top THEN 'table_based' WHEN sc AND code_price_score = top THEN 'code_price_based' ELSE 'unknown' END AS profile, CAST(greatest(marker_score, table_score, code_price_score) AS DOUBLE) AS support_score FROM d),
f AS (SELECT *, greatest(art_no_count, rrp_count, price_count, code_count, description_count, support_score) > 0 AS signal FROM e)
SELECT * EXCLUDE (signal), CASE WHEN text_len < 80 AND NOT signal THEN 'NO' WHEN profile = 'table_based' AND price_count < 1 AND euro_count < 1 AND currency_count < 1 AND numeric_line_ratio < 0.2::DOUBLE THEN 'FORSE' WHEN profile <> 'unknown' THEN 'OK' WHEN signal THEN 'FORSE' ELSE 'NO' END AS decision FROM f""",
        "sweep_hits": f"""{SPAGES}, n AS (SELECT source_file, max(page_number) AS n FROM cat GROUP BY 1), s AS (SELECT source_file, CAST(unnest(range(1, n + 1, CAST(greatest(10, ceil(n / 40)) AS INT))) AS INT) AS page_number FROM n),
a AS (SELECT *, min(page_number) FILTER (signal_score >= 10) OVER (PARTITION BY source_file) AS first FROM (SELECT sp.* FROM sp JOIN s USING (source_file, page_number))), b AS (SELECT source_file, page_number, signal_score, coalesce(page_number = first, false) AS hit FROM a WHERE first IS NULL OR page_number <= first),
c AS (SELECT sp.source_file, sp.page_number, sp.signal_score, false AS hit FROM sp JOIN b ON b.hit AND sp.source_file = b.source_file AND abs(sp.page_number - b.page_number) <= 2 AND sp.page_number <> b.page_number)
SELECT {P}, signal_score, bool_or(hit) AS hit FROM (SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY ALL""",
        "adjusted_scores": f"""{SPAGES}, {o.WORDS}, {TABLE_METRICS}, a AS (SELECT *, mixed_code_count = 0 AND cooccurrence_count = 0 AS bare, round(signal_score, 4) AS s0 FROM sp), b AS (SELECT *, CASE WHEN toc_hard AND bare THEN greatest(0.0::DOUBLE, s0 - 6) ELSE s0 END AS s1 FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY s1 DESC, page_number) AS r FROM b), d AS (SELECT c.*, CASE WHEN table_hint AND r <= 16 THEN coalesce(round(twm.n_columns + 5.0::DOUBLE * twm.numeric_line_ratio, 3), 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS table_likelihood FROM c LEFT JOIN twm USING ({P})),
e AS (SELECT *, round(s1 + table_likelihood, 4) AS s2 FROM d), f AS (SELECT *, CASE WHEN table_likelihood >= 6 AND bare THEN round(greatest(0.0::DOUBLE, s2 - 8), 4) ELSE s2 END AS s3 FROM e)
SELECT {P}, CASE WHEN toc_like AND NOT toc_hard THEN round(s3 * 0.85::DOUBLE, 4) ELSE s3 END AS signal_score, table_likelihood FROM f""",
        "retry_plan": f"""{CHOICE}, r AS (SELECT source_file, bool_or(ok) AS ok, max(CAST(eval_rows > 0 AS INT)) AS rowsome, arg_min(reason, way_rank) FILTER (reason IN ('too_few_rows', 'no_valid_rows_found', 'low_unique_code_ratio', 'low_key_fields_rate')) AS why FROM td GROUP BY 1),
g AS (SELECT source_file, page_number, max(price_like) OVER (PARTITION BY source_file, page_number ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AND code_hits > 0 AS near FROM li), h AS (SELECT source_file, count(DISTINCT page_number) FILTER (near) AS pages FROM g GROUP BY 1),
i AS (SELECT r.*, CASE WHEN rowsome = 0 THEN 'retry_no_rows' WHEN coalesce(pages, 0) < 3 THEN 'retry_cooc' WHEN ok THEN '' WHEN why IS NOT NULL THEN 'retry' ELSE '' END AS next_mode FROM r LEFT JOIN h USING (source_file))
SELECT source_file, next_mode, CASE WHEN next_mode <> '' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS multiplier, CASE WHEN next_mode <> '' THEN coalesce(why, '') ELSE '' END AS reason, CASE WHEN next_mode <> '' THEN 'sweep' ELSE '' END AS then_mode FROM i""",
        "code_quality": f"""{o.ROWS}, f AS (SELECT source_file, {o.code('art_no')} AS code, {o.code("regexp_extract(line, '(?i)Art\\.?\\s*no\\.?\\s*:\\s*([A-Z0-9]+(?:-[A-Z0-9]+)*)', 1)")} AS field FROM rw)
SELECT source_file, count(*) FILTER (regexp_matches(code, '^[0-9]{{6,}}$') AND field <> '' OR code <> '' AND field <> '' AND code <> field) AS bad_art_no_count, CAST(0 AS BIGINT) AS corrected_art_no_count, bool_or(regexp_matches(code, '^[0-9]{{6,}}$') AND field <> '') AS suspicious_numeric_art_no_seen FROM f GROUP BY 1""",
        "document_groups": f"""{SPAGES}, {o.WORDS}, {TABLE_METRICS}, {triage}, t AS (SELECT source_file, max(n_columns) AS cols FROM twm GROUP BY 1), m AS (SELECT source_file, count(DISTINCT c) AS cur FROM (SELECT source_file, unnest(regexp_extract_all(line, '{MONEY}')) AS c FROM cat) GROUP BY 1),
d AS (SELECT source_file, sum(digits) / sum(text_len) AS density FROM sp GROUP BY 1), a AS (SELECT tri.*, cols, density, coalesce(cur, 0) AS cur FROM tri JOIN t USING (source_file) JOIN d USING (source_file) LEFT JOIN m USING (source_file)),
g AS (SELECT *, profile || '_' || CASE WHEN cols >= 6 THEN 'c6p' WHEN cols >= 4 THEN 'c4' WHEN cols >= 2 THEN 'c2' WHEN cols = 1 THEN 'c1' ELSE 'c0' END || '_' || CASE WHEN density >= 0.08 THEN 'nhigh' WHEN density >= 0.04 THEN 'nmid' ELSE 'nlow' END || '_' || CASE WHEN cur >= 2 THEN 'cmulti' WHEN cur = 1 THEN 'csingle' ELSE 'cnone' END AS group_id FROM a)
SELECT group_id, count(*) AS size, round(avg(cols), 4) AS avg_table_columns, round(avg(marker_score), 4) AS avg_marker_score, round(avg(price_count), 4) AS avg_price_count, array_to_string((list(source_file ORDER BY source_file))[1:3], ',') AS examples FROM g GROUP BY 1""",
        "profile_terms": f"""{o.CATALOG}, {GAPPED}, u AS (SELECT upper(line) AS line FROM gp), h AS (SELECT unnest(string_split_regex(lower(line), '[^a-z]+')) AS term FROM u WHERE length(line) <= 80 AND NOT regexp_matches(line, '\\b[0-9]{{1,7}}(?:[.,][0-9]{{2}})\\b') AND len(regexp_extract_all(line, '[A-Za-z]{{3,}}')) >= 2 AND (contains(line, '  ') OR line = upper(line) AND regexp_matches(line, '[A-Z]'))),
c AS (SELECT term, count(*) AS n FROM h WHERE length(term) >= 3 GROUP BY 1 HAVING count(*) >= 2) SELECT {FIELD_OF} AS field, term, n FROM c WHERE {FIELD_OF} <> ''""",
        "table_precheck": f"""{TABLE}, a AS (SELECT source_file, bool_or(head) AS h, count(*) FILTER (len(cs) >= 3) AS n FROM tb4 GROUP BY 1), c AS (SELECT source_file, max(len(list_filter(string_split_regex(line, '\\s{{2,}}'), lambda x: x <> ''))) AS c FROM gp GROUP BY 1)
SELECT source_file, coalesce(h, false) OR c >= 3 OR coalesce(n, 0) >= 3 AS ok, CASE WHEN coalesce(h, false) OR c >= 3 OR coalesce(n, 0) >= 3 THEN '' ELSE 'table_precheck_failed' END AS reason FROM c LEFT JOIN a USING (source_file)""",
        "degraded_codes": f"{BLOCKS}, a AS (SELECT *, regexp_replace({CODE_RAW}, '[^0-9]', '', 'g') AS c FROM blk) SELECT {K}, part, regexp_matches(c, '^[0-9]{{4,}}$') AND {has('block', rx.DEGRADED_ART_NO)} AS degraded FROM a",
    }
