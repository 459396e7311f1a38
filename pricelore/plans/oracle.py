"""DuckDB SQL for the registered queries. Tokens are rows here, and lines are put together from them by grouping, while
the engine keeps tokens in arrays: the two share patterns and thresholds alone."""

from __future__ import annotations

from pricelore.config import CONFIG
from pricelore.functions import patterns as rx
from pricelore.sources.catalog import CATALOG_SQL

KEY = "source_file, page_number, line_no"


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def number(x: str) -> str:
    s = f"regexp_replace({x}, '[^0-9,.]', '', 'g')"
    return f"""(SELECT CASE WHEN regexp_matches(t, '^(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN TRY_CAST(t AS DOUBLE) END FROM (SELECT CASE
      WHEN contains(s, ',') AND contains(s, '.') AND instr(reverse(s), ',') < instr(reverse(s), '.') THEN replace(replace(s, '.', ''), ',', '.')
      WHEN contains(s, ',') AND contains(s, '.') THEN replace(s, ',', '')
      WHEN regexp_matches(s, '[,.][0-9][0-9][0-9]$') AND length(s) > 4 THEN regexp_replace(s, '[,.]', '', 'g')
      ELSE replace(s, ',', '.') END AS t FROM (SELECT {s} AS s)))"""


def year(cleaned: str, raw: str) -> str:
    return f"(regexp_matches({cleaned}, '^[0-9]{{4}}$') AND NOT regexp_matches({raw}, '[.,]') AND TRY_CAST({cleaned} AS INT) BETWEEN {rx.YEAR_MIN} AND {rx.YEAR_MAX})"


def code(x: str) -> str:
    return f"regexp_replace(regexp_replace(translate({x}, '­‐‑‒–—−', '-------'), '\\s+', '', 'g'), '-{{2,}}', '-', 'g')"


def valid(c: str) -> str:
    bad = (rx.DIMENSION_TOKEN, rx.DATE_TOKEN, rx.NUMBER_WITH_UNIT, rx.COLOUR_TEMPERATURE, rx.WATT, rx.SOCKET, rx.T_SERIES, rx.SINGLE_LETTER, rx.SHORT_GRADE)
    return f"(length({c}) >= 6 AND regexp_matches({c}, '[A-Za-z]') AND regexp_matches({c}, '[0-9]') AND NOT ({' OR '.join(has(c, p) for p in bad)}))"


def plausible(c: str) -> str:
    own = f"regexp_replace({c}, '[^A-Za-z0-9]', '', 'g')"
    digits = f"length(regexp_replace({c}, '[^0-9]', '', 'g'))"
    return f"({valid(code(c))} AND length({own}) >= 0.6 * length({c}) AND {digits} >= 0.2 * length({own}) AND {digits} <= 0.85 * length({own}) AND NOT (length({own}) BETWEEN 5 AND 8 AND len(regexp_extract_all({own}, '[0-9]+|[A-Za-z]+')) - 1 > 0.7 * (length({own}) - 1)) AND NOT {has(c, rx.triple())})"


def words_in(x: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({x}), {q(w)}) AS INT)" for w in words) + ")"


LEGAL_HITS = "(" + " + ".join(f"CAST({has('line', p)} AS INT)" for p in rx.LEGAL) + ")"
CLEANED = f"trim(regexp_replace(replace(token, '€', ''), {q(rx.CURRENCY_EDGE)}, '', 'g'))"
POINTS = "CASE WHEN thousands THEN 2 ELSE 0 END + CASE WHEN two_decimals THEN 1 ELSE 0 END + CASE WHEN number >= 100 THEN 1 ELSE 0 END"

CATALOG = f"WITH cat AS ({CATALOG_SQL})"
TOKENS = f"""{CATALOG},
lt AS (SELECT *, list_filter(list_transform(string_split_regex(regexp_replace(replace(line, '€', ' € '), '^\\s+|\\s+$', '', 'g'), '\\s+'), lambda x: trim(x, {q(rx.STRIP_CHARS)})), lambda x: x <> '') AS toks FROM cat),
tk AS (SELECT {KEY}, line, i, toks[i + 1] AS token FROM (SELECT *, unnest(range(len(toks))) AS i FROM lt)),
t0 AS (SELECT *, {CLEANED} AS cleaned FROM tk),
t1 AS (SELECT *, {has('cleaned', rx.PRICE_TOKEN)} AS price, {year('cleaned', 'token')} AS year, {number('cleaned')} AS number, {number('token')} IS NOT NULL AS is_number,
  {has('cleaned', rx.THOUSANDS)} AS thousands, {has('cleaned', rx.DECIMAL_2)} AS two_decimals, {has('token', rx.CURRENCY_WORD)} AS currency, {has('token', rx.CURRENCY_INSIDE)} AS inside,
  {has('token', rx.NUMBER_WITH_UNIT)} OR {has('token', rx.UNIT_CONTEXT)} OR contains(token, '"') AS unit0,
  {has("replace(token, '×', 'x')", rx.DIMENSION_X)} OR {has("replace(token, '×', 'x')", rx.DIMENSION_LABELLED)} AS dimension,
  token IN ('x', 'X', '×') AS is_x, {has('token', rx.DIMENSION_LABEL)} AS is_label, {has('token', rx.UNIT_TOKEN)} AS is_unit, {has('token', rx.AXIS_TOKEN)} AS axis,
  {code('token')} AS code, {plausible('token')} AS plausible FROM t0),
t2 AS (SELECT *, unit0 OR coalesce(lag(unit0) OVER w, false) OR coalesce(lag(unit0, 2) OVER w, false) OR coalesce(lead(unit0) OVER w, false) OR coalesce(lead(unit0, 2) OVER w, false) AS unit,
  inside OR coalesce(lag(currency) OVER w, false) OR coalesce(lead(currency) OVER w, false) AS near,
  CASE WHEN is_number AND NOT dimension AND coalesce(lead(is_x) OVER w, false) AND coalesce(lead(is_number, 2) OVER w, false) THEN
    CASE WHEN coalesce(lead(is_x, 3) OVER w, false) AND coalesce(lead(is_number, 4) OVER w, false) THEN 5 + CAST(coalesce(lead(is_unit, 5) OVER w, false) AS INT) ELSE 3 + CAST(coalesce(lead(is_unit, 3) OVER w, false) AS INT) END
   WHEN is_label AND coalesce(lead(is_number) OVER w, false) THEN 2 + CAST(coalesce(lead(is_unit, 2) OVER w, false) AS INT) ELSE 0 END AS span
 FROM t1 WINDOW w AS (PARTITION BY {KEY} ORDER BY i)),
ts0 AS (SELECT {KEY}, list([{{'a': i, 'z': i + span}}] ORDER BY i) AS ss FROM t2 WHERE span > 0 GROUP BY ALL),
ts1 AS (SELECT {KEY}, list_reduce(ss, lambda done, s: CASE WHEN s[1].a >= done[-1].z THEN list_concat(done, s) ELSE done END) AS taken FROM ts0),
t3 AS (SELECT t2.*, span > 0 AS cross0, false AS label0, dimension OR coalesce(len(list_filter(taken, lambda s: s.a <= i AND i < s.z)) > 0, false) AS consumed FROM t2 LEFT JOIN ts1 USING ({KEY}))"""
INFO = f"""{TOKENS},
c0 AS (SELECT {KEY}, line, regexp_matches(line, {q(rx.CURRENCY)}) AS has_currency FROM cat),
ca AS (SELECT {KEY}, i, cleaned, number, CASE WHEN has_currency THEN 3 ELSE 0 END + {POINTS} AS score FROM t3 JOIN c0 USING ({KEY}) WHERE NOT unit AND price AND NOT year AND number IS NOT NULL),
cl AS (SELECT {KEY}, max(score) AS best, max(number) AS max_value, arg_max(cleaned, score * 1000 + i) AS top_token, max(score) > 0 AS top_ok FROM ca GROUP BY ALL),
tl AS (SELECT {KEY}, bool_or(axis) AS axis, bool_or(dimension OR cross0 OR label0) AS has_dimension_candidate, sum(CAST(plausible AS INT)) AS plausible_tokens, count(*) AS n_tokens,
  sum(CAST(regexp_matches(token, '[A-Za-z]') AS INT)) AS alpha_tokens, sum(CAST(regexp_matches(token, '^[A-Z][a-z]+$') AS INT)) AS title, bool_or(regexp_matches(token, '^[0-9]{{1,9}}$') AND TRY_CAST(token AS INT) BETWEEN 10 AND 250) AS index_number
  FROM t3 GROUP BY ALL),
l0 AS (SELECT c0.*, coalesce(cl.best, 0) AS best, coalesce(cl.max_value, 0) AS max_value, cl.top_token, cl.top_ok, tl.* EXCLUDE ({KEY}, axis),
  {has('line', rx.DIMENSION_IN_LINE)} OR {has('line', rx.UNIT)} AS dim, {has('line', rx.DIMENSION_IN_LINE)} OR {has('line', rx.UNIT)} OR {has('line', rx.MEASURE)} OR contains(line, '"') OR coalesce(tl.axis, false) AS measure,
  {count('line', rx.NUMBER)} AS number_count, regexp_extract_all(line, {q(rx.TOC_PAIR)}, 1) AS pairs, {count('line', rx.YEAR_EUR)} AS year_hits, {count('line', rx.SHORT_NUMBER)} AS short_numbers,
  list_filter(regexp_extract_all(line, {q(rx.CODE_TOKEN)}), lambda x: {plausible('x')}) AS codes, {has('line', rx.CODE_LABEL)} AS code_label, {has('line', rx.SPEC)} AS spec
  FROM c0 LEFT JOIN cl USING ({KEY}) LEFT JOIN tl USING ({KEY})),
li AS (SELECT *, len(codes) AS code_hits,
  CASE WHEN best >= 3 THEN true WHEN best = 2 THEN max_value >= 10 OR has_currency WHEN best = 1 THEN NOT dim AND number_count <= 3 AND max_value >= 10 ELSE false END AND NOT (measure AND NOT has_currency) AS price_like,
  measure OR number_count >= 4 AND best <= 2 OR number_count >= 3 AND max_value < 10 AND NOT has_currency AS dimension_line,
  len(pairs) >= 2 AND len(list_distinct(pairs)) >= 2 OR (contains(line, '€') OR contains(upper(line), 'EUR')) AND year_hits > 0 AND short_numbers >= 3 AND plausible_tokens = 0 AS toc_line,
  {LEGAL_HITS} AS legal_hits, {LEGAL_HITS} >= 2 OR {LEGAL_HITS} >= 1 AND length(line) > 220 AND {count('line', '[;:§]')} >= 2 AS is_legal,
  {words_in('line', rx.HEADER_WORDS)} >= 2 OR {words_in('line', rx.HEADER_WORDS)} >= 1 AND length(line) <= 60 AS is_header, {words_in('line', rx.LEGEND_WORDS)} AS legend_hits
  FROM l0)"""
ROWS = f"""{INFO},
pc AS (SELECT {KEY}, i, cleaned, number, CASE WHEN near THEN 3 ELSE 0 END + {POINTS} AS score FROM t3 WHERE NOT consumed AND NOT unit AND price AND NOT year AND number > 0 AND number >= {CONFIG.price_min} AND number < {CONFIG.price_max}),
cc AS (SELECT {KEY}, i, code FROM t3 JOIN (SELECT {KEY}, code_label, spec FROM l0) USING ({KEY}) WHERE NOT consumed AND NOT currency AND {valid('code')} AND NOT ({has('code', rx.SHORT_GRADE)} AND NOT code_label) AND NOT (spec AND NOT code_label AND length(code) <= 5)),
pl AS (SELECT {KEY}, count(*) AS n_prices, max(number) AS largest, arg_max(i, (score, number, -i)) AS price_i, arg_max(cleaned, (score, number, -i)) AS best_price FROM pc GROUP BY ALL),
dl AS (SELECT {KEY}, count(*) AS n_codes, arg_max(i, (length(code), -i)) AS code_i, arg_max(code, (length(code), -i)) AS best_code FROM cc GROUP BY ALL),
nm AS (SELECT {KEY}, string_agg(token, ' ' ORDER BY i) AS resolved_name FROM t3 LEFT JOIN pl USING ({KEY}) LEFT JOIN dl USING ({KEY}) WHERE NOT consumed AND NOT currency AND i IS DISTINCT FROM price_i AND i IS DISTINCT FROM code_i GROUP BY ALL),
r0 AS (SELECT *, CASE WHEN top_ok AND NOT {year('top_token', 'top_token')} AND {number('top_token')} >= {CONFIG.price_min} AND {number('top_token')} < {CONFIG.price_max} THEN {number('top_token')} END AS price FROM li),
r1 AS (SELECT *, CASE WHEN price IS NOT NULL THEN top_token ELSE '' END AS price_raw FROM r0),
r2 AS (SELECT *, coalesce(list_filter(codes, lambda x: price_raw = '' OR x <> price_raw)[1], '') AS code_raw FROM r1),
r3 AS (SELECT *, CASE WHEN code_raw = '' OR instr(line, code_raw) = 0 THEN line ELSE substr(line, 1, instr(line, code_raw) - 1) || ' ' || substr(line, instr(line, code_raw) + length(code_raw)) END AS n1 FROM r2),
r4 AS (SELECT *, CASE WHEN price_raw = '' OR instr(n1, price_raw) = 0 THEN n1 ELSE substr(n1, 1, instr(n1, price_raw) - 1) || ' ' || substr(n1, instr(n1, price_raw) + length(price_raw)) END AS n2 FROM r3),
rw AS (SELECT r4.* EXCLUDE (n1, n2), CASE WHEN trim(regexp_replace(n2, '\\s{{2,}}', ' ', 'g')) = '' THEN coalesce(resolved_name, '') ELSE trim(regexp_replace(n2, '\\s{{2,}}', ' ', 'g')) END AS name, CASE WHEN {code('code_raw')} = '' THEN coalesce(best_code, '') ELSE {code('code_raw')} END AS art_no, coalesce(n_prices, 0) AS n_prices, largest, coalesce(n_codes, 0) AS n_codes, best_price, best_code, coalesce(resolved_name, '') AS resolved_name
  FROM r4 LEFT JOIN pl USING ({KEY}) LEFT JOIN dl USING ({KEY}) LEFT JOIN nm USING ({KEY}))"""
VALID = valid("art_no")
JUDGED = f"""{ROWS},
j0 AS (SELECT *, {VALID} AS ok, length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS alpha_chars, price_like OR n_prices > 0 OR price IS NOT NULL AS priced,
  list_filter(string_split_regex(resolved_name, '\\s+'), lambda x: regexp_matches(x, '[A-Za-z]') AND NOT {has('x', rx.DIMENSION_WORD)}) AS nw FROM rw),
jd AS (SELECT *,
  CASE WHEN NOT {has('line', rx.NUMBER)} AND regexp_matches(line, '(?i)\\b(?:code|description|price)\\b') THEN 'header_like' WHEN toc_line THEN 'toc_year_price'
   WHEN art_no = '' AND n_codes = 0 AND n_prices = 0 THEN 'bad_id' WHEN art_no = '' THEN '' WHEN dimension_line AND NOT price_like THEN 'dimension_line' ELSE '' END AS discard_reason,
  CASE WHEN NOT ok AND toc_line THEN 'noise_toc_line'
   WHEN NOT ok AND title >= 2 AND index_number AND NOT has_currency AND n_codes = 0 THEN 'noise_index'
   WHEN NOT ok AND (is_header OR legend_hits >= 2) THEN 'noise_header_legend'
   WHEN ok AND legend_hits >= 2 AND alpha_tokens < 2 THEN 'noise_header_legend'
   WHEN ok AND has_currency AND (contains(line, '€') OR contains(upper(line), 'EUR')) AND largest <= 3 THEN 'noise_header_eur1'
   WHEN NOT ok AND (contains(lower(line), 'extra charge') OR contains(lower(line), 'treatment')) AND n_tokens >= 6 THEN 'noise_accessory_note'
   WHEN NOT ok AND (contains(lower(line), 'anti-stain') OR contains(lower(line), 'antistain')) THEN 'noise_accessory_note'
   WHEN NOT ok AND regexp_matches(line, '(?i)\\b(?:cat|category|sq\\.?\\s*m|sqm|mq)\\b') THEN 'noise_material_metric'
   WHEN NOT ok AND (regexp_matches(line, '(?i)\\b(?:peso|weight|volume)\\b') OR regexp_matches(line, '\\bL[1-3]\\b')) THEN 'noise_weight_dim'
   WHEN n_codes >= 2 THEN 'noise_composition'
   WHEN NOT ok AND (has_dimension_candidate OR dimension_line) AND NOT priced THEN 'noise_dimension_block'
   WHEN NOT ok AND priced AND (alpha_tokens < 2 OR alpha_chars < 4 OR n_tokens <= 2 AND has_currency) THEN 'noise_price_only' ELSE '' END AS noise_class,
  CASE WHEN is_legal THEN 'hard_legal' WHEN (has_dimension_candidate OR {has('line', rx.DIMENSION_WORD)}) AND len(nw) < 2 AND length(regexp_replace(array_to_string(nw, ''), '[^A-Za-z]', '', 'g')) < 4 THEN 'dim_only_row'
   WHEN is_header THEN 'header_like_strict' WHEN art_no = '' THEN 'missing_art_no' WHEN regexp_matches(art_no, '^[0-9]+$') AND (dimension_line OR has_dimension_candidate) THEN 'numeric_dimension_artno'
   WHEN NOT ok THEN 'hard_art_no' ELSE '' END AS hard_reason,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (CASE WHEN art_no = '' THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN name = '' THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN price IS NULL THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END))) AS confidence FROM j0),
sc AS (SELECT * REPLACE (CASE WHEN hard_reason IN ('hard_legal', 'dim_only_row', 'header_like_strict') THEN least(confidence, 0.3::DOUBLE) ELSE confidence END AS confidence), ok AND price IS NOT NULL AND hard_reason NOT IN ('missing_art_no', 'hard_art_no', 'numeric_dimension_artno', 'dim_only_row', 'header_like_strict') AS exported FROM jd),
ex AS (SELECT *, NOT exported AS needs_review, concat_ws('; ', CASE WHEN dimension_line THEN 'dimension_line' END, CASE WHEN NOT price_like THEN 'no_price_like' END, CASE WHEN art_no = '' THEN 'missing_art_no' END, CASE WHEN name = '' THEN 'missing_product_name' END, CASE WHEN price IS NULL THEN 'missing_price_eur' END,
  CASE WHEN has_dimension_candidate THEN 'dim_detected' END, CASE WHEN n_prices > 0 THEN 'price_detected' END, CASE WHEN n_codes > 0 THEN 'artno_detected' END, CASE WHEN NOT ok THEN 'invalid_chunk_missing_art_no' END, CASE WHEN n_prices = 0 AND n_codes = 0 THEN 'no_price_no_artno' END,
  CASE WHEN hard_reason NOT IN ('', 'missing_art_no') OR hard_reason = 'missing_art_no' AND art_no <> '' THEN hard_reason END, CASE WHEN NOT (price IS NOT NULL OR price_like OR n_prices > 0) THEN 'partial_export_weak_signal' END, CASE WHEN NOT ok AND art_no <> '' THEN 'missing_art_no' END, CASE WHEN price IS NULL THEN 'missing_price' END,
  CASE WHEN exported AND dimension_line THEN 'SOFT_REVIEW:dimension_line' END) AS notes FROM sc WHERE discard_reason = '' AND noise_class = ''),
du AS (SELECT *, row_number() OVER (PARTITION BY source_file, art_no ORDER BY row_score DESC, page_number, line_no) AS dup_rank FROM (SELECT *,
  CASE WHEN name <> '' THEN 3 ELSE 0 END + CASE WHEN price IS NOT NULL OR price_like THEN 4 ELSE 0 END + CASE WHEN has_currency THEN 2 ELSE 0 END - CASE WHEN dimension_line THEN 3 ELSE 0 END
  - CASE WHEN len(string_split_regex(line, '\\s+')) > 10 AND NOT price_like THEN 2 ELSE 0 END - CAST(needs_review AS INT) - CAST(NOT exported AS INT) AS row_score FROM ex WHERE ok))"""
PAGES = f"""{INFO},
co AS (SELECT *, max(CAST(price_like AS INT)) OVER (PARTITION BY source_file, page_number ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AND code_hits > 0 AS row_candidate, price_like AND code_hits > 0 AS cooccurs FROM li),
p0 AS (SELECT source_file, page_number, count(*) AS n_lines, sum(length(regexp_replace(line, '[^0-9²³¹]', '', 'g'))) AS digits, sum(length(line)) AS chars, sum(CAST(price_like AS INT)) AS price_like_count, sum(code_hits) AS mixed_code_count,
  sum(CAST(cooccurs AS INT)) AS cooccurrence_count, sum(CAST(row_candidate AS INT)) AS row_candidate_count, sum(len(regexp_extract_all(line, '€|\\b(?:EUR|DKK|SEK|NOK|USD|GBP|CHF|JPY|CAD|AUD)\\b'))) AS currency_tokens,
  sum(len(pairs)) AS pair_count, sum(year_hits) AS year_hits, sum(short_numbers) AS short_numbers, sum(plausible_tokens) AS plausible_tokens, sum(CAST(len(regexp_extract_all(line, '[0-9]+(?:[.,][0-9]+)?')) >= 2 AS INT)) AS numeric_lines,
  {' + '.join(f"max(CAST({has('line', p)} AS INT))" for p in rx.LEGAL)} AS legal_hits, {' + '.join(f"max(CAST(contains(lower(line), {q(w)}) AS INT))" for w in rx.PAGE_LEGAL_WORDS)} AS page_legal_words,
  bool_or({words_in('line', rx.STOPWORDS)} > 0) AS has_stopword FROM co GROUP BY ALL),
p1 AS (SELECT *, CAST(digits AS DOUBLE) / (chars + n_lines - 1) AS numeric_density, numeric_lines >= 0.2::DOUBLE * n_lines AS table_hint FROM p0),
p2 AS (SELECT *, (4.0::DOUBLE * cooccurrence_count + 2.0::DOUBLE * price_like_count + mixed_code_count + 1.5::DOUBLE * currency_tokens + 40.0::DOUBLE * numeric_density + CASE WHEN table_hint THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END)
  * CASE WHEN page_legal_words > 0 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN has_stopword THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS signal_score,
  2 * pair_count + year_hits + CAST(short_numbers >= 6 AS INT) + CAST(pair_count >= 3 AS INT) + CASE WHEN mixed_code_count <= 0 AND plausible_tokens = 0 THEN 2 ELSE 0 END AS toc_score FROM p1),
pg AS (SELECT *, toc_score >= 4 AS toc_like, toc_score >= 4 AND pair_count >= 3 AND row_candidate_count <= 1 AND mixed_code_count <= 1 AS toc_hard FROM p2)"""
TRIAGE = """
tr0 AS (SELECT source_file, """ + ", ".join(f"CAST(sum({count('line', p)}) AS BIGINT) AS {n}" for n, p in (("art_no_count", r"(?i)\bart\.?\s*no\.?"), ("rrp_count", r"(?i)\brrp\b"), ("colli_count", r"(?i)\bcolli\b"), ("designer_count", r"(?i)\bdesigner\b"), ("code_count", r"(?i)\bcode\b"), ("description_count", r"(?i)\bdescription\b"), ("price_label_count", r"(?i)\bprice\b"), ("price_count", rx.CURRENCY_PRICE), ("currency_count", r"\b(?:EUR|DKK|SEK|NOK)\b"))) + """ FROM cat GROUP BY 1),
tr1 AS (SELECT *, 2 * rrp_count + 2 * art_no_count + colli_count + designer_count AS marker_score, 2 * (code_count + description_count) + price_label_count + price_count + currency_count AS code_price_score FROM tr0),
tri AS (SELECT *, CASE WHEN art_no_count >= 20 AND rrp_count >= 20 THEN 'marker'
  WHEN marker_score >= 6 AND art_no_count >= 2 AND rrp_count >= 2 AND (NOT (code_price_score >= 6 AND price_count >= 3) OR marker_score >= code_price_score) THEN 'marker'
  WHEN code_price_score >= 6 AND price_count >= 3 THEN 'code_price_based' ELSE 'unknown' END AS profile, greatest(marker_score, code_price_score) AS support_score FROM tr1)"""
WORDS = f"wd AS (SELECT source_file, page_number, line_no, token AS text, CAST(40 * i AS DOUBLE) AS x0, CAST(10 * line_no AS DOUBLE) AS top, cleaned FROM t0)"

MARKER = f"""{CATALOG},
mp AS (SELECT {KEY}, i, upper(regexp_extract_all(line, {q(rx.CURRENCY_PRICE)}, 1)[i]) AS c, regexp_replace(regexp_extract_all(line, {q(rx.CURRENCY_PRICE)}, 2)[i], '[.,]+$', '') AS raw FROM (SELECT *, unnest(range(1, {count('line', rx.CURRENCY_PRICE)} + 1)) AS i FROM cat)),
mv AS (SELECT *, {number('raw')} AS v FROM mp), ml AS (SELECT {KEY}, {', '.join(f"arg_max(v, i) FILTER (c = '{c}') AS price_{c.lower()}" for c in rx.ROW_CURRENCIES)} FROM mv WHERE v >= 0.01 AND v < 1000000 AND NOT {year('raw', 'raw')} GROUP BY ALL),
ms AS (SELECT {KEY}, TRY_CAST(regexp_extract(line, '(?i)Colli\\s*:\\s*(\\d+)', 1) AS INT) AS colli, {code("regexp_extract(line, '(?i)Art\\.?\\s*no\\.?\\s*:\\s*([A-Za-z0-9\\-]+)', 1)")} AS marker_code, regexp_extract(line, '(?i)Size\\s*:\\s*(.*)$', 1) AS size_raw FROM cat),
mk AS (SELECT ms.*, {', '.join(f"TRY_CAST(replace(regexp_extract(size_raw, '(?i)" + chr(92) + f"b{k}" + chr(92) + "b" + chr(92) + "s*([0-9]+(?:[.,][0-9]+)?)" + chr(92) + f"s*cm', 1), ',', '.') AS DOUBLE) AS {n}" for k, n in (("W", "width_cm"), ("H", "height_cm"), ("L", "length_cm")))}, price_dkk, price_sek, price_nok, price_eur FROM ms LEFT JOIN ml USING ({KEY}))"""
B = lambda *names: ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


def oracle_sql() -> dict[str, str]:
    return {
        "price_summary": f"{ROWS}, f AS (SELECT *, row_number() OVER (PARTITION BY source_file, art_no ORDER BY page_number, line_no) AS n FROM rw WHERE art_no <> '' AND price IS NOT NULL) SELECT source_file, count(*) AS n_codes, min(price) AS min_price, max(price) AS max_price, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) AS sum_cents FROM f WHERE n = 1 GROUP BY 1",
        "normalize_lines": r"""SELECT doc_id, line_no, line FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace(translate(text, '­Øø', '-Oo'), '([A-Za-z0-9_])-\n([A-Za-z0-9_])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\r\n|[\n\r]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents))""".replace("lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')", r"lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')"),
        "tokenize": f"{TOKENS} SELECT {KEY}, CAST(i AS INT) AS token_idx, token FROM tk",
        "token_classes": f"{TOKENS} SELECT CASE WHEN dimension THEN 'DIM_CANDIDATE' WHEN currency THEN 'PRICE_CANDIDATE' WHEN price AND number >= 0.01 AND number < 1000000 AND NOT {year('cleaned', 'cleaned')} THEN 'PRICE_CANDIDATE' WHEN {valid('code')} THEN 'ARTNO_CANDIDATE' ELSE 'TEXT' END AS token_class, count(*) AS n, count(DISTINCT token) AS n_distinct FROM t1 GROUP BY 1",
        "parse_numbers": f"{TOKENS} SELECT token, {number('token')} AS number, count(*) AS n FROM tk GROUP BY ALL",
        "code_tokens": f"{TOKENS} SELECT code, {valid('code')} AS is_valid, plausible AS is_plausible, count(*) AS n FROM t1 GROUP BY ALL",
        "line_flags": f"{INFO} SELECT {KEY}, has_currency, measure AS measure_context, dimension_line, price_like, toc_line, {B('number_count', 'best', 'code_hits')}, max_value FROM li",
        "best_price_per_line": f"{INFO} SELECT {KEY}, top_token AS price_token, CAST(best AS INT) AS score FROM li WHERE best > 0",
        "price_candidates": f"{ROWS} SELECT {KEY}, CAST(i AS INT) AS token_idx, cleaned AS token, number AS value, CAST(score AS INT) AS score FROM pc",
        "resolved_fields": f"{ROWS} SELECT {KEY}, best_price, best_code, resolved_name, has_dimension_candidate FROM rw",
        "toc_lines": f"{INFO} SELECT {KEY}, {B('year_hits', 'short_numbers')}, CAST(len(pairs) AS BIGINT) AS n_pairs FROM li WHERE toc_line",
        "legal_lines": f"{INFO} SELECT {KEY}, CAST(legal_hits AS INT) AS legal_hits, is_legal FROM li WHERE legal_hits > 0",
        "header_lines": f"{INFO} SELECT {KEY}, is_header, CAST(legend_hits AS INT) AS legend_hits FROM li WHERE is_header OR legend_hits >= 2",
        "cooccurrence_window": f"{PAGES} SELECT {KEY}, cooccurs, row_candidate FROM co",
        "page_signals": f"{PAGES} SELECT source_file, page_number, {B('n_lines', 'digits', 'chars', 'price_like_count', 'mixed_code_count', 'cooccurrence_count', 'row_candidate_count', 'currency_tokens', 'legal_hits')}, numeric_density, table_hint, has_stopword, signal_score FROM pg",
        "toc_pages": f"{PAGES} SELECT source_file, page_number, CAST(toc_score AS BIGINT) AS toc_score, toc_like, toc_hard FROM pg",
        "page_gates": f"{PAGES} SELECT source_file, page_number, row_candidate_count = 0 AND mixed_code_count = 0 AND (cooccurrence_count = 0 AND price_like_count < 2 AND numeric_density < 0.08::DOUBLE OR legal_hits >= 2 AND cooccurrence_count = 0 AND price_like_count < 3) AS text_like, legal_hits >= 2 AND (cooccurrence_count < 2 OR NOT table_hint) AS review_only FROM pg",
        "signal_score_topk": f"{PAGES}, rk AS (SELECT *, count(*) OVER (PARTITION BY source_file) AS n_pages, row_number() OVER (PARTITION BY source_file ORDER BY toc_hard, cooccurrence_count DESC, mixed_code_count DESC, price_like_count DESC, signal_score DESC, page_number) AS page_rank FROM pg) SELECT source_file, page_number, CAST(page_rank AS INT) AS page_rank, signal_score FROM rk WHERE page_rank <= least(n_pages, greatest(8, least(20, n_pages // 2)))",
        "discard_reasons": f"{JUDGED} SELECT discard_reason, count(*) AS n FROM jd GROUP BY 1",
        "noise_classes": f"{JUDGED} SELECT {KEY}, noise_class FROM jd",
        "hard_validation": f"{JUDGED} SELECT {KEY}, hard_reason FROM jd",
        "row_scoring": f"{JUDGED} SELECT {KEY}, art_no, name, price, confidence, confidence < 0.75 OR art_no = '' OR name = '' AS needs_review FROM jd",
        "products": f"{JUDGED} SELECT {KEY}, art_no, name, price, confidence, notes FROM ex WHERE exported",
        "review": f"{JUDGED} SELECT {KEY}, art_no, name, price, confidence, notes FROM ex WHERE needs_review OR NOT exported",
        "guardrail_counts": f"{JUDGED} SELECT hard_reason, noise_class, count(*) AS n FROM jd GROUP BY ALL",
        "review_reasons": f"{JUDGED} SELECT note, count(*) AS n FROM (SELECT unnest(string_split(CASE WHEN notes = '' THEN 'unspecified' ELSE notes END, '; ')) AS note FROM ex WHERE needs_review OR NOT exported) WHERE note <> '' GROUP BY 1 ORDER BY n DESC, note LIMIT 20",
        "dedup_best": f"{JUDGED} SELECT {KEY}, art_no, CAST(row_score AS INT) AS row_score, CAST(dup_rank AS INT) AS dup_rank, CASE WHEN dup_rank = 1 THEN 'best' WHEN NOT (price_like OR price IS NOT NULL) THEN 'technical_sheet_line' WHEN is_header THEN 'header_noise_conflict' ELSE 'real_price_conflict' END AS dup_verdict FROM du",
        "duplicate_conflicts": f"{JUDGED} SELECT source_file, art_no, count(*) AS n_rows, count(DISTINCT (lower(trim(name)), coalesce(CAST(price AS VARCHAR), ''))) AS n_variants FROM ex WHERE ok GROUP BY ALL HAVING count(*) > 1",
        "parser_metrics": f"{JUDGED}, m AS (SELECT source_file, count(*) AS n_rows, count(DISTINCT CASE WHEN art_no <> '' THEN art_no END) AS n_codes, CAST(sum(CAST(art_no <> '' AND price IS NOT NULL AS INT)) AS BIGINT) AS n_key, CAST(sum(CAST(needs_review AS INT)) AS BIGINT) AS n_review FROM ex GROUP BY 1), k AS (SELECT *, CAST(n_codes AS DOUBLE) / n_rows AS unique_code_ratio, CAST(n_key AS DOUBLE) / n_rows AS key_fields_rate, CAST(n_review AS DOUBLE) / n_rows AS review_rate FROM m) SELECT *, key_fields_rate + 0.6::DOUBLE * unique_code_ratio - 0.5::DOUBLE * CASE WHEN n_review = 0 THEN 1.0::DOUBLE ELSE review_rate END AS run_score, n_rows >= 5 AND unique_code_ratio >= 0.15::DOUBLE AND key_fields_rate >= 0.5::DOUBLE AS ok FROM k",
        "currency_detect": f"{CATALOG}, c AS (SELECT source_file, upper(unnest(regexp_extract_all(line, {q(rx.CURRENCY_PRICE)}, 1))) AS c FROM cat), n AS (SELECT source_file, {', '.join(f"CAST(sum(CAST(c = '{c}' AS INT)) AS BIGINT) AS {c.lower()}" for c in rx.ROW_CURRENCIES)}, count(*) AS total FROM c GROUP BY 1), x AS (SELECT *, greatest(dkk, sek, nok, eur) AS most, CAST(dkk > 0 AS INT) + CAST(sek > 0 AS INT) + CAST(nok > 0 AS INT) + CAST(eur > 0 AS INT) >= 2 AS filter_currency FROM n) SELECT source_file, dkk, sek, nok, eur, total, CASE WHEN filter_currency AND eur > 0 THEN 'EUR' WHEN total < 5 OR most / total < 0.6 THEN 'EUR' WHEN dkk = most THEN 'DKK' WHEN sek = most THEN 'SEK' WHEN nok = most THEN 'NOK' ELSE 'EUR' END AS target_currency, filter_currency FROM x",
        "marker_fields": f"{MARKER} SELECT * FROM mk",
        "currency_filter": f"{MARKER} SELECT {KEY}, CAST(NULL AS DOUBLE) AS price_dkk, CAST(NULL AS DOUBLE) AS price_sek, CAST(NULL AS DOUBLE) AS price_nok, price_eur FROM mk",
        "triage_scores": f"{CATALOG}, {TRIAGE} SELECT * FROM tri",
        "corpus_groups": f"{PAGES}, {TRIAGE}, dd AS (SELECT source_file, sum(digits) AS digits, sum(chars + n_lines - 1) AS chars, sum(currency_tokens) AS cur, count(*) AS n_pages FROM pg GROUP BY 1), sg AS (SELECT *, profile || '_' || CASE WHEN CAST(digits AS DOUBLE) / chars >= 0.08::DOUBLE THEN 'nhigh' WHEN CAST(digits AS DOUBLE) / chars >= 0.04::DOUBLE THEN 'nmid' ELSE 'nlow' END || '_' || CASE WHEN cur > 0 THEN 'cany' ELSE 'cnone' END AS signature FROM dd JOIN tri USING (source_file)) SELECT signature, count(*) AS n_docs, CAST(sum(n_pages) AS BIGINT) AS n_pages, array_to_string((list(source_file ORDER BY source_file))[1:3], ',') AS examples FROM sg GROUP BY 1",
        "missing_labels": f"{CATALOG} SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(line), '[^a-z]+')) AS word FROM cat WHERE NOT regexp_matches(line, '[0-9]')) WHERE length(word) >= 3 AND word NOT IN ('the', 'and', 'of', 'about', 'for') AND word NOT IN (SELECT DISTINCT lower(unnest(string_split(p_type, ' '))) FROM part) GROUP BY 1 ORDER BY n DESC, word LIMIT 20",
        "code_patterns": f"{ROWS} SELECT CASE WHEN regexp_matches(art_no, '^[0-9]+$') THEN 'digits_only' WHEN regexp_matches(art_no, '[-./]') THEN 'alnum_with_separators' ELSE 'mixed' END AS pattern, count(*) AS n, count(DISTINCT art_no) AS n_codes, min(art_no) AS example FROM rw WHERE art_no <> '' GROUP BY 1",
        "price_formats": f"{INFO} SELECT CASE WHEN regexp_matches(cleaned, '\\..*,') THEN 'dot_comma' WHEN regexp_matches(cleaned, ',.*\\.') THEN 'comma_dot' WHEN contains(cleaned, ',') THEN 'comma' WHEN contains(cleaned, '.') THEN 'dot' ELSE 'none' END AS format, count(*) AS n, min(cleaned) AS smallest, max(cleaned) AS largest FROM ca GROUP BY 1",
        "section_carry": f"{CATALOG}, h AS (SELECT *, NOT regexp_matches(line, '[0-9]') AND length(line) BETWEEN 3 AND 40 AND {words_in('line', rx.NOT_SECTION_WORDS)} = 0 AND NOT regexp_matches(lower(line), '\\b(?:dkk|sek|nok|eur)\\s*[0-9]') AS heading FROM cat WHERE line_no < 8), o AS (SELECT source_file, page_number, arg_min(line, line_no) FILTER (heading) AS own_section FROM h GROUP BY ALL) SELECT *, last_value(own_section IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM o",
        "sample_counts": f"{CATALOG}, n AS (SELECT source_file, max(page_number) AS n_pages FROM cat GROUP BY 1) SELECT source_file, n_pages, CAST(greatest(1, least(CASE WHEN n_pages < 20 THEN least(10, greatest(4, ceil(n_pages * 15 / 100))) WHEN n_pages < 100 THEN least(20, greatest(8, ceil(n_pages / 10))) ELSE least(25, greatest(8, ceil(n_pages / 100))) END, 200, n_pages)) AS BIGINT) AS n_sample FROM n",
        "table_metrics": f"{TOKENS}, {WORDS}, b AS (SELECT source_file, page_number, floor(x0 / 20) AS xb, floor(top / 5) AS yb, regexp_matches(text, '[0-9]') AS numeric FROM wd), c AS (SELECT source_file, page_number, xb FROM b GROUP BY ALL HAVING count(*) >= 10), s AS (SELECT source_file, page_number, yb, count(DISTINCT xb) AS n FROM b SEMI JOIN c USING (source_file, page_number, xb) WHERE numeric GROUP BY ALL), r AS (SELECT source_file, page_number, sum(CAST(n >= 2 AS INT)) AS t FROM s GROUP BY ALL), y AS (SELECT source_file, page_number, count(DISTINCT yb) AS n_lines FROM b GROUP BY ALL), w AS (SELECT source_file, page_number, count(*) AS n_columns FROM c GROUP BY ALL) SELECT source_file, page_number, n_lines, coalesce(n_columns, 0) AS n_columns, CAST(coalesce(t, 0) AS BIGINT) AS table_lines, CAST(coalesce(t, 0) AS DOUBLE) / n_lines AS numeric_line_ratio FROM y LEFT JOIN w USING (source_file, page_number) LEFT JOIN r USING (source_file, page_number)",
        "stitch_pairs": f"{TOKENS}, {WORDS}, a AS (SELECT * FROM wd WHERE {plausible('text')}), p AS (SELECT *, {number('cleaned')} AS price FROM wd WHERE {has('cleaned', rx.PRICE_TOKEN)} AND NOT {year('cleaned', 'cleaned')}), j AS (SELECT a.source_file, a.page_number, a.line_no, a.text AS code, p.price, CASE WHEN p.x0 >= a.x0 THEN p.x0 - a.x0 ELSE a.x0 - p.x0 + 10000 END AS cost, a.x0 AS ax, p.x0 AS px FROM a JOIN p ON a.source_file = p.source_file AND a.page_number = p.page_number AND a.line_no = p.line_no WHERE p.price >= 0.01 AND p.price < 1000000), n AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY cost, ax, px) AS n FROM j) SELECT {KEY}, code, price, cost FROM n WHERE n = 1",
        "line_clusters": f"{TOKENS}, {WORDS} SELECT source_file, page_number, CAST(row_number() OVER (PARTITION BY source_file, page_number ORDER BY line_no) - 1 AS INT) AS cluster, string_agg(text, ' ' ORDER BY x0) AS line FROM wd GROUP BY source_file, page_number, line_no",
    }
