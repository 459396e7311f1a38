"""Column functions over strings: texts, tokens, numbers and codes. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelore.config import CONFIG
from pricelore.functions import patterns as rx


def let(c: Column, f) -> Column:
    """f of c, with c computed once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def normalize_text(c: Column) -> Column:
    """Soft hyphens to hyphens, barred o to o, words joined over line ends, runs of blanks to one, ends trimmed."""
    c = F.translate(c, "­Øø", "-Oo")
    c = F.regexp_replace(c, r"([A-Za-z0-9_])-\n([A-Za-z0-9_])", "$1$2")
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"^\s+|\s+$", "")


def split_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def strip_section_line(lines: Column, section: Column) -> Column:
    """lines without the first that equals the section."""
    at = F.array_position(lines, section)
    return F.when(at == 0, lines).otherwise(F.concat(F.slice(lines, F.lit(1), (at - 1).cast("int")), F.slice(lines, (at + 1).cast("int"), F.size(lines))))


def tokenize(c: Column) -> Column:
    parts = F.split(F.regexp_replace(F.replace(c, F.lit("€"), F.lit(" € ")), r"^\s+|\s+$", ""), r"\s+")
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(rx.STRIP_CHARS))), lambda x: x != "")


def parse_number(c: Column) -> Column:
    """The number in a string: of two kinds of separators the later is the decimal one; a single kind before exactly three
    digits, in more than four characters, separates thousands. Null if it can't be read."""

    def read(s: Column) -> Column:
        comma, dot = F.instr(F.reverse(s), ","), F.instr(F.reverse(s), ".")
        plain = F.replace(s, F.lit(","), F.lit("."))
        text = (
            F.when((comma > 0) & (dot > 0) & (comma < dot), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when((comma > 0) & (dot > 0), F.replace(s, F.lit(","), F.lit("")))
            .when(((comma == 4) | (dot == 4)) & (F.length(s) > 4), F.translate(s, ",.", ""))
            .otherwise(plain)
        )
        return let(text, lambda t: F.when(t.rlike(r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), t.try_cast("double")))

    return let(F.regexp_replace(c, r"[^0-9,.]", ""), read)


def is_year(cleaned: Column, raw: Column) -> Column:
    return cleaned.rlike(r"^\d{4}$") & ~raw.rlike("[.,]") & (cleaned.try_cast("int").between(rx.YEAR_MIN, rx.YEAR_MAX))


def parse_price(c: Column) -> Column:
    return let(parse_number(c), lambda v: F.when((v >= CONFIG.price_min) & (v < CONFIG.price_max) & ~is_year(c, c), v))


def canonical_code(c: Column) -> Column:
    dashed = F.translate(c, "­‐‑‒–—−", "-------")
    return F.regexp_replace(F.regexp_replace(dashed, r"\s+", ""), "-{2,}", "-")


def is_blacklisted(code: Column) -> Column:
    out = F.lit(False)
    for p in (rx.COLOUR_TEMPERATURE, rx.WATT, rx.SOCKET, rx.T_SERIES, rx.SINGLE_LETTER, rx.SHORT_GRADE):
        out = out | code.rlike(p)
    return out


def _is_valid_canonical(code: Column, min_len: int) -> Column:
    return (F.length(code) >= max(6, min_len)) & code.rlike("[A-Za-z]") & code.rlike("[0-9]") & ~code.rlike(rx.DIMENSION_TOKEN) & ~code.rlike(rx.DATE_TOKEN) & ~code.rlike(rx.NUMBER_WITH_UNIT) & ~is_blacklisted(code)


def is_valid_code(c: Column, min_len: int = CONFIG.code_min_len) -> Column:
    return let(canonical_code(c), lambda code: _is_valid_canonical(code, min_len))


def is_plausible_code(c: Column, min_len: int = CONFIG.code_min_len) -> Column:
    """A valid code of which enough are letters and digits, in a balance, that don't take turns all the way."""

    def balanced(own: Column, alnum: Column) -> Column:
        digits = F.length(F.regexp_replace(alnum, "[^0-9]", ""))
        n = F.length(alnum)
        # Runs of letters and of digits, less one, are the changes between them.
        changes = F.regexp_count(alnum, F.lit("[0-9]+|[A-Za-z]+")) - 1
        return (n >= 0.6 * F.length(own)) & let(digits, lambda d: (d >= 0.2 * n) & (d <= 0.85 * n)) & ~((n >= 5) & (n <= 8) & (changes > 0.7 * (n - 1)))

    def plausible(own: Column) -> Column:
        # What is too short, or has no letter or no digit, goes first: most words do.
        return (F.length(own) >= max(6, min_len)) & own.rlike("[0-9]") & own.rlike("[A-Za-z]") & is_valid_code(own, min_len) & ~own.rlike(rx.TRIPLE) & let(F.regexp_replace(own, "[^A-Za-z0-9]", ""), lambda alnum: balanced(own, alnum))

    return let(F.regexp_replace(c, r"\s+", ""), plausible)


def strip_currency(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.replace(c, F.lit("€"), F.lit("")), rx.CURRENCY_EDGE, ""))


def is_dimension_candidate(c: Column) -> Column:
    return let(F.replace(c, F.lit("×"), F.lit("x")), lambda own: F.replace(own, F.lit(" "), F.lit("")).rlike(rx.DIMENSION_X) | own.rlike(rx.DIMENSION_LABELLED))


def classify_token(c: Column) -> Column:
    cleaned = strip_currency(c)
    return (
        F.when(is_dimension_candidate(c), "DIM_CANDIDATE")
        .when(c.rlike(rx.CURRENCY_WORD), "PRICE_CANDIDATE")
        .when(cleaned.rlike(rx.PRICE_TOKEN) & parse_price(cleaned).isNotNull(), "PRICE_CANDIDATE")
        .when(is_valid_code(c), "ARTNO_CANDIDATE")
        .otherwise("TEXT")
    )


def count_words(c: Column, words: tuple[str, ...]) -> Column:
    """How many of the words a text holds, as parts of words too."""
    return let(F.lower(c), lambda lowered: sum((lowered.contains(w).cast("int") for w in words), F.lit(0)))


def count_patterns(c: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns a text holds. Bound to a variable, as so many matches in one generated method are too much for it."""
    return let(c, lambda x: sum((x.rlike(p).cast("int") for p in patterns), F.lit(0)))


def is_legal(c: Column) -> Column:
    return let(count_patterns(c, rx.LEGAL), lambda hits: (hits >= 2) | ((hits >= 1) & (F.length(c) > 220) & (F.regexp_count(c, F.lit("[;:§]")) >= 2)))


def is_header(c: Column) -> Column:
    return let(count_words(c, rx.HEADER_WORDS), lambda hits: (hits >= 2) | ((hits >= 1) & (F.length(c) <= 60)))


def numeric_density(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, "[^0-9²³¹]", "")) / F.length(c)).otherwise(0.0)


def toc_pairs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(rx.TOC_PAIR), F.lit(1))


def code_pattern(c: Column) -> Column:
    return F.when(c.rlike(r"^\d+$"), "digits_only").when(c.rlike(r"[-./]"), "alnum_with_separators").otherwise("mixed")


def extract_dimension(size: Column, key: str) -> Column:
    return F.replace(F.regexp_extract(size, rf"(?i)\b{key}\b\s*([0-9]+(?:[.,][0-9]+)?)\s*cm", 1), F.lit(","), F.lit(".")).try_cast("double")


def raw_block_id(page: Column, block: Column) -> Column:
    return F.sha1(F.concat(page.cast("string"), F.lit(":"), block).cast("binary"))
