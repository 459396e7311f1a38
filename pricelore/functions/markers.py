"""Column functions over blocks of the marker format: the fields of one product."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelore.functions import patterns as rx
from pricelore.functions import text as tx

#: What stands between two parts of a block that is split; no text holds it.
CUT = "\u0001"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def contains_art_no(c: Column) -> Column:
    return c.rlike(rx.ART_NO_MARK)


def is_marker_line(c: Column) -> Column:
    return c.rlike(rx.MARKER_LINE)


def is_price_line(c: Column) -> Column:
    return c.rlike(rx.MARKER_PRICE)


def is_title(c: Column) -> Column:
    """A line that may name a product: neither blank, nor a field, nor a price."""
    return c.rlike(r"\S") & ~is_marker_line(c) & ~is_price_line(c)


def is_block_valid(c: Column) -> Column:
    return c.contains("RRP") & (contains_art_no(c) | is_price_line(c))


def split_by_codes(block: Column) -> Column:
    """The parts of a block that begin at its code fields; what comes before the first belongs to it. Whole if there is one at most."""
    parts = F.transform(F.split(F.regexp_replace(block, rx.ART_NO_MARK.replace("(?i)", "((?i:") + "))", CUT + "$1"), CUT), trimmed)

    def joined(p: Column) -> Column:
        first = F.when(F.get(p, F.lit(0)) == "", F.get(p, F.lit(1))).otherwise(F.concat_ws("\n", F.get(p, F.lit(0)), F.get(p, F.lit(1))))
        return F.when(F.size(p) <= 2, F.array(block)).otherwise(F.concat(F.array(first), F.slice(p, 3, F.size(p))))

    return tx.let(parts, joined)


def validated_code(value: Column) -> Column:
    """The canonical code if it is plausible and well formed, else empty."""
    return tx.let(tx.canonical_code(trimmed(value)), lambda c: F.when(tx.is_plausible_code(c) & c.rlike(rx.ART_NO_FORM), c).otherwise(""))


def code_field_raw(block: Column) -> Column:
    """The code of the first line that has a code field; empty if it can't be read or has no digit."""
    lines = F.filter(F.split(block, "\n"), contains_art_no)
    return tx.let(F.coalesce(F.regexp_extract(F.get(lines, F.lit(0)), rx.ART_NO_VALUE, 1), F.lit("")), lambda v: F.when(v.rlike("[0-9]"), v).otherwise(""))


def colli(block: Column) -> Column:
    return F.regexp_extract(block, rx.COLLI_MARK + r"\s*(\d+)", 1).try_cast("int")


def labelled(block: Column, label: str) -> Column:
    """What follows a label at the start of a line, on that line or, where nothing does, on the next that isn't blank."""
    return trimmed(F.regexp_extract(block, rf"(?im)^{label}\s*:\s*(.*)$", 1))


def prices(block: Column) -> Column:
    """Currency and price of each priced code, in order; the price is null where it can't be one."""
    names, values = (F.regexp_extract_all(block, F.lit(rx.MARKER_PRICE), F.lit(i)) for i in (1, 2))
    return F.zip_with(names, values, lambda n, v: F.struct(n.alias("currency"), tx.parse_price(v).alias("price")))


def last_price(found: Column, currency: str) -> Column:
    own = F.filter(found, lambda p: (p["currency"] == currency) & p["price"].isNotNull())
    return F.try_element_at(own, F.lit(-1))["price"]


def title_lines(block: Column) -> Column:
    """The lines that name the product: those before the packing, and what stands before the price mark."""
    lines = F.filter(F.transform(F.split(block, "\n"), trimmed), lambda x: x != "")
    marked = F.transform(lines, lambda x: F.struct(x.alias("line"), x.rlike(rx.RRP_MARK).alias("rrp")))
    end = F.array_position(F.transform(marked, lambda m: ~m["rrp"] & m["line"].rlike(rx.COLLI_MARK)), F.lit(True)).cast("int")
    upto = tx.let(end, lambda e: F.when(e == 0, marked).otherwise(F.slice(marked, F.lit(1), F.greatest(e - 1, F.lit(0)))))
    kept = F.filter(upto, lambda m: m["rrp"] | ~(is_marker_line(m["line"]) | is_price_line(m["line"])))
    return F.filter(F.transform(kept, lambda m: F.when(m["rrp"], trimmed(F.regexp_extract(m["line"], r"^(.*?)" + rx.RRP_MARK.replace("(?i)", "(?i:") + ")", 1))).otherwise(m["line"])), lambda x: x != "")


def is_variant(tail: Column) -> Column:
    """Whether the end of a name is a material, a colour or a measure."""

    def own(c: Column) -> Column:
        words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
        known = c.isin(*rx.VARIANT_WORDS) | F.forall(words, lambda w: w.isin(*rx.VARIANT_WORDS))
        measure = c.rlike(r"[0-9]") & c.rlike(r"\b(?:cm|mm|l)\b") | c.rlike(r"\b[0-9]+(?:[.,][0-9]+)?\s*(?:l|cm|mm)\b") | c.rlike(r"\bo\s*[0-9]+(?:[.,][0-9]+)?\s*cm\b")
        return known | measure

    return (tail != "") & (F.length(tail) <= 25) & tx.let(F.replace(F.lower(tail), F.lit("-"), F.lit(" ")), own)


def name_and_variant(title: Column) -> Column:
    """A struct of the name without its variant, and the variant: after a separator, in brackets, or the last one or two words."""

    def read(name: Column) -> Column:
        base, tail = (trimmed(F.regexp_extract(name, r"^(.*?)(?:\s*[-,/]\s*)([^-/,]+)$", i)) for i in (1, 2))
        outside, inside = (trimmed(F.regexp_extract(name, r"^(.*)\(([^)]+)\)\s*$", i)) for i in (1, 2))
        plain = F.filter(F.split(F.replace(F.lower(name), F.lit("-"), F.lit(" ")), r"\s+"), lambda w: w != "")
        words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
        last = lambda n: F.concat_ws(" ", F.slice(plain, -n, n))
        cut = lambda n: (F.concat_ws(" ", F.slice(words, F.lit(1), F.greatest(F.size(words) - n, F.lit(0)))), F.concat_ws(" ", F.when(F.size(words) >= n, F.slice(words, -n, n)).otherwise(words)))
        pair = lambda a, b: F.struct(a.alias("name"), b.alias("variant"))
        return (
            F.when(is_variant(tail), pair(base, tail))
            .when(is_variant(inside), pair(outside, inside))
            .when((F.size(plain) >= 2) & F.when(F.size(plain) >= 2, last(2)).isin(*rx.VARIANT_WORDS), pair(*cut(2)))
            .when((F.size(plain) >= 1) & F.when(F.size(plain) >= 1, last(1)).isin(*rx.VARIANT_WORDS), pair(*cut(1)))
            .otherwise(pair(name, F.lit("")))
        )

    return tx.let(trimmed(title), read)


def sizes(size: Column) -> Column:
    """A struct of width, height and length in cm: by their letters, by a product of labelled numbers, or a diameter as the width."""
    number = r"([0-9.,]+)"
    w, h = tx.extract_dimension(size, "W"), tx.extract_dimension(size, "H")
    length = F.coalesce(tx.extract_dimension(size, "L"), tx.extract_dimension(size, "D"))

    def product(order: str) -> dict[str, Column]:
        a, b, c = order
        pattern = rf"(?i){a}\s*{number}\s*(?:cm)?\s*x\s*{b}\s*{number}\s*(?:cm)?\s*x\s*{c}\s*{number}\s*cm"
        return {"?": size.rlike(pattern)} | {k: tx.parse_number(F.regexp_extract(size, pattern, i)) for i, k in enumerate(order, 1)}

    one, two = product("WHL"), product("LWH")
    row = lambda a, b, c: F.struct(a.alias("width_cm"), b.alias("height_cm"), c.alias("length_cm"))
    none = F.lit(None).cast("double")
    any_of = (F.coalesce(w, F.lit(0.0)) != 0) | (F.coalesce(h, F.lit(0.0)) != 0) | (F.coalesce(length, F.lit(0.0)) != 0)
    return (
        F.when(any_of, row(w, h, length))
        .when(one["?"], row(one["W"], one["H"], one["L"]))
        .when(two["?"], row(two["W"], two["H"], two["L"]))
        .when(size.rlike(rf"O\s*{number}\s*cm"), row(tx.parse_number(F.regexp_extract(size, rf"O\s*{number}\s*cm", 1)), none, none))
        .otherwise(row(none, none, none))
    )


def is_degraded(block: Column, art_no: Column) -> Column:
    """A code of digits alone where the text shows two groups with a hyphen."""
    return art_no.rlike(r"^\d{4,}$") & block.rlike(rx.DEGRADED_ART_NO)
