"""Label dictionaries: names that columns and fields go by, as patterns and as counts."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelore.functions import patterns as rx

# The labels that fields go by, where no dictionary is given.
DEFAULT = {
    "version": "1.0",
    "fields": {
        "art_no": [r"re:\bart\.?\s*no\.?\b", "art no", "art. no", "article no", "article number", "articolo", "articolo n", "articolo nr", "articolo no", "part no", "part number"],
        "rrp": ["rrp", "list price", "prezzo listino", "msrp", "srp"],
        "colli": ["colli", "collo", "packing", "pack", "package"],
        "designer": ["designer", "designed by", "design"],
        "code": ["code", "cod", "cod.", "codice", "codice prodotto", "codice articolo", "item no", "item nr", "item #", "reference", "ref", "ref.", "sku", "model"],
        "description": ["description", "descrizione", "descrizione prodotto", "descrizione articolo", "product name", "product description", "item description", "item name", "name", "denominazione", "nome prodotto"],
        "price": ["price", "unit price", "net price", "gross price", "prezzo", "prezzo netto", "prezzo lordo", "prezzo unitario", "list price", "price list", "recommended price", "retail price", "public price", "prix", "preis", "precio", "pvp", "uvp"],
        "currency": ["currency", "valuta", "eur", "dkk", "sek", "nok", "usd", "gbp", "chf", "jpy", "cad", "aud"],
        "size": ["size", "dimensions", "dimension", "dim.", "dimensioni", "dimensiones", "misure", "misura", "measurements"],
        "material": ["material", "materiale", "materia", "finish", "finitura"],
        "color": ["color", "colour", "colore", "farbe", "couleur"],
        "notes": ["notes", "note", "remarks", "osservazioni", "note tecniche"],
    },
    "stopwords": ["terms", "conditions", "indice", "index", "contents", "table of contents"],
}


def load(path: str | None, fallback: dict | None = None) -> dict:
    """The dictionary in a JSON file; the fallback where there is none, or none that can be read."""
    fallback = DEFAULT if fallback is None else fallback
    if not path or not os.path.exists(path):
        return fallback
    try:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
    except (OSError, ValueError):
        return fallback
    return got if isinstance(got, dict) else fallback


def merged(base: dict, profile: dict) -> dict:
    """A dictionary with a profile's labels after its own, each once; the profile's version and stopwords hold if it has any."""
    fields = {k: list(v) for k, v in (base.get("fields") or {}).items()}
    for field, names in (profile.get("fields") or {}).items():
        own = fields.setdefault(field, [])
        own += [n for n in dict.fromkeys(names or []) if n not in own]
    return {"version": profile.get("version") or base.get("version"), "fields": fields, "stopwords": profile.get("stopwords") or base.get("stopwords", [])}


def pattern(names: list) -> str | None:
    """One pattern for all names of a field: whole words, any white space between, "re:" names as they are. It means the same to Java's
    engine and to RE2."""
    parts = []
    for name in names or []:
        if not isinstance(name, str) or not name.strip():
            continue
        if name.startswith("re:"):
            parts.append(name[3:])
            continue
        own = r"\s+".join(re.escape(w) for w in re.split(r" ", name.strip()))
        parts.append((r"\b" if name.strip()[0].isalnum() else "") + own + (r"\b" if name.strip()[-1].isalnum() else ""))
    return "(?i)(?:" + "|".join(parts) + ")" if parts else None


def patterns(dictionary: dict) -> dict[str, str]:
    found = {field: pattern(names) for field, names in (dictionary.get("fields") or DEFAULT["fields"]).items()}
    return {field: p for field, p in found.items() if p}


def hits(text: Column, field: str, known: dict[str, str]) -> Column:
    """How often the labels of a field stand in a text."""
    return F.regexp_count(text, F.lit(known[field])) if field in known else F.lit(0)


def terms(dictionary: dict) -> list[str]:
    """All labels in lower case, without patterns."""
    own = {n.strip().lower() for names in (dictionary.get("fields") or {}).values() for n in names or [] if isinstance(n, str) and not n.startswith("re:")}
    return sorted(own - {""})


def language(word: Column) -> Column:
    """The first language that a word hints at."""
    first: dict[str, str] = {}
    for name, words in rx.LANGUAGE_HINTS.items():
        for w in words:
            first.setdefault(w, name)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in first.items() for x in pair]), word), F.lit("unknown"))


def field_of(word: Column) -> Column:
    """The field that a heading's word most likely names; empty if none. Word beginnings are fixed values."""
    low = F.lower(word)
    starts = lambda *heads: low.rlike("^(?:" + "|".join(heads) + ")")
    return (
        F.when(starts("art"), "art_no")
        .when(starts("rrp", "list"), "rrp")
        .when(starts("coll", "pack"), "colli")
        .when(starts("desig"), "designer")
        .when(starts("cod", "item"), "code")
        .when(starts("desc", "name", "prod"), "description")
        .when(starts("price", "prezz") | low.isin("eur", "dkk", "sek", "nok"), "price")
        .when(starts("size", "dim"), "size")
        .otherwise("")
    )


def counts_text(counts: Column) -> Column:
    """A map of counts as k=v;k=v, in order of its keys."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(counts)), lambda k: F.concat(k, F.lit("="), F.element_at(counts, k).cast("string"))), ";")


def safe_name(c: Column) -> Column:
    """A name that a file may have: runs of other characters become _, and none are at the ends."""
    own = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(own == "", "pdf").otherwise(own)


def profile_id(c: Column) -> Column:
    own = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("generated_"), F.lower(F.when(own == "", "profile").otherwise(own)))


def run_id(timestamp: Column, mode: Column, digest: Column) -> Column:
    return F.concat_ws("_", timestamp, mode, digest)
