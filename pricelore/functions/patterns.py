"""Patterns and word lists of the catalogue language. All patterns mean the same to Java's engine and to RE2."""

# The semantics of price lists depend on exactly these.
CURRENCIES = ("EUR", "DKK", "SEK", "NOK", "USD", "GBP", "CHF", "JPY", "CAD", "AUD")
ROW_CURRENCIES = ("DKK", "SEK", "NOK", "EUR")
CURRENCY = r"(?i)(?:€|\b(?:EUR|DKK|SEK|NOK|USD|GBP|CHF|JPY|CAD|AUD)\b)"
CURRENCY_EDGE = r"(?i)^(?:EUR|DKK|SEK|NOK|USD|GBP|CHF|JPY|CAD|AUD)+|(?:EUR|DKK|SEK|NOK|USD|GBP|CHF|JPY|CAD|AUD)+$"
CURRENCY_WORD = r"(?i)^(?:€|EUR|DKK|SEK|NOK|USD|GBP|CHF|JPY|CAD|AUD)$"
CURRENCY_INSIDE = r"(?i)€|EUR|DKK|SEK|NOK|USD|GBP|CHF|JPY|CAD|AUD"
CURRENCY_PRICE = r"(?i)\b(DKK|SEK|NOK|EUR)\s*([0-9][0-9.,]*)"
DIMENSION_IN_LINE = r"\b\d{2,5}\s*[xX]\s*\d{2,5}\b"
UNIT = r"(?i)\b(?:cm|mm|mq|sqm|m2|m3|kg|dia|diam)\b|\bh\.\b|\bm[²³](?:$|[^0-9A-Za-z_²³¹])"
MEASURE = r"(?i)\b(?:cm|mm|mq|sqm|m2|m3|kg|volume|seat\s*h|fabric\s*meters?)\b"
NUMBER = r"\b\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?\b|\b\d{1,7}(?:[.,]\d{1,2})?\b"
THOUSANDS = r"^\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{2})?$"
DECIMAL_2 = r"[.,]\d{2}$"
PRICE_TOKEN = r"^(?:\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?|\d{1,7}(?:[.,]\d{1,2})?)$"
STRIP_CHARS = " ,;:()[]{}<>|"
YEAR_MIN, YEAR_MAX = 2000, 2026
TOC_PAIR = r"(?i)\b(\d{1,3})\s+(20[01]\d|202[0-6])\s+(?:EUR|€)\b"
YEAR_EUR = r"(?i)\b(?:EUR|€)\s*(?:20[01]\d|202[0-6])\b|\b(?:20[01]\d|202[0-6])\s*(?:EUR|€)\b"
SHORT_NUMBER = r"\b\d{1,3}\b"
CODE_LABEL = r"(?i)\b(?:code|cod|codice|art\.?\s*no|item|ref|nr)\b"
SPEC = r"(?i)\b(?:led\s*/\s*m|dimmable|strip|bulb)\b"
COLOUR_TEMPERATURE = r"(?i)^\d{3,4}K\.?$"
WATT = r"(?i)^\d{1,3}\s*W$"
SOCKET = r"(?i)^E\d{2}(?:/E\d{2})?$"
T_SERIES = r"(?i)^T\d{2}(?:/T\d{2})+$"
SINGLE_LETTER = r"^[A-Za-z]$"
SHORT_GRADE = r"^[A-Za-z]\d{1,2}$"
NUMBER_WITH_UNIT = r"(?i)^\d+(?:[.,]\d+)?(?:cm|mm|m|m2|m3|sqm|mq|kg|m²|m³)$"
DIMENSION_TOKEN = r"^\d{2,5}\s*[xX]\s*\d{2,5}$"
DATE_TOKEN = r"^\d{1,2}/\d{4}$"
DIMENSION_X = r"(?i)^\d+(?:[.,]\d+)?(?:x\d+(?:[.,]\d+)?){1,2}(?:cm|mm|m)?$"
DIMENSION_LABELLED = r"(?i)^[HWDLOP]\s*\d+(?:[.,]\d+)?(?:\s*(?:cm|mm|m))?$"
DIMENSION_LABEL = r"(?i)^[HWDLOP]$"
UNIT_TOKEN = r"(?i)^(?:cm|mm|m|mq|sqm|m2)$"
UNIT_CONTEXT = r"(?i)^(?:cm|mm|m|m2|m3|sqm|mq|kg|volume|seat|fabric|meters?|[LPHWDOØ])$"
AXIS_TOKEN = r"(?i)^[LPHWDOØ]$"
CODE_TOKEN = r"[A-Za-z0-9][A-Za-z0-9\-./]*"
DIMENSION_WORD = r"(?i)\b(?:prof|larg|alt|profondit[aà]|larghezza|altezza|diametro|dia|diam|depth|width|height|h|w|d|l|o)\b"
#: Legal markers; each counts once for a text. The one for articles of a law is written without lookahead.
LEGAL = (
    r"(?i)\bcgv\b",
    r"(?i)\bterms\b",
    r"(?i)\bconditions\b",
    r"(?i)\bterms and conditions\b",
    r"(?i)\bcondizioni generali\b",
    r"(?i)\bdecreto legislativo\b",
    r"(?i)\bdirettiva\b",
    r"(?i)\bcodice civile\b",
    r"(?i)\bwarranty\b",
    r"(?i)\bgaranzia\b",
    r"(?i)\bliability\b",
    r"(?i)responsabilita\b",
    r"(?i)responsabilità",
    r"(?i)\bjurisdiction\b",
    r"(?i)\bgoverning law\b",
    r"(?i)\barticolo\b",
    r"(?i)\bart\.\s*(?:$|[^\sn]|n(?:$|[^o]))",
    r"(?i)\b(?:ec|ue)\b",
    r"§",
)
#: Words that mark a heading row; parts of words count.
HEADER_WORDS = ("listino", "legenda", "index", "indice", "cod.", "codice", "code", "descrizione", "description", "price", "prezzo", "rrp", "art. no", "art no", "designer", "colli", "size", "dimensioni", "dimensions")
LEGEND_WORDS = ("code", "description", "finish", "price", "prezzo", "notes", "note", "eur", "w", "d", "h", "volume")
PAGE_LEGAL_WORDS = ("terms", "conditions", "cgv", "condizioni generali", "decreto", "direttiva", "codice civile", "governing law", "jurisdiction")
STOPWORDS = ("terms", "conditions", "indice", "index", "contents", "table of contents")
NOT_SECTION_WORDS = ("colli", "size", "designer", "art. no", "rrp", "pricelist", "catalog")


#: A character three times in a row; only for engines with back-references.
TRIPLE = r"([0-9A-Za-z.\-/])\1\1"


def triple() -> str:
    """A character three times in a row, without a back-reference."""
    import string

    return "|".join(f"{c}{c}{c}" for c in string.digits + string.ascii_letters) + r"|---|\.\.\.|///"


# The marker format.
RRP_MARK = r"(?i)\*\*\s*RRP"
ART_NO_MARK = r"(?i)Art\.?\s*no\.?\s*:"
ART_NO_VALUE = r"(?i)Art\.?\s*no\.?\s*:\s*([A-Z0-9]+(?:-[A-Z0-9]+)*)"
ART_NO_FORM = r"^[A-Za-z0-9][A-Za-z0-9\-./]*$"
MARKER_PRICE = r"\b(DKK|SEK|NOK|EUR)\s+([0-9]+(?:[.,][0-9]{1,2})?)"
MARKER_LINE = r"(?i)Colli\s*:|Size\s*:|Designer\s*:|Art\.?\s*no\.?\s*:|\bRRP\b"
COLLI_MARK = r"(?i)Colli\s*:"
LARGE_NUMBER = r"\b\d{6,}\b"
DEGRADED_ART_NO = r"(?i)Art\.?\s*no\.?\s*:\s*\d+\s*[-­]\s*\d+"
#: Materials and colours that name a variant.
VARIANT_WORDS = ("steel", "stainless", "light grey", "dark grey", "grey", "black", "white", "clear", "transparent", "smoked", "oak", "beech", "ash", "brass", "chrome", "polished", "matte", "satin", "glass", "porcelain", "aluminum", "aluminium", "plastic", "silicone", "rubber", "felt", "leather", "walnut", "natural")

# Tables and positioned words.
COLUMN_GAP = r"\s{2,}|\t"
COLUMN_PRICE = r"([0-9]{1,3}(?:[.,][0-9]{3})+(?:[.,][0-9]{2})?|[0-9]{1,7}(?:[.,][0-9]{1,2})?)"
STITCH_UNITS = ("cm", "mm", "m", "m2", "m3", "sqm", "mq", "kg", "volume")

# Words that hint at a language, the first language first, and words that are never labels.
LANGUAGE_HINTS = {
    "it": ("prezzo", "codice", "descrizione", "dimensioni", "misure", "colore", "pezzi", "confezione", "quantita", "altezza", "larghezza", "profondita"),
    "en": ("price", "code", "description", "dimensions", "size", "width", "height", "depth", "color", "qty", "pack", "pieces", "collection"),
    "fr": ("prix", "code", "description", "dimensions", "taille"),
    "de": ("preis", "artikel", "beschreibung", "masse", "groesse", "breite", "hoehe", "tiefe"),
}
