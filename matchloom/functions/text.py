"""Column functions that normalise business names and addresses."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal-form variants and their canonical tokens.
LEGAL_FORMS = {
    "private": "pvt", "pvt": "pvt", "pte": "pvt", "limited": "ltd", "ltd": "ltd", "corporation": "corp", "corp": "corp",
    "incorporated": "inc", "inc": "inc", "company": "co", "co": "co", "cie": "co", "llc": "llc", "llp": "llp", "plc": "plc", "lp": "lp",
    "sarl": "sarl", "sas": "sas", "sasu": "sasu", "eurl": "eurl", "sa": "sa", "gmbh": "gmbh", "ag": "ag", "bv": "bv",
}
LEGAL_TOKENS = sorted(set(LEGAL_FORMS.values()))
# Name stop words.
NAME_STOPWORDS = ["the", "and", "of", "dba", "et", "le", "la", "les", "de", "du", "des"]
# Address words and their abbreviations.
ADDRESS_ABBREVIATIONS = {
    "road": "rd", "street": "st", "avenue": "ave", "av": "ave", "boulevard": "blvd", "bd": "blvd", "drive": "dr", "lane": "ln",
    "court": "ct", "place": "pl", "square": "sq", "highway": "hwy", "parkway": "pkwy", "suite": "ste", "floor": "fl", "building": "bldg",
    "apartment": "apt", "number": "no", "north": "n", "south": "s", "east": "e", "west": "w", "sector": "sec", "opposite": "opp",
    "nagar": "ngr", "saint": "st",
}


def _folds() -> tuple[str, str, dict[str, str]]:
    """(characters, their one-character folds then nothing for those that vanish, longer folds) of all of Unicode, as far as the result can tell."""
    single: dict[str, str] = {}
    longer: dict[str, str] = {}
    gone = []
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        flat = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if flat == c:
            continue
        if not flat:
            gone.append(c)
        elif any(x.isascii() for x in flat):  # the rest becomes a blank whatever it folds to
            (single if len(flat) == 1 else longer)[c] = flat
    return "".join([*single, *gone]), "".join(single.values()), longer


_FROM, _TO, _LONGER = _folds()


def _lookup(table: dict[str, str], token: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.element_at(entries, token), token)


def fold(text: Column) -> Column:
    """Accents stripped (compatibility decomposition without marks), lower case, '&' as 'and', apostrophes gone, other runs one blank."""
    text = F.coalesce(text, F.lit(""))
    flat = F.translate(text, _FROM, _TO)
    spelled = F.array_join(F.transform(F.split(flat, ""), lambda c: _lookup(_LONGER, c)), "")
    flat = F.when(flat.rlike("[" + "".join(_LONGER) + "]"), spelled).otherwise(flat)
    text = F.when(text.rlike(r"[^\x00-\x7F]"), flat).otherwise(text)
    for old, new in (("&", " and "), ("'", ""), ("’", "")):
        text = F.replace(text if old != "&" else F.lower(text), F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """The words of a folded text; none for the empty text."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def name_tokens(name: Column) -> Column:
    return F.transform(tokens(fold(name)), lambda t: _lookup(LEGAL_FORMS, t))


def normalize_name(name: Column) -> Column:
    return F.array_join(name_tokens(name), " ")


def core_of(norm: Column) -> Column:
    """A normalised name without legal forms and stop words; itself where nothing is left."""
    dropped = F.array(*[F.lit(t) for t in [*LEGAL_TOKENS, *NAME_STOPWORDS]])
    core = F.array_join(F.filter(tokens(norm), lambda t: ~F.array_contains(dropped, t)), " ")
    return F.when(core != "", core).otherwise(norm)


def name_core(name: Column) -> Column:
    return core_of(normalize_name(name))


def normalize_address(address: Column) -> Column:
    return F.array_join(F.transform(tokens(fold(address)), lambda t: _lookup(ADDRESS_ABBREVIATIONS, t)), " ")


def _codes(address: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(address, F.lit("")), F.lit(pattern), F.lit(0))))


def postcodes(address: Column) -> Column:
    """Distinct runs of 5 or 6 digits standing alone in the raw address, sorted."""
    return _codes(address, r"(?U)\b\d{5,6}\b")


def numbers(address: Column) -> Column:
    """Distinct digit runs of the raw address, sorted as text."""
    return _codes(address, r"(?U)\d+")
