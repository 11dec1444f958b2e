"""Cleaning of addresses and person names, and keys for matching them."""

from __future__ import annotations


from pyspark.sql import Column, functions as F

from leafmill.functions.common import col
from leafmill.functions.text import collapse_spaces

# Accented letters and the letters that replace them.
ACCENTED = "ÀÂÄÉÈÊËÎÏÔÖÙÛÜÇàâäéèêëîïôöùûüç"
PLAIN = "AAAEEEEIIOOUUUCaaaeeeeiioouuuc"

# Street words and their short forms.
STREET_WORDS = {
    "AVENUE": "AVE",
    "BOULEVARD": "BLVD",
    "CHEMIN": "CH",
    "CIRCLE": "CIR",
    "COURT": "CRT",
    "CRESCENT": "CRES",
    "DRIVE": "DR",
    "LANE": "LANE",
    "PLACE": "PL",
    "ROAD": "RD",
    "ROUTE": "RTE",
    "STREET": "ST",
    "TERRACE": "TERR",
    "WAY": "WAY",
    "RUE": "RUE",
    "RANG": "RG",
    "MONTEE": "MTEE",
}

# Directions in English and French and their short forms.
DIRECTIONS = {
    "NORTH": "N",
    "SOUTH": "S",
    "EAST": "E",
    "WEST": "W",
    "NORD": "N",
    "SUD": "S",
    "EST": "E",
    "OUEST": "O",
}

_WORD_OR_GAP = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"

MATCH_PERCENT, LIKELY_PERCENT = 80, 60


def strip_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def map_words(text: Column, table: dict[str, str]) -> Column:
    """Replace whole words by a table in one pass over the text."""
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    tokens = F.regexp_extract_all(text, F.lit(_WORD_OR_GAP), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(lookup, t), t)), "")


def normalize_address(raw: str | Column) -> Column:
    text = strip_accents(F.upper(collapse_spaces(col(raw))))
    text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s#-]", " ")
    return collapse_spaces(map_words(text, {**STREET_WORDS, **DIRECTIONS}))


def address_match_key(raw: str | Column) -> Column:
    """A cleaner of its own for comparison: no short forms, ``-`` goes, ``#`` stays."""
    text = F.translate(F.upper(col(raw)), "ÉÈÊË", "EEEE")
    return collapse_spaces(F.regexp_replace(text, r"[^\p{L}\p{N}_\s#]", " "))


def normalize_name(raw: str | Column, remove_accents: bool = True) -> Column:
    """Title-cased name. Every run of letters is capitalised, so ``O'Brien`` and
    ``Jean-François`` come out right; ``Mc`` capitalises the next letter too."""
    text = F.regexp_replace(collapse_spaces(col(raw)), r"[^\p{L}\p{N}_\s'-]", "")
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    titled = F.array_join(F.transform(runs, F.initcap), "")
    words = F.regexp_extract_all(titled, F.lit(_WORD_OR_GAP), F.lit(0))

    def raise_third(word: Column) -> Column:
        mc = F.concat(F.lit("Mc"), F.upper(F.substring(word, 3, 1)), F.substr(word, F.lit(4)))
        return F.when(F.regexp_like(word, F.lit("^Mc[a-z]")), mc).otherwise(word)

    name = F.array_join(F.transform(words, raise_third), "")
    return strip_accents(name) if remove_accents else name


def split_full_name(full: str | Column) -> Column:
    """Struct(first_name, last_name, parts_count, confidence, error)."""
    clean = collapse_spaces(col(full))
    parts = F.split(clean, " ")
    empty = F.length(clean) == 0
    count = F.when(empty, 0).otherwise(F.size(parts))
    first = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " ")
    return F.struct(
        F.when(~empty, first).alias("first_name"),
        F.when(~empty, F.element_at(parts, -1)).alias("last_name"),
        count.alias("parts_count"),
        F.when(empty, 0.0).otherwise(0.95).alias("confidence"),
        F.when(empty, "Empty name").alias("error"))


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)
