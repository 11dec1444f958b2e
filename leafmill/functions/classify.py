"""Classification rules over zone text: authority letters, tax forms, banks, years.

Pattern families are unrolled into one expression per page; a rule table is
never joined to the pages.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from leafmill.functions.common import first_match, let

# Words that mark a letter of the tax authority.
ISSUER_KEYWORDS = [
    "canada revenue agency",
    "agence du revenu du canada",
    "revenue canada",
    "revenu canada",
    "cra-arc",
]

# Authority document types and their patterns, in order.
AUTHORITY_TYPES = {
    "notice_of_assessment": [
        r"notice\s+of\s+assessment", r"avis\s+de\s+cotisation", r"noa\b", r"\bT1\s+General",
    ],
    "family_allowance": [
        r"canada\s+child\s+benefit", r"allocation\s+canadienne\s+pour\s+enfants", r"\bRC151\b", r"CCB",
    ],
    "gst_hst_credit": [
        r"GST/HST\s+credit", r"cr[ée]dit\s+(?:pour\s+la\s+)?TPS/TVH", r"\bRC151\b",
    ],
    "statement_of_account": [
        r"statement\s+of\s+account", r"[ée]tat\s+de\s+compte", r"balance\s+owing",
        r"solde\s+(?:[àa]\s+payer|d[ûu])",
    ],
    "tax_return": [
        r"income\s+tax\s+(?:and\s+benefit\s+)?return", r"d[ée]claration\s+de\s+revenus?", r"T1\s+General",
    ],
    "proof_of_income": [
        r"option\s+C\s+print", r"proof\s+of\s+income", r"revenue\s+statement",
    ],
}
UNKNOWN_AUTHORITY_TYPE = "unknown_cra_document"

# Authority form numbers, in order.
FORM_NUMBERS = [r"\b(T1)\b", r"\b(T4[A-Z]?)\b", r"\b(T5[A-Z]?)\b", r"\b(RC\d{3})\b", r"\b(T2202A?)\b", r"\b(RRSP)\b"]

# Tax forms as code, patterns (2 points), keywords (1 point), issuer; in order.
TAX_FORMS = [
    ("T4", [r"\bT4\b", r"Statement of Remuneration Paid"],
     ["employment income", "income tax deducted", "cpp", "ei"], "employer"),
    ("T4A", [r"\bT4A\b", r"Statement of Pension"],
     ["pension", "other income", "annuities"], "various"),
    ("T4E", [r"\bT4E\b", r"Statement of Employment Insurance"],
     ["employment insurance", "benefits paid", "ei"], "service_canada"),
    ("T5", [r"\bT5\b", r"Statement of Investment Income"],
     ["interest", "dividends", "investment income"], "financial_institution"),
    ("T5007", [r"\bT5007\b", r"Statement of Benefits"],
     ["social assistance", "benefits", "workers' compensation"], "government"),
    ("T1", [r"\bT1\s+General\b", r"Income Tax and Benefit Return"],
     ["tax return", "total income", "taxable income", "federal tax"], "taxpayer"),
    ("T2202", [r"\bT2202A?\b", r"Tuition and Enrolment Certificate"],
     ["tuition", "education", "eligible fees"], "educational_institution"),
    ("T3", [r"\bT3\b", r"Statement of Trust Income"],
     ["trust", "allocations", "capital gains"], "trust"),
    ("RL-1", [r"\bRL-?1\b", r"Relev[ée]\s+1"],
     ["revenu", "emploi", "quebec"], "employer_quebec"),
    ("RL-2", [r"\bRL-?2\b", r"Relev[ée]\s+2"],
     ["revenus de placements", "int[ée]r[êe]ts", "quebec"], "financial_institution_quebec"),
]

# Banks and the upper-cased names that mark them, in order.
BANKS = {
    "TD_CANADA_TRUST": ["TD CANADA TRUST", "TD BANK", "THE TORONTO-DOMINION BANK"],
    "RBC": ["ROYAL BANK", "RBC", "BANQUE ROYALE"],
    "SCOTIABANK": ["SCOTIABANK", "BANQUE SCOTIA", "THE BANK OF NOVA SCOTIA"],
    "BMO": ["BANK OF MONTREAL", "BMO", "BANQUE DE MONTREAL"],
    "CIBC": ["CIBC", "CANADIAN IMPERIAL"],
    "NATIONAL_BANK": ["NATIONAL BANK", "BANQUE NATIONALE"],
    "DESJARDINS": ["DESJARDINS", "CAISSE"],
}

# Fiscal-year patterns with context and confidence, in order.
YEAR_PATTERNS = [
    (r"(?:tax\s+year|ann[ée]e\s+d.imposition|fiscal\s+year|taxation\s+year)\s*:?\s*(\d{4})", "tax_year_label", 0.95),
    (r"(?:for\s+the\s+year|pour\s+l.ann[ée]e)\s+(\d{4})", "for_the_year", 0.90),
    (r"(\d{4})\s+(?:tax\s+return|income\s+tax|d[ée]claration|notice|avis)", "year_before_label", 0.85),
    (r"(?:january|janvier)\s+\d+,?\s+(\d{4})\s+(?:to|[àa])\s+(?:december|d[ée]cembre)\s+\d+,?\s+\d{4}",
     "date_range", 0.92),
    (r"as\s+of\s+(?:december|d[ée]cembre)\s+\d+,?\s+(\d{4})", "as_of_date", 0.88),
    (r"\b(202[0-9]|203[0])\b", "standalone_year", 0.60),
]
STANDALONE_YEAR = YEAR_PATTERNS[-1][0]
ZONE_BOOST = {"header": 0.05, "top_right": 0.03}

_ANY_CASE = "(?iU)"


def required_text(pattern: str) -> str:
    """The longest literal that any match of ``pattern`` must hold, lower-cased.
    Groups, classes, escapes and optional characters are left out."""
    left = pattern.lower()
    for optional in (r"\([^()]*\)[?*+]?", r"\[[^\]]*\][?*+]?", r"\\[a-z](\{\d+\})?[?*+]?", r".[?*]", r"[.^$|+]"):
        left = re.sub(optional, "\0", left)
    return max(left.split("\0"), key=len)


def _found(low: Column, pattern: str) -> Column:
    """Match over text that is lower-cased already. A substring test comes first:
    it rules out nearly every page at a fraction of the cost of a regex."""
    needed = required_text(pattern)
    if needed == pattern.lower():
        return low.contains(needed)
    match = F.regexp_like(low, F.lit("(?U)" + pattern.lower()))
    return low.contains(needed) & match if needed else match


def _best(scores: list[tuple[str, Column]]) -> Column:
    """Struct(score, name) of the highest score; the first declared wins ties."""
    rows = [F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name"))
            for i, (name, score) in enumerate(scores)]
    return let(F.array_max(F.array(*rows)), lambda top: F.when(top["score"] > 0, top))


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def issuer_flag(header: Column) -> Column:
    """Struct(matches, is_issuer, confidence) from lower-cased header text."""
    hits = _sum([header.contains(word).cast("int") for word in ISSUER_KEYWORDS])
    return let(hits, lambda n: F.struct(n.alias("matches"), (n > 0).alias("is_issuer"),
                                        F.least(n / 2, F.lit(0.95)).alias("confidence")))


def authority_type(text: Column) -> Column:
    """Struct(score, name) of the best type of lower-cased text, NULL when nothing matches."""
    return _best([(name, _sum([_found(text, p).cast("int") for p in patterns]))
                  for name, patterns in AUTHORITY_TYPES.items()])


def authority_patterns(text: Column, name: Column) -> Column:
    """The patterns of the chosen type that matched."""
    arms = []
    for kind, patterns in AUTHORITY_TYPES.items():
        hits = F.array_compact(F.array(*[F.when(_found(text, p), F.lit(p)) for p in patterns]))
        arms.append((name == kind, hits))
    return first_match(arms, F.array().cast("array<string>"))


def form_number(corner: Column) -> Column:
    found = [F.nullif(F.regexp_extract(corner, _ANY_CASE + p, 1), F.lit("")) for p in FORM_NUMBERS]
    return F.upper(F.coalesce(*found))


def tax_form_code(corner: Column) -> Column:
    """First form code in upper-cased corner text, with or without its hyphen."""
    return first_match([
        (F.regexp_like(corner, F.lit(r"(?U)\b" + code.replace("-", "-?") + r"\b")), F.lit(code))
        for code, *_ in TAX_FORMS])


def _keyword(low: Column, word: str, word_boundary: bool) -> Column:
    return _found(low, rf"\b{word}\b") if word_boundary else low.contains(word)


def tax_form_by_content(low: Column, word_boundary: bool = False) -> Column:
    """Struct(score, name) from lower-cased text. Keywords are bare substrings;
    ``word_boundary`` keeps short ones such as ``ei`` from matching inside words."""
    return _best([(code, _sum([_found(low, p).cast("int") * 2 for p in patterns]
                              + [_keyword(low, w, word_boundary).cast("int") for w in words]))
                  for code, patterns, words, _ in TAX_FORMS])


def tax_form_matches(low: Column, form: Column, word_boundary: bool = False) -> Column:
    """Patterns and keywords of ``form`` that the text has, joined by ``; ``."""
    return first_match([
        (form == code, F.concat_ws("; ", *[F.when(_found(low, p), p) for p in patterns],
                                   *[F.when(_keyword(low, w, word_boundary), w) for w in words]))
        for code, patterns, words, _ in TAX_FORMS])


def tax_form_issuer(code: Column) -> Column:
    return first_match([(code == name, F.lit(issuer)) for name, _, _, issuer in TAX_FORMS], F.lit("unknown"))


def tax_year(corner: Column, strip: Column) -> Column:
    found = [F.nullif(F.regexp_extract(z, "(?U)" + STANDALONE_YEAR, 1), F.lit("")) for z in (corner, strip)]
    return F.coalesce(*found).try_cast("int")


def bank(text: Column) -> Column:
    """First bank named in upper-cased text."""
    return first_match([
        (reduce(lambda a, b: a | b, [text.contains(name) for name in names]), F.lit(code))
        for code, names in BANKS.items()])


def year_findings(low: Column, zone: str, zone_order: int) -> Column:
    """Array of struct(seq, zone, context, year, confidence) for one zone's
    lower-cased text.
    ``seq`` follows zone, pattern and position, and settles later ties."""
    def hits(number: int, pattern: str, context: str, confidence: float) -> Column:
        years = F.regexp_extract_all(low, F.lit("(?U)" + pattern.lower()), F.lit(1))
        score = min(confidence + ZONE_BOOST[zone], 0.98) if zone in ZONE_BOOST else confidence
        base = zone_order * 10_000_000 + number * 1_000_000
        return F.transform(years, lambda year, at: F.struct(
            (at + base).alias("seq"), F.lit(zone).alias("zone"), F.lit(context).alias("context"),
            year.cast("int").alias("year"), F.lit(score).alias("confidence")))

    found = F.concat(*[hits(number, *rule) for number, rule in enumerate(YEAR_PATTERNS)])
    return F.when(F.regexp_like(low, F.lit("[0-9]{4}")), found).otherwise(F.slice(found, 1, 0))
