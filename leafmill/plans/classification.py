"""Queries that classify pages by the text in their zones."""

from pyspark.sql import functions as F

from leafmill.functions import classify as rules, zones
from leafmill.operators import classification as ops, zoning
from leafmill.registry import Inputs, query

_WORDS = """
    ln AS (SELECT doc_id, page_num, unnest(string_split(text, chr(10))) AS line,
                  unnest(range(0, len(string_split(text, chr(10))))) AS li, len(string_split(text, chr(10))) AS nl
           FROM triage_pages),
    wd AS (SELECT doc_id, page_num, li, unnest(string_split(line, ' ')) AS w,
                  unnest(range(0, len(string_split(line, ' ')))) AS wi,
                  len(string_split(line, ' ')) AS nw, li / nl::DOUBLE AS y FROM ln),
    words AS (SELECT *, wi / nw::DOUBLE AS x FROM wd)"""


def _zone(name: str, box: tuple[float, float, float, float]) -> str:
    left, top, right, bottom = (f"{v!r}::DOUBLE" for v in box)
    return (f"coalesce(string_agg(w, ' ' ORDER BY li, wi) FILTER (w <> '' AND x >= {left} AND x < {right} "
            f"AND y >= {top} AND y < {bottom}), '') AS {name}")


def _zones(boxes: dict) -> str:
    return ("WITH " + _WORDS + ", z AS (SELECT doc_id, page_num, "
            + ", ".join(_zone(n, b) for n, b in boxes.items()) + " FROM words GROUP BY doc_id, page_num)")


def _hit(text: str, pattern: str) -> str:
    escaped = pattern.replace("'", "''")
    return f"regexp_matches({text}, '(?i){escaped}')::INT"


@query("words_in_zones", ["J6"], _zones(zones.AUTHORITY_ZONES) + " " + " UNION ALL ".join(
    f"SELECT doc_id, page_num, '{n}' AS zone, {n} AS text FROM z" for n in zones.AUTHORITY_ZONES))
def words_in_zones(q: Inputs):
    pages = q.view("triage_pages").select("doc_id", "page_num", zones.page_words("text").alias("words"))
    return ops.words_in_zones(pages, zones.AUTHORITY_ZONES)


_LAYOUT_ZONES = """
    j AS (SELECT document_type, zones, unnest(json_keys(zones)) AS zone FROM zone_templates WHERE json_valid(zones)),
    c AS (SELECT document_type, zone, json_extract(zones, '$.' || zone) AS b FROM j),
    e AS (SELECT document_type, zone, (b->>'x')::DOUBLE AS l, (b->>'y')::DOUBLE AS t, (b->>'width')::DOUBLE AS w, (b->>'height')::DOUBLE AS h FROM c),
    boxes AS (SELECT document_type, zone, l AS "left", t AS top, l + w AS "right", t + h AS bottom FROM e WHERE l < l + w AND t < t + h)"""


@query("template_zones", ["J6", "F1"], "WITH " + _LAYOUT_ZONES + " SELECT * FROM boxes")
def template_zones(q: Inputs):
    return zoning.template_zones(q.view("zone_templates"))


@query("template_zone_words", ["J6"], "WITH " + _WORDS + "," + _LAYOUT_ZONES + """,
    p AS (SELECT DISTINCT doc_id, page_num, concat('layout_', cast(floor(doc_id / 4.0e0) AS BIGINT)) AS document_type FROM triage_pages),
    k AS (SELECT DISTINCT w.doc_id, w.page_num, zone, li, wi, w FROM words w JOIN p USING (doc_id, page_num) JOIN boxes z
          ON p.document_type = z.document_type AND w <> '' AND x >= "left" AND x < "right" AND y >= top AND y < bottom),
    f AS (SELECT DISTINCT doc_id, page_num, zone FROM p JOIN boxes USING (document_type))
    SELECT doc_id, page_num, zone, coalesce(string_agg(w, ' ' ORDER BY li, wi), '') AS text, count(w)::INT AS words
    FROM f LEFT JOIN k USING (doc_id, page_num, zone) GROUP BY doc_id, page_num, zone""")
def template_zone_words(q: Inputs):
    layout = F.concat(F.lit("layout_"), F.floor(F.col("doc_id") / 4.0).cast("string"))
    pages = q.view("triage_pages").select("doc_id", "page_num", layout.alias("document_type"), "text")
    return zoning.page_zone_text(pages, zoning.template_zones(q.view("zone_templates")), zones.page_words("text"))


_TYPE_SCORES = ", ".join(
    "(" + " + ".join(_hit("body", p) for p in patterns) + f") AS s{i}"
    for i, patterns in enumerate(rules.AUTHORITY_TYPES.values()))
_TYPE_LIST = ", ".join(f"s{i}" for i in range(len(rules.AUTHORITY_TYPES)))
_TYPE_NAMES = ", ".join(f"'{n}'" for n in rules.AUTHORITY_TYPES)
_KEYWORDS = " + ".join(f"contains(lower(header), '{k}')::INT" for k in rules.ISSUER_KEYWORDS)
_FORM = ", ".join(f"nullif(regexp_extract(corner, '(?i){p}', 1), '')" for p in rules.FORM_NUMBERS)
_AUTHORITY = _zones({**zones.AUTHORITY_ZONES, "corner": zones.CORNER_ZONE}) + f""",
    a AS (SELECT *, {_KEYWORDS} AS n, lower(concat_ws(' ', header, top_left, top_right, center)) AS body FROM z),
    b AS (SELECT *, {_TYPE_SCORES} FROM a WHERE n > 0),
    c AS (SELECT *, greatest({_TYPE_LIST}) AS top, list_position([{_TYPE_LIST}], greatest({_TYPE_LIST})) AS pos FROM b),
    hits AS (SELECT doc_id, page_num, CASE WHEN top > 0 THEN [{_TYPE_NAMES}][pos]
                         ELSE '{rules.UNKNOWN_AUTHORITY_TYPE}' END AS type,
                    upper(coalesce({_FORM})) AS form_number,
                    round(least(n / 2::DOUBLE, 0.95::DOUBLE) * 0.4::DOUBLE + CASE WHEN top > 0
                          THEN least(0.5::DOUBLE + top * 0.15::DOUBLE, 0.95::DOUBLE) ELSE 0 END * 0.6::DOUBLE, 2)
                        AS confidence, top AS pattern_count FROM c)"""


@query("issuer_flags", ["C1"], _zones({"header": zones.AUTHORITY_ZONES["header"]}) + f"""
    SELECT doc_id, page_num, {_KEYWORDS} AS matches, {_KEYWORDS} > 0 AS is_issuer,
           least(({_KEYWORDS}) / 2::DOUBLE, 0.95::DOUBLE) AS confidence FROM z""")
def issuer_flags(q: Inputs):
    heads = zones.with_zones(q.view("triage_pages"), {"header": zones.AUTHORITY_ZONES["header"]}, F.lower)
    return heads.select("doc_id", "page_num", rules.issuer_flag(F.col("header")).alias("r")).select(
        "doc_id", "page_num", "r.*")


@query("authority_documents", ["C2", "P4", "W6", "J6"], _AUTHORITY + " SELECT * FROM hits")
def authority_documents(q: Inputs):
    rows = ops.authority_documents(q.view("triage_pages"))
    return rows.withColumn("pattern_count", F.size("matched_patterns")).drop("matched_patterns")


@query("authority_type_counts", ["A18"], _AUTHORITY + """
    SELECT doc_id, type, count(*) AS pages, min(page_num) AS first_page FROM hits GROUP BY doc_id, type""")
def authority_type_counts(q: Inputs):
    return ops.type_counts(ops.authority_documents(q.view("triage_pages")), "type")


_SUMMARY = """
    SELECT t.doc_id, total_pages, coalesce(n, 0) AS hits, coalesce(c, {none}::DOUBLE) AS confidence
    FROM (SELECT doc_id, count(*) AS total_pages FROM triage_pages GROUP BY doc_id) t
    LEFT JOIN (SELECT doc_id, count(*) AS n, round(avg(confidence), 9) AS c FROM hits GROUP BY doc_id) h USING (doc_id)"""


@query("authority_summary", ["A18"], _AUTHORITY + _SUMMARY.format(none="0.85"))
def authority_summary(q: Inputs):
    pages = q.view("triage_pages")
    return ops.confidence_summary(pages, ops.authority_documents(pages), 0.85)


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _form_score(patterns: list[str], words: list[str]) -> str:
    terms = [_hit("low", p) + " * 2" for p in patterns]
    terms += ["contains(low, '{}')::INT".format(w.replace("'", "''")) for w in words]
    return "(" + " + ".join(terms) + ")"


_CODES = " ".join(f"WHEN regexp_matches(upper(corner), '\\b{c.replace('-', '-?')}\\b') THEN '{c}'"
                  for c, *_ in rules.TAX_FORMS)
_FORM_NAMES = ", ".join(f"'{c}'" for c, *_ in rules.TAX_FORMS)
_FORM_SCORES = ", ".join(_form_score(p, w) for _, p, w, _ in rules.TAX_FORMS)
_MATCHES = " ".join("WHEN '{}' THEN concat_ws('; ', {})".format(c, ", ".join(
    [f"CASE WHEN {_hit('low', x)} = 1 THEN '{_quoted(x)}' END" for x in p]
    + [f"CASE WHEN contains(low, '{_quoted(x)}') THEN '{_quoted(x)}' END" for x in w])) for c, p, w, _ in rules.TAX_FORMS)
_ISSUERS = " ".join(f"WHEN '{c}' THEN '{i}'" for c, _, _, i in rules.TAX_FORMS)
_FORMS = _zones({"corner": zones.CORNER_ZONE, "content": zones.CONTENT_ZONE, "strip": zones.YEAR_STRIP_ZONE}) + rf""",
    a AS (SELECT *, lower(content) AS low, CASE {_CODES} END AS code,
                 coalesce(nullif(regexp_extract(corner, '\b(202[0-9]|2030)\b', 1), ''),
                          nullif(regexp_extract(strip, '\b(202[0-9]|2030)\b', 1), '')) AS yr FROM z),
    b AS (SELECT *, [{_FORM_SCORES}] AS scores FROM a),
    c AS (SELECT *, list_max(scores) AS top, list_position(scores, list_max(scores)) AS pos FROM b),
    d AS (SELECT *, coalesce(code, CASE WHEN top > 0 THEN [{_FORM_NAMES}][pos] END) AS form_type,
                 CASE WHEN code IS NOT NULL THEN 0.9::DOUBLE
                      ELSE least(0.3::DOUBLE + top * 0.15::DOUBLE, 0.92::DOUBLE) END AS base FROM c),
    hits AS (SELECT doc_id, page_num, form_type, coalesce(yr::INT, 0) AS year,
                    round(CASE WHEN yr IS NOT NULL THEN least(base + 0.05::DOUBLE, 0.95::DOUBLE) ELSE base END, 2)
                        AS confidence, CASE form_type {_ISSUERS} ELSE 'unknown' END AS issuer,
                    coalesce(code, CASE form_type {_MATCHES} END) AS matched
             FROM d WHERE form_type IS NOT NULL)"""


@query("tax_forms", ["C3", "P5", "W6", "J11"], _FORMS + " SELECT * FROM hits")
def tax_forms(q: Inputs):
    return ops.tax_forms(q.view("triage_pages")).fillna(0, ["year"])


@query("tax_form_pages", ["A19"], _FORMS + """
    SELECT doc_id, form_type, count(*) AS pages, min(page_num) AS first_page FROM hits GROUP BY doc_id, form_type""")
def tax_form_pages(q: Inputs):
    return ops.type_counts(ops.tax_forms(q.view("triage_pages")), "form_type")


@query("tax_form_summary", ["A19"], _FORMS + _SUMMARY.format(none="0.80"))
def tax_form_summary(q: Inputs):
    pages = q.view("triage_pages")
    return ops.confidence_summary(pages, ops.tax_forms(pages), 0.80)


@query("tax_form_totals", ["C3", "J11"], _FORMS + """
    SELECT form_type, issuer, count(*) AS pages, count(*) FILTER (year > 0) AS with_year,
           round(avg(confidence), 9) AS mean_confidence FROM hits GROUP BY form_type, issuer""")
def tax_form_totals(q: Inputs):
    return ops.form_totals(ops.tax_forms(q.view("triage_pages")))


_BANK_ARMS = " ".join("WHEN " + " OR ".join(f"contains(head, '{n}')" for n in names) + f" THEN '{code}'"
                      for code, names in rules.BANKS.items())


@query("bank_statements", ["C4", "W5"], _zones({"raw_head": zones.BANK_ZONE}) + f""",
    h AS (SELECT doc_id, replace(upper(raw_head), 'ẞ', 'SS') AS head FROM z WHERE page_num = 1),
    b AS (SELECT doc_id, head, CASE {_BANK_ARMS} END AS bank FROM h)
    SELECT doc_id, bank, bank IS NOT NULL AS is_bank_statement,
           CASE WHEN bank IS NOT NULL THEN 0.9 ELSE 0 END::DOUBLE AS confidence, head[1:200] AS snippet FROM b""")
def bank_statements(q: Inputs):
    return ops.bank_statements(q.view("triage_pages"))


def _year_select() -> str:
    parts = []
    for order, zone in enumerate(zones.FISCAL_ZONES):
        for number, (pattern, context, confidence) in enumerate(rules.YEAR_PATTERNS):
            score = min(confidence + rules.ZONE_BOOST[zone], 0.98) if zone in rules.ZONE_BOOST else confidence
            mode = "" if context == "standalone_year" else "(?i)"
            found = f"regexp_extract_all({zone}, '{mode}{pattern}', 1)"
            parts.append(f"SELECT doc_id, page_num, '{zone}' AS zone, '{context}' AS context, "
                         f"unnest({found})::INT AS year, {score!r}::DOUBLE AS confidence, "
                         f"(unnest(range(0, len({found}))) + {order * 10_000_000 + number * 1_000_000})::INT AS seq FROM z")
    return " UNION ALL ".join(parts)


_FISCAL = _zones(zones.FISCAL_ZONES) + f", f AS ({_year_select()})"


@query("fiscal_year_findings", ["P6"], _FISCAL + " SELECT * FROM f")
def fiscal_year_findings(q: Inputs):
    return ops.fiscal_year_findings(q.view("triage_pages"))


_BEST_YEAR = _FISCAL + """,
    s AS (SELECT doc_id, page_num, year, min(seq) AS seq,
                 round(least(avg(confidence) + least(count(*) * 0.05::DOUBLE, 0.15::DOUBLE), 0.98::DOUBLE), 6) AS score
          FROM f WHERE year BETWEEN 2014 AND 2026 GROUP BY ALL),
    best AS (SELECT doc_id, page_num, year, round(score, 2) AS confidence FROM s
             QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY score DESC, seq) = 1)"""


@query("page_fiscal_years", ["A16", "W6", "Q4"], _BEST_YEAR + " SELECT * FROM best")
def page_fiscal_years(q: Inputs):
    return ops.page_fiscal_years(ops.fiscal_year_findings(q.view("triage_pages")), 2024)


@query("fiscal_year_vote", ["A16", "Q4"], _BEST_YEAR + """,
    v AS (SELECT doc_id, year, count(*) AS votes, min(page_num) AS first_page FROM best GROUP BY doc_id, year),
    w AS (SELECT doc_id, year FROM v
          QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, first_page) = 1),
    m AS (SELECT doc_id, count(*) AS pages_found, avg(confidence) AS c FROM best GROUP BY doc_id)
    SELECT t.doc_id, total_pages, coalesce(w.year, 0) AS most_common_year, coalesce(pages_found, 0) AS pages_found,
           round(coalesce(c, 0.7), 9) AS confidence
    FROM (SELECT doc_id, count(*) AS total_pages FROM triage_pages GROUP BY doc_id) t
    LEFT JOIN w USING (doc_id) LEFT JOIN m USING (doc_id)""")
def fiscal_year_vote(q: Inputs):
    return ops.fiscal_year_vote(q.view("triage_pages"), 2024).fillna(0, ["most_common_year"])
