"""Input views derived from the raw tables.

Each view is one SELECT over raw tables and other views, written in SQL that
both Spark and DuckDB run; where the dialects differ a view has two texts.
``{name}`` stands for a table or view. Every view reads its whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from leafmill.sources.tables import read_table

RAW = ("region nation customer supplier part orders lineitem events documents "
       "embeddings pages benchmark labels conversations").split()

# Month names used when dates are printed as text.
ENGLISH_MONTHS = ("January February March April May June July August September "
                  "October November December").split()
FRENCH_MONTHS = ("janvier février mars avril mai juin juillet août septembre "
                 "octobre novembre décembre").split()

# Browser console messages, one per known problem and four plain ones.
CONSOLE_MESSAGES = [
    "Failed to load resource: net::ERR_CONNECTION_REFUSED",
    "Uncaught TypeError: Cannot read property 'id' of undefined",
    "Access to fetch at /api/items blocked by CORS policy",
    "Warning: React component state error, maximum update depth exceeded",
    "Refused to run script: Content Security Policy directive",
    "Feature X is deprecated and will be removed",
    "[Vue warn]: Unknown custom element: <x-grid>",
    "GET /api/items 404 (Not Found)",
    "page ready in 120 ms",
    "user opened panel 100%_done",
    "cache warm",
    "Insecure request upgraded",
]

# First lines of triaged pages; the last words sit top right.
PAGE_HEADERS = [
    "Canada Revenue Agency Notice of Assessment tax year 2024 form T1",
    "Agence du revenu du Canada Avis de cotisation 2023",
    "Statement of Remuneration Paid employment income cpp T4 2024",
    "Statement of Investment Income interest dividends T5 2022",
    "Canada Revenue Agency Statement of Account balance owing January 1, 2022 to December 31, 2022",
    "Royal Bank account summary as of December 31, 2021",
    "TD Canada Trust chequing statement page 1 of 3",
    "Relevé 1 revenu emploi Quebec 2023 RL-1",
    "Tuition and Enrolment Certificate eligible fees for the year 2025 T2202A",
    "Revenue Canada cra-arc GST/HST credit RC151 2020 notice",
    "plain letter without any heading",
    "Caisse Desjardins releve 3 / 4",
    "Income Tax and Benefit Return fiscal year: 2019 total income 2031",
]


def _case(key: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{_quote(v)}'" for i, v in enumerate(values))
    return f"CASE {key} {arms} END"


def _quote(text: str) -> str:
    # Unicode code points are avoided in SQL escapes: both engines take UTF-8 text.
    return text.replace("'", "''").replace("{", "{{").replace("}", "}}")


def _spark_quote(sql: str) -> str:
    """Spark SQL reads '' inside a literal as two literals, so escape with a backslash."""
    return sql.replace("''", "\\'")


def _two(spark: str, duckdb: str) -> dict[str, str]:
    return {"spark": spark, "duckdb": duckdb}


_SETTING_KEYS = ("'blank_page_variance_threshold', 'blank_page_density_threshold', "
                 "'default_pdf_dpi', 'temp_file_cleanup_hours'")
# Modulo signs are doubled because the list of keys is filled in by the % operator.
_TENANT_SETTINGS = """
        SELECT tenant, skey,
               CASE WHEN code %% 5 = 4 THEN 'n/a'
                    WHEN skey = 'blank_page_variance_threshold' THEN cast(code * 10 AS STRING)
                    WHEN skey = 'blank_page_density_threshold' THEN concat('0.0', 1 + code %% 9)
                    ELSE cast(10 + code AS STRING) END AS svalue
        FROM (SELECT s_suppkey AS tenant, s_nationkey AS code, %s AS skey FROM {supplier}) k"""
_PADDED = "lpad(cast({} AS STRING), 2, '0')"
_CENTS = "cast(round(o_totalprice * 100) AS BIGINT)"


def _date_text(date: str, key: str) -> str:
    y, m, d = f"year({date})", f"month({date})", f"day({date})"
    pm, pd = _PADDED.format(m), _PADDED.format(d)
    english = _case(f"{m} - 1", ENGLISH_MONTHS)
    french = _case(f"{m} - 1", FRENCH_MONTHS)
    return f"""CASE WHEN {date} IS NULL THEN NULL ELSE CASE {key} % 7
        WHEN 0 THEN concat({y}, '-', {pm}, '-', {pd})
        WHEN 1 THEN concat({d}, ' ', {french}, ' ', {y})
        WHEN 2 THEN concat({english}, ' ', {d}, ', ', {y})
        WHEN 3 THEN concat({y}, '/', {pm}, '/', {pd})
        WHEN 4 THEN concat({pm}, '/', {pd}, '/', {y})
        WHEN 5 THEN concat({d}, ' ', {english}, ' ', {y})
        ELSE 'no date' END END"""


VIEWS: dict[str, str | dict[str, str]] = {
    # Execution log and its neighbours.
    "tool_executions": """
        SELECT event_id AS id, concat('tool_', user_id) AS tool_name,
               CASE event_type WHEN 'signup' THEN 'mortgage' WHEN 'purchase' THEN 'accounting'
                    ELSE 'all_around' END AS tool_class,
               event_type <> 'error' AS success,
               CASE WHEN event_id % 13 = 0 THEN NULL
                    ELSE ((event_id * 37) % 101) / 101.0e0 END AS confidence,
               cast(floor(value) AS INT) AS execution_time_ms, ts AS created_at,
               event_id % 5 = 0 AS trained,
               CASE WHEN event_type = 'error' THEN 'failed' END AS error
        FROM {events}""",
    "tool_catalog": """
        SELECT concat('tool_', p_partkey) AS tool_name,
               CASE WHEN p_size <= 45 THEN lower(replace(p_brand, '#', '_')) END AS subcategory,
               CASE WHEN p_size <= 45 THEN lower(p_type) END AS category,
               p_name AS short_description,
               concat(p_type, ' ', p_name, ' by ', p_brand) AS description
        FROM {part}""",
    "tool_templates": """
        SELECT p_partkey AS id, concat('tool_', p_size) AS tool_name,
               CASE p_type WHEN 'ECONOMY' THEN 'tax_form' WHEN 'STANDARD' THEN 'bank_statement'
                    ELSE 'id_card' END AS document_type,
               upper(replace(p_name, ' ', '_')) AS logo_name,
               p_partkey % 4 <> 0 AS is_active, p_size / 50.0e0 AS precision_rate,
               first_ship AS created_at
        FROM {part} LEFT JOIN (SELECT l_partkey, min(l_shipdate) AS first_ship
                               FROM {lineitem} GROUP BY l_partkey) s ON p_partkey = l_partkey""",
    # Zones of document layouts as stored JSON, eight templates a layout; some cannot be read.
    "zone_templates": """
        SELECT p_partkey AS id, concat('layout_', cast(floor(p_partkey / 8.0e0) AS BIGINT)) AS document_type,
               CASE WHEN p_partkey % 13 = 0 THEN '{{"broken'
                    WHEN p_partkey % 11 = 0 THEN '{{"half":{{"x":0.1,"y":0.2,"width":0.3}}}}'
                    ELSE concat('{{"z', p_partkey % 8, '":{{"x":0.', lpad(cast(p_partkey * 7 % 85 AS STRING), 2, '0'),
                                ',"y":0.', lpad(cast(p_partkey * 13 % 90 AS STRING), 2, '0'),
                                ',"width":0.', lpad(cast(5 + p_size % 45 AS STRING), 2, '0'), ',"height":0.', lpad(cast(4 + p_partkey % 50 AS STRING), 2, '0'),
                                '}},"all":{{"x":0,"y":0,"width":1,"height":0.', lpad(cast(10 + p_partkey % 20 AS STRING), 2, '0'), '}}}}') END AS zones
        FROM {part}""",
    # An address book in which streets have many house numbers, so that near addresses come in large families.
    "address_book": """
        SELECT c_custkey AS id,
               CASE WHEN c_custkey % 61 = 0 THEN NULL WHEN c_custkey % 67 = 0 THEN ' - '
                    ELSE concat(1 + c_custkey * 37 % 400, ' ',
                                CASE c_custkey % 7 WHEN 0 THEN 'Avenue North' WHEN 1 THEN 'rue de l''Église Ouest' WHEN 2 THEN 'Boulevard St-Laurent, Est'
                                     WHEN 3 THEN 'Montée  du Rang' WHEN 4 THEN 'Street # 4' WHEN 5 THEN 'Chemin des Érables' ELSE 'Streetcar Road South' END,
                                ', ', c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN concat(' QC H', c_nationkey % 10, 'X') ELSE ' ' END) END AS address
        FROM {customer}""",
    # Parts of which over half of the lines came back.
    "returned_parts": """
        SELECT l_partkey AS code FROM {lineitem} GROUP BY l_partkey
        HAVING sum(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END) > count(*)""",
    "training_queue": """
        SELECT id + 1000000 AS id, tool_name, id AS execution_id, confidence,
               execution_time_ms % 3 = 0 AS processed, created_at
        FROM {tool_executions} WHERE confidence < 0.75e0 AND success""",
    "tenant_settings": _two(
        _TENANT_SETTINGS % "explode(array({}))".format(_SETTING_KEYS),
        _TENANT_SETTINGS % "unnest([{}])".format(_SETTING_KEYS)),
    # Rules of tenants over console messages; the table grows with the parts.
    "tenant_rules": """
        SELECT p_partkey % 50 AS tenant, p_type AS category, p_partkey AS rank,
               concat(CASE p_partkey % 14 WHEN 0 THEN 'failed' WHEN 1 THEN 'cannot read' WHEN 2 THEN 'block' WHEN 3 THEN 'warning' WHEN 4 THEN 'policy'
                           WHEN 5 THEN 'deprecated' WHEN 6 THEN 'unknown custom' WHEN 7 THEN '404' WHEN 8 THEN 'ready in' WHEN 9 THEN 'pan[ae]l'
                           WHEN 10 THEN '(cache|store) w' WHEN 11 THEN 'upgrade' WHEN 12 THEN 'net::err_' ELSE 'st?ate' END,
                      CASE p_size % 4 WHEN 0 THEN '.*' WHEN 1 THEN '.*e' WHEN 2 THEN '[a-z ]*r' ELSE '.*(d|s)$' END) AS pattern
        FROM {part}""",
    # Console and network capture.
    "console_logs": f"""
        SELECT event_id AS seq, user_id AS session_id,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'pageerror'
                    WHEN 'signup' THEN 'warning' WHEN 'click' THEN 'info' ELSE 'log' END AS type,
               {_case("cast(floor(value) AS INT) % 12", CONSOLE_MESSAGES)} AS text, ts
        FROM {{events}}""",
    "request_log": """
        SELECT event_id AS seq,
               concat(CASE WHEN user_id % 3 = 0 THEN '/static/' ELSE '/api/items/' END, user_id) AS url,
               CASE WHEN event_type = 'click' THEN 'POST' ELSE 'GET' END AS method,
               CASE event_type WHEN 'view' THEN 'document' WHEN 'click' THEN 'fetch'
                    ELSE 'xhr' END AS resource_type,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending'
                    ELSE 'completed' END AS status,
               CASE WHEN event_type IN ('error', 'signup') THEN NULL
                    ELSE (CASE cast(floor(value) AS INT) % 8 WHEN 0 THEN 404 WHEN 1 THEN 500
                          WHEN 2 THEN 302 WHEN 3 THEN 101 WHEN 4 THEN 503 WHEN 5 THEN 403
                          ELSE 200 END) END AS response_status,
               CASE WHEN event_type = 'error' AND value < 50 THEN 'net::ERR_FAILED' END AS failure_text,
               CASE WHEN event_type = 'click' THEN props END AS post_data,
               user_id, ts
        FROM {events}""",
    "responses": """
        SELECT event_id AS seq,
               concat(CASE WHEN user_id % 4 = 0 THEN '/static/' ELSE '/api/items/' END, user_id) AS url,
               CASE cast(floor(value) AS INT) % 4 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END AS status,
               CASE cast(floor(value) AS INT) % 4 WHEN 0 THEN 'Not Found' WHEN 1 THEN 'Server Error'
                    ELSE 'OK' END AS status_text,
               cast(floor(value) AS INT) % 4 > 1 AS ok, ts
        FROM {events} WHERE event_type IN ('purchase', 'view')""",
    "requests_sent": """
        SELECT event_id AS seq, concat('/api/items/', user_id) AS url, ts
        FROM {events} WHERE event_type IN ('click', 'view', 'signup')""",
    "completions": """
        SELECT event_id AS seq, concat('/api/items/', user_id) AS url,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'response' END AS kind,
               CASE WHEN event_type = 'error' THEN NULL
                    ELSE 200 + cast(floor(value) AS INT) % 4 * 100 END AS status, ts
        FROM {events} WHERE event_type IN ('purchase', 'error')""",
    # Documents as lines, pages, words.
    "doc_lines": _two(
        """SELECT doc_id, pos + 1 AS line_no, line AS text
           FROM (SELECT doc_id, posexplode(split(text, '\\n')) AS (pos, line) FROM {documents})""",
        """SELECT doc_id, unnest(range(1, len(ls) + 1))::INT AS line_no, unnest(ls) AS text
           FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {documents})"""),
    "doc_pages": _two(
        """SELECT doc_id, cast(pos + 1 AS INT) AS page_num, page AS text
           FROM (SELECT doc_id, split(text, '\\n') AS ls FROM {documents})
           LATERAL VIEW posexplode(transform(sequence(0, (size(ls) - 1) div 10),
                                             i -> array_join(slice(ls, i * 10 + 1, 10), '\\n'))) AS pos, page""",
        """SELECT doc_id, (pos + 1)::INT AS page_num,
                  array_to_string(ls[pos * 10 + 1:pos * 10 + 10], chr(10)) AS text
           FROM (SELECT doc_id, ls, unnest(range(0, (len(ls) - 1) // 10 + 1)) AS pos
                 FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {documents}))"""),
    "chat_pages": """
        SELECT conv_id AS doc_id, cast(turn + 1 AS INT) AS page_num, text FROM {conversations}""",
    # Pages headed by triage vocabulary; the prose of the document follows.
    "triage_pages": f"""
        SELECT doc_id, page_num,
               concat({_case(f"(doc_id * 7 + page_num) % {len(PAGE_HEADERS)}", PAGE_HEADERS)},
                      chr(10), text, chr(10),
                      CASE (doc_id + page_num) % 5 WHEN 0 THEN concat('page ', page_num, ' / ', 1 + doc_id % 9)
                           WHEN 1 THEN concat(page_num, ' of ', 1 + doc_id % 9) WHEN 2 THEN concat('- ', page_num, '/', 1 + doc_id % 9)
                           WHEN 3 THEN 'continued' ELSE concat('Page ', page_num, ' of ', 1 + doc_id % 9) END) AS text
        FROM {{doc_pages}}""",
    "table_pages": """
        SELECT user_id AS doc_id, cast(floor(day(ts) / 10.0e0) AS INT) + 1 AS page_num,
               cast(event_id AS INT) AS line_no,
               CASE event_type
                 WHEN 'click' THEN concat(event_id, '  ', cast(floor(value) AS INT), '  ', user_id)
                 WHEN 'view' THEN concat('item ', event_id, ', qty ', cast(floor(value) AS INT))
                 WHEN 'purchase' THEN concat(event_id, '  ', user_id, '  a  b  ', cast(floor(value) AS INT))
                 WHEN 'signup' THEN concat(chr(9), 'plain words only ', chr(13))
                 ELSE concat('  total  ', cast(floor(value) AS INT), ' ') END AS text
        FROM {events}""",
    "files": """
        SELECT doc_id, concat('/in/', source, '/', doc_id,
                              CASE WHEN lang = 'en' THEN '.pdf' WHEN lang = 'fr' THEN '.PDF'
                                   ELSE '.txt' END, '?v=', n_chars) AS path,
               n_chars AS length,
               concat(lang, '_', n_chars % 4) AS session_id,
               CASE lang WHEN 'fr' THEN 'zone_extraction' WHEN 'de' THEN 'unknown'
                    ELSE 'logo_detection' END AS mode
        FROM {documents}""",
    "merge_parts": """
        SELECT o_custkey AS merge_id, cast(o_orderkey AS INT) AS file_no,
               cast(1 + o_orderkey % 4 AS INT) AS page_count, cast(floor(o_totalprice) AS BIGINT) AS file_size
        FROM {orders}""",
    # One request per document, a second one for some, and some for documents that are not there.
    "page_requests": """
        SELECT doc_id * 10 AS request_id, doc_id,
               CASE doc_id % 6 WHEN 0 THEN '1' WHEN 1 THEN '1-2' WHEN 2 THEN concat('1-1,', chr(9), '2 ,1')
                    WHEN 3 THEN '2-1' WHEN 4 THEN '0-1' ELSE '1,x' END AS ranges,
               cast(1 + doc_id % 3 AS INT) AS page_number,
               CASE doc_id % 5 WHEN 0 THEN 45 WHEN 1 THEN 90 WHEN 2 THEN -90
                    WHEN 3 THEN 180 ELSE -270 END AS degrees
        FROM {documents}
        UNION ALL SELECT doc_id * 10 + 1, doc_id, '1', cast(1 + doc_id % 2 AS INT), 90 FROM {documents} WHERE doc_id % 7 = 0
        UNION ALL SELECT doc_id * 10 + 2, -1 - doc_id, '1', 1, 90 FROM {documents} WHERE doc_id % 11 = 0""",
    # Contacts, money, dates.
    "contacts": """
        SELECT c_custkey AS id,
               CASE c_custkey % 8 WHEN 0 THEN 'JEAN-FRANÇOIS   TREMBLAY' WHEN 1 THEN 'anna mcdonald'
                    WHEN 2 THEN 'o''neil  marie   roy' WHEN 3 THEN 'Madonna' WHEN 4 THEN '   '
                    WHEN 5 THEN concat('élise (', c_mktsegment, ') ducharme')
                    ELSE concat(c_name, ' smith jr') END AS name,
               concat(1 + c_custkey % 10, ' ',
                      CASE c_custkey % 7 WHEN 0 THEN 'Avenue North' WHEN 1 THEN 'rue de l''Église Ouest'
                           WHEN 2 THEN 'Boulevard St-Laurent, Est' WHEN 3 THEN 'Montée  du Rang'
                           WHEN 4 THEN 'Street # 4' WHEN 5 THEN 'Chemin des Érables'
                           ELSE 'Streetcar Road South' END, ', ', c_mktsegment) AS address,
               concat(1 + c_custkey % 10, ' ',
                      CASE c_custkey % 7 WHEN 0 THEN 'Ave. N' WHEN 1 THEN 'RUE EGLISE OUEST'
                           WHEN 2 THEN 'Boulevard Saint-Laurent' WHEN 3 THEN 'Montée du Rang'
                           WHEN 4 THEN 'Street #4' WHEN 5 THEN 'Ch. des Erables'
                           ELSE 'Oak Lane' END, ' ',
                      CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE 'OTTAWA' END) AS seen_address,
               CASE c_custkey % 5 WHEN 0 THEN concat('(514) ', 200 + c_custkey % 800, '-', 1000 + c_custkey % 9000)
                    WHEN 1 THEN concat('1-416-', 200 + c_custkey % 800, '.', 1000 + c_custkey % 9000)
                    WHEN 2 THEN concat('114', 5550000 + c_custkey % 1000)
                    WHEN 3 THEN concat('613 1', c_custkey % 90, ' 1234')
                    ELSE concat('418', 2000000 + c_custkey) END AS phone,
               concat(100 + c_custkey % 900, CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE ' ' END,
                      100 + (c_custkey * 7) % 900, ' ', 100 + (c_custkey * 13) % 900) AS sin,
               CASE c_custkey % 6 WHEN 0 THEN concat('k', c_custkey % 10, 'a', c_custkey % 7, 'b1')
                    WHEN 1 THEN concat(chr(9), ' H', c_custkey % 10, 'Z 2', 'Y', c_custkey % 10, chr(10))
                    WHEN 2 THEN lpad(cast(c_custkey % 100000 AS STRING), 5, '0')
                    WHEN 3 THEN concat(lpad(cast(c_custkey % 100000 AS STRING), 5, '0'), '-1234')
                    WHEN 4 THEN '1234' ELSE 'K1AA0B1' END AS postal,
               CASE c_custkey % 5 WHEN 0 THEN concat(chr(160), c_name, '@Example.COM ', chr(13), chr(10))
                    WHEN 1 THEN concat('user.', c_custkey, '@mail.example.org')
                    WHEN 2 THEN concat('user', c_custkey, '@nodot')
                    WHEN 3 THEN concat('a@b@c', c_custkey, '.com') ELSE 'no-at-sign.com' END AS email
        FROM {customer}""",
    "amount_texts": f"""
        SELECT o_orderkey AS id, o_orderstatus AS batch, CASE o_orderkey % 9
            WHEN 0 THEN concat('$', k, ',', r, '.', c)
            WHEN 1 THEN concat(k, ' ', r, ',', c, ' $')
            WHEN 2 THEN concat('(', k, ',', r, '.', c, ')')
            WHEN 3 THEN concat(k, '.', r, ',', c, ' €')
            WHEN 4 THEN concat('CAD ', k, ',', r)
            WHEN 5 THEN concat('1,', r, ',', r)
            WHEN 6 THEN concat('USD ', r)
            WHEN 7 THEN concat(k, r, '.', c)
            ELSE concat(chr(9), ' -', k, r, chr(160), chr(10)) END AS amount_string
        FROM (SELECT o_orderkey, o_orderstatus, cast(floor(cents / 100000.0e0) AS BIGINT) AS k,
                     lpad(cast(cast(floor(cents / 100.0e0) AS BIGINT) % 1000 AS STRING), 3, '0') AS r,
                     lpad(cast(cents % 100 AS STRING), 2, '0') AS c
              FROM (SELECT o_orderkey, o_orderstatus, {_CENTS} AS cents FROM {{orders}}) a) b""",
    "date_texts": f"""
        SELECT o_orderkey AS id, o_orderpriority AS batch,
               {_date_text("o_orderdate", "o_orderkey")} AS start_date,
               {_date_text("last_ship", "(o_orderkey + 3)")} AS end_date,
               CASE WHEN o_orderkey % 4 = 0 THEN 30 END AS max_days
        FROM {{orders}} LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship
                                 FROM {{lineitem}} GROUP BY l_orderkey) s ON o_orderkey = l_orderkey""",
    "t4": f"""
        SELECT o_custkey AS applicant, cast(year(o_orderdate) AS INT) AS year,
               cast(floor(sum({_CENTS}) / 100.0e0) AS BIGINT) / 1.0e0 AS amount
        FROM {{orders}} GROUP BY o_custkey, year(o_orderdate)""",
    "loans": """
        SELECT o_orderkey AS id, o_custkey AS applicant, c_mktsegment AS segment,
               CASE WHEN o_orderkey % 41 = 0 THEN 0.0e0
                    WHEN o_orderkey % 17 = 0 THEN 15600.0e0 * (1 + o_orderkey % 30)
                    ELSE o_totalprice END AS principal,
               CASE WHEN o_orderkey % 29 = 0 THEN 0.0e0
                    ELSE floor(o_totalprice * (100 + o_orderkey % 60) / 100.0e0) END AS property_value,
               CASE WHEN o_orderkey % 17 = 0 THEN 0.0e0 ELSE (o_orderkey % 340) / 10.0e0 END AS annual_rate,
               cast(10 + o_orderkey % 21 AS INT) AS years,
               CASE o_orderkey % 4 WHEN 0 THEN 'monthly' WHEN 1 THEN 'biweekly' WHEN 2 THEN 'weekly'
                    ELSE 'fortnightly' END AS freq,
               (o_orderkey % 500) / 1.0e0 AS tax, (o_orderkey % 150) / 1.0e0 AS heating,
               (o_orderkey % 300) / 1.0e0 AS condo, (o_orderkey % 900) / 1.0e0 AS debts
        FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey""",
    "pay": """
        SELECT c_custkey AS applicant, c_acctbal AS amount,
               CASE c_custkey % 7 WHEN 0 THEN concat(chr(9), ' Weekly') WHEN 1 THEN 'biweekly' WHEN 2 THEN concat('SEMI-MONTHLY', chr(13), chr(10))
                    WHEN 3 THEN 'monthly' WHEN 4 THEN 'quarterly' WHEN 5 THEN 'annual'
                    ELSE 'daily' END AS period
        FROM {customer}""",
    # Page images and page features.
    "page_images": _two(
        """SELECT vec_id AS page_id, cast(floor(vec_id / 10.0e0) AS BIGINT) AS doc_id,
                  cast(vec_id % 10 + 1 AS INT) AS page_num, 16 AS width, 4 AS height,
                  transform(embedding, e -> cast(least(255, floor(abs(cast(e AS DOUBLE)) * 800)) AS INT)) AS gray
           FROM {embeddings}""",
        """SELECT vec_id AS page_id, cast(floor(vec_id / 10.0e0) AS BIGINT) AS doc_id,
                  cast(vec_id % 10 + 1 AS INT) AS page_num, 16 AS width, 4 AS height,
                  [cast(least(255, floor(abs(cast(e AS DOUBLE)) * 800)) AS INT) FOR e IN embedding] AS gray
           FROM {embeddings}"""),
    "page_features": """
        SELECT doc_id, page_num, length(text) < 60 AS is_blank,
               (doc_id + page_num) % 5 = 0 AS is_page_one, length(text) % 3 = 0 AS header_changed,
               cast(length(text) % 251 AS INT) AS q1, cast((doc_id * 3) % 120 AS INT) AS q2,
               cast(length(text) % 83 AS INT) AS q3, cast((page_num * 31) % 90 AS INT) AS q4
        FROM {doc_pages}""",
    "page_scans": """
        SELECT doc_id, page_num, cast(60 + length(text) % 300 AS INT) AS dpi,
               cast(600 + length(text) % 2800 AS INT) AS width, cast(900 + (length(text) * 7) % 2500 AS INT) AS height,
               CASE WHEN length(text) % 3 = 0 THEN cast(72 + length(text) % 251 AS INT) END AS dpi_x,
               CASE WHEN length(text) % 3 = 0 THEN cast(73 + length(text) % 240 AS INT) END AS dpi_y,
               (length(text) % 700) / 2.0e0 AS blur_score, length(text) % 11 = 0 AS too_dark,
               length(text) % 11 = 1 AS too_bright, length(text) % 7 = 0 AS low_contrast,
               (cast(length(text) % 200 AS INT) - 100) / 10.0e0 AS skew_angle
        FROM {doc_pages}""",
    "page_ink": """
        SELECT doc_id, page_num, 1 + doc_id % 12 AS tenant, ((length(text) * 7) % 4000) / 10.0e0 + 0.03e0 AS variance,
               (length(text) % 50) / 1000.0e0 + 0.0003e0 AS density
        FROM {doc_pages}""",
    "card_scans": """
        SELECT user_id AS doc_id, cast(event_id AS INT) AS page_num,
               1.0e0 + (cast(floor(value) AS INT) % 50) / 50.0e0 AS aspect_ratio,
               event_type IN ('click', 'view') AS has_hologram, (event_id % 10) / 10.0e0 AS hologram_conf,
               event_type IN ('view', 'purchase') AS has_barcode, (event_id % 7) / 7.0e0 AS barcode_conf,
               event_type = 'signup' AS has_stripe, 0.8e0 AS stripe_conf,
               (event_id % 6) / 6.0e0 AS rounded_conf
        FROM {events}""",
    "card_sides": """
        SELECT user_id AS doc_id, cast(event_id AS INT) AS page_num,
               CASE WHEN event_type IN ('click', 'purchase') THEN 'recto' WHEN event_type = 'error' THEN 'unknown'
                    ELSE 'verso' END AS side, (event_id % 50) / 50.0e0 AS confidence
        FROM {events}""",
    # Forms, detections, links.
    "form_fields": """
        SELECT o_custkey AS doc_id, o_orderkey AS field_no,
               concat(CASE o_orderpriority WHEN '1-URGENT' THEN 'Signature_' WHEN '2-HIGH' THEN 'assigned_'
                      ELSE 'name_' END, o_orderkey) AS name,
               CASE o_orderkey % 5 WHEN 0 THEN '/Tx' WHEN 1 THEN '/Btn' WHEN 2 THEN '/Ch'
                    WHEN 3 THEN '/Sig' ELSE '/Zz' END AS field_type,
               CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN trim(' ')
                    ELSE concat('v', o_orderkey) END AS value
        FROM {orders}""",
    "detections": """
        SELECT p_partkey AS doc_id, p_size % 9 = 0 AS skip,
               CASE p_partkey % 6
                 WHEN 0 THEN concat('```json', chr(10), '{{"logos_detected":[{{"name":"', p_name,
                      '","confidence":', p_size / 50.0e0, '}}],"document_type":"tax_form","confidence":0.5}}',
                      chr(10), '```')
                 WHEN 1 THEN concat('```', chr(10), '{{"zones":[{{"type":"amount","label":"', p_type,
                      '","value":"1"}},{{"type":"date","label":"d","value":"2"}}]}}', chr(10), '``` done')
                 WHEN 2 THEN concat('{{"logos_detected":[{{"name":"', p_name, '","confidence":0.9}},',
                      '{{"name":"second","confidence":0.2}}],"valid":true}}')
                 WHEN 3 THEN '{{"valid":false}}'
                 WHEN 4 THEN 'not json at all'
                 ELSE concat('{{"logos_detected":[],"zones":[],"confidence":', p_size / 50.0e0, '}}') END AS payload
        FROM {part}""",
    "validated": """
        SELECT p_partkey AS doc_id, CASE p_partkey % 4
                 WHEN 0 THEN concat('{{"tool_name":"t', p_size, '","document_type":"tax_form","logo_name":"',
                      p_name, '","confidence":0.75}}')
                 WHEN 1 THEN concat('{{"logo_name":"', p_name, '"}}')
                 WHEN 2 THEN concat('{{"document_type":"id_card","confidence":', p_size / 50.0e0, '}}')
                 ELSE '{{broken' END AS payload
        FROM {part}""",
    "session_results": """
        SELECT concat('session_', o_custkey) AS session_id, o_orderkey AS file_id,
               o_orderstatus <> 'P' AS success,
               CASE WHEN o_orderstatus = 'P' THEN 'unreadable' END AS error
        FROM {orders}""",
    "web_texts": """
        SELECT page_id AS doc_id, concat('See ', url, ' or HTTPS://x.example.com. Mirror: http://m.example.org/',
                                         page_id % 50, ' end ', html) AS text
        FROM {pages}""",
}


def _names(sql: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{([a-z_0-9]+)\}(?!\})", sql)))


def _text(name: str, engine: str) -> str:
    sql = VIEWS[name]
    return sql if isinstance(sql, str) else sql[engine]


def spark_view(spark: SparkSession, path: str, name: str, opened: dict[str, DataFrame] | None = None) -> DataFrame:
    """A raw table or a view over one data directory; ``opened`` keeps what was
    read already, so that one query opens each table once."""
    opened = {} if opened is None else opened
    if name not in opened:
        if name in RAW:
            opened[name] = read_table(spark, path, name)
        else:
            sql = _text(name, "spark")
            inputs = {dep: spark_view(spark, path, dep, opened) for dep in _names(sql)}
            opened[name] = spark.sql(_spark_quote(sql) if isinstance(VIEWS[name], str) else sql, **inputs)
    return opened[name]


def duckdb_ctes(names: list[str]) -> str:
    """Comma-joined common table expressions for ``names`` and what they read."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in RAW or name in ordered:
            return
        for dep in _names(_text(name, "duckdb")):
            visit(dep)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in ordered:
        sql = _text(name, "duckdb")
        parts.append(f"{name} AS ({sql.format(**{d: d for d in _names(sql)}).strip()})")
    return ", ".join(parts)
