"""Queries over contact, money, date and loan columns."""

from pyspark.sql import functions as F

from leafmill.functions import finance, normalize, parse, validate
from leafmill.functions.common import count_true, rule_summary, strip
from leafmill.functions.sql_rules import register_sql_rules
from leafmill.operators import address_links, addresses, finance as books
from leafmill.registry import Inputs, query


def _opened(df, expression, *keep: str):
    """The chosen columns and every field of a rule's struct."""
    return df.select(*keep, expression.alias("r")).select(*keep, "r.*")


# Cleaning and matching keys.

def _spaces(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


_ACCENTS = f"translate({{}}, '{normalize.ACCENTED}', '{normalize.PLAIN}')"


def _address_oracle(column: str) -> str:
    text = _ACCENTS.format(f"upper({_spaces(column)})")
    text = rf"regexp_replace({text}, '[^\w\s#-]', ' ', 'g')"
    for word, short in {**normalize.STREET_WORDS, **normalize.DIRECTIONS}.items():
        text = rf"regexp_replace({text}, '\b{word}\b', '{short}', 'g')"
    return _spaces(text)


def _key_oracle(column: str) -> str:
    text = f"translate(upper({column}), 'ÉÈÊË', 'EEEE')"
    return _spaces(rf"regexp_replace({text}, '[^\p{{L}}\p{{N}}_\s#]', ' ', 'g')")


@query("normalize_address", ["N1"], f"SELECT id, {_address_oracle('address')} AS normalized FROM contacts")
def normalize_address(q: Inputs):
    return q.view("contacts").select("id", normalize.normalize_address("address").alias("normalized"))


@query("address_match_key", ["N2"], f"SELECT id, {_key_oracle('address')} AS match_key FROM contacts")
def address_match_key(q: Inputs):
    return q.view("contacts").select("id", normalize.address_match_key("address").alias("match_key"))


@query("normalize_name", ["N3"], rf"""
    WITH c AS (SELECT id, regexp_replace({_spaces('name')}, '[^\p{{L}}\p{{N}}_\s''-]', '', 'g') AS t FROM contacts),
         d AS (SELECT id, array_to_string(list_transform(regexp_extract_all(t, '\p{{L}}+|\P{{L}}+'),
                          lambda x: concat(upper(x[1]), lower(x[2:]))), '') AS t FROM c),
         e AS (SELECT id, array_to_string(list_transform(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'),
                          lambda x: CASE WHEN regexp_matches(x, '^Mc[a-z]') THEN concat('Mc', upper(x[3]), x[4:])
                                    ELSE x END), '') AS t FROM d)
    SELECT id, t AS with_accents, {_ACCENTS.format('t')} AS normalized FROM e""")
def normalize_name(q: Inputs):
    return q.view("contacts").select("id", normalize.normalize_name("name", False).alias("with_accents"),
                                     normalize.normalize_name("name").alias("normalized"))


@query("split_full_name", ["N4"], f"""
    WITH c AS (SELECT id, {_spaces('name')} AS t FROM contacts)
    SELECT id, CASE WHEN t <> '' THEN array_to_string(string_split(t, ' ')[:-2], ' ') END AS first_name,
           CASE WHEN t <> '' THEN string_split(t, ' ')[-1] END AS last_name,
           CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END::INT AS parts_count,
           CASE WHEN t = '' THEN 0.0 ELSE 0.95 END::DOUBLE AS confidence,
           CASE WHEN t = '' THEN 'Empty name' END AS error FROM c""")
def split_full_name(q: Inputs):
    return _opened(q.view("contacts"), normalize.split_full_name("name"), "id")


def _address_pairs(q: Inputs):
    contacts = q.view("contacts")
    return addresses.address_pairs(contacts.select("id", "address"), contacts.select("id", "seen_address"), "id")


@query("address_edit_similarity", ["N5", "J8"], f"""
    WITH k AS (SELECT id, {_key_oracle('address')} AS key_a, {_key_oracle('seen_address')} AS key_b FROM contacts),
         p AS (SELECT *, round((1 - levenshtein(key_a, key_b) / greatest(length(key_a), length(key_b))::DOUBLE)
                         * 100, 1) AS edit_similarity_percent FROM k)
    SELECT id, key_a, key_b, edit_similarity_percent, edit_similarity_percent >= 80 AS edit_match,
           edit_similarity_percent >= 60 AS edit_likely_match FROM p""")
def address_edit_similarity(q: Inputs):
    return addresses.address_edit_similarity(_address_pairs(q), "address", "seen_address").select(
        "id", "key_a", "key_b", "edit_similarity_percent", "edit_match", "edit_likely_match")


@query("address_duplicates", ["J8"], f"""
    SELECT {_key_oracle('address')} AS match_key, count(*) AS records, min(id) AS first_id, max(id) AS last_id
    FROM contacts GROUP BY 1 HAVING count(*) > 1""")
def address_duplicates(q: Inputs):
    return addresses.address_duplicates(q.view("contacts"))


_NEAR = f"""
    WITH r AS (SELECT id, {_key_oracle('address')} AS match_key FROM address_book),
    k AS MATERIALIZED (SELECT match_key, min(id) AS class_id, count(*) AS records FROM r WHERE match_key <> '' GROUP BY match_key),
    e AS MATERIALIZED (SELECT a.class_id AS x, b.class_id AS y FROM k a JOIN k b ON a.class_id <> b.class_id
          AND abs(length(a.match_key) - length(b.match_key)) <= 0.21 * greatest(length(a.match_key), length(b.match_key))
          AND round((1 - levenshtein(a.match_key, b.match_key) / greatest(length(a.match_key), length(b.match_key))::DOUBLE) * 100, 1) >= 80),
    c AS (WITH RECURSIVE walk(node, root) AS (SELECT class_id, class_id FROM k UNION SELECT y, root FROM walk JOIN e ON x = node)
          SELECT node AS class_id, min(root) AS component_id FROM walk GROUP BY node),
    d AS (SELECT x AS class_id, count(*) AS links FROM e GROUP BY x),
    s AS (SELECT r.id, r.match_key, coalesce(k.class_id, r.id) AS class_id, coalesce(records, 1) AS records, coalesce(links, 0) AS links,
                 coalesce(component_id, r.id) AS component_id
          FROM r LEFT JOIN k ON r.match_key = k.match_key LEFT JOIN c USING (class_id) LEFT JOIN d USING (class_id))"""


@query("near_addresses", ["J8", "N5"], _NEAR + " SELECT * FROM s")
def near_addresses(q: Inputs):
    return address_links.near_addresses(q.view("address_book"))


@query("address_families", ["J8"], _NEAR + """
    SELECT component_id, count(DISTINCT class_id) AS match_keys, count(*) AS records,
           (SELECT (sum(links) / 2)::BIGINT FROM (SELECT DISTINCT class_id, links FROM s t WHERE t.component_id = s.component_id)) AS links
    FROM s GROUP BY component_id HAVING count(DISTINCT class_id) > 1""")
def address_families(q: Inputs):
    return address_links.families(q.view("address_book"))


# Parsing.

_CURRENCY = r"""
    WITH z AS (SELECT *, regexp_replace(<strip:amount_string>, '[$€£¥CADcad]', '', 'g') AS raw FROM amount_texts),
         a AS (SELECT *, <strip:raw> AS t FROM z),
         b AS (SELECT id, batch, amount_string, starts_with(t, '(') AND suffix(t, ')') AS neg,
                      replace(CASE WHEN starts_with(t, '(') AND suffix(t, ')') THEN t[2:-2] ELSE t END, ' ', '') AS t FROM a),
         c AS (SELECT *, len(string_split(t, '.')) - 1 AS dots, len(string_split(t, ',')) - 1 AS commas,
                      regexp_extract(t, '.*([.,])', 1) AS mark FROM b),
         d AS (SELECT *, CASE WHEN commas = 0 AND dots <= 1 THEN t
                      WHEN commas = 1 AND dots = 0 AND regexp_matches(t, ',\d{2}$') THEN replace(t, ',', '.')
                      WHEN commas = 1 AND dots = 0 THEN replace(t, ',', '')
                      WHEN mark = '.' THEN replace(t, ',', '')
                      ELSE replace(replace(t, '.', ''), ',', '.') END AS n FROM c),
         parsed AS (SELECT id, batch, amount_string,
                      CASE WHEN regexp_full_match(n, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?')
                           THEN CASE WHEN neg THEN -n::DOUBLE ELSE n::DOUBLE END END AS amount FROM d)"""


def _amounts(q: Inputs):
    return q.view("amount_texts").withColumn("amount", parse.parse_currency("amount_string"))


@query("parse_currency", ["P1"], _CURRENCY + "SELECT id, amount_string, amount FROM parsed")
def parse_currency(q: Inputs):
    return _amounts(q).select("id", "amount_string", "amount")


@query("currency_summary", ["P1"], _CURRENCY + """
    SELECT batch, count(*) AS row_count, count(amount) AS valid, count(*) - count(amount) AS invalid,
           round(count(amount)::DOUBLE / count(*), 4) AS valid_share FROM parsed GROUP BY batch""")
def currency_summary(q: Inputs):
    return rule_summary(_amounts(q), F.col("amount").isNotNull(), "batch")


def _french(text: str) -> str:
    for french, english in parse.FRENCH_TO_ENGLISH.items():
        text = f"replace({text}, ' {french} ', ' {english} ')"
    return text


@query("parse_date", ["P2"], f"""
    WITH t AS (SELECT id, start_date, try_strptime({_french('start_date')},
                      ['%Y-%m-%d', '%Y/%m/%d', '%d %B %Y', '%B %d, %Y', '%m/%d/%Y', '%d/%m/%Y']) AS moment FROM date_texts)
    SELECT id, start_date, strftime(moment, '%Y-%m-%d') AS iso_format, strftime(moment, '%B %d, %Y') AS human_format,
           coalesce(year(moment), 0)::INT AS year, coalesce(month(moment), 0)::INT AS month, coalesce(day(moment), 0)::INT AS day,
           coalesce(epoch(moment)::BIGINT, 0) AS epoch, CASE WHEN moment IS NULL THEN 'Cannot parse date' END AS error FROM t""")
def parse_date(q: Inputs):
    return _opened(q.view("date_texts"), parse.parse_date("start_date"), "id", "start_date").fillna(
        0, ["year", "month", "day", "epoch"])


# Validation.

@query("validate_sin", ["V1"], r"""
    WITH c AS (SELECT id, regexp_replace(sin, '[\s\-]', '', 'g') AS cleaned FROM contacts),
         l AS (SELECT id, cleaned, list_sum(list_transform(range(1, 10), lambda i:
                   CASE WHEN i % 2 = 0 THEN [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][cleaned[i]::INT + 1]
                        ELSE cleaned[i]::INT END)) AS total FROM c),
         v AS (SELECT *, regexp_full_match(cleaned, '[1-79]\d{8}') AND total % 10 = 0 AS is_valid FROM l)
    SELECT id, cleaned, CASE WHEN is_valid THEN concat(cleaned[1:3], '-', cleaned[4:6], '-', cleaned[7:9]) END AS formatted,
           is_valid, CASE WHEN NOT is_valid THEN 'Invalid SIN format or checksum' END AS error FROM v""")
def validate_sin(q: Inputs):
    return _opened(q.view("contacts"), validate.validate_sin("sin"), "id")


@query("validate_postal_code", ["V2"], r"""
    WITH c AS (SELECT id, upper(<strip:postal>) AS cleaned FROM contacts),
         v AS (SELECT *, CASE WHEN regexp_matches(cleaned, '^[A-Z]\d[A-Z]\s?\d[A-Z]\d$') THEN 'CA'
                              WHEN regexp_matches(cleaned, '^\d{5}(-\d{4})?$') THEN 'US' ELSE 'UNKNOWN' END AS country FROM c)
    SELECT id, cleaned, CASE country WHEN 'CA' THEN concat(cleaned[1:3], ' ', right(cleaned, 3))
                                     WHEN 'US' THEN cleaned END AS formatted,
           country, country <> 'UNKNOWN' AS is_valid,
           CASE WHEN country = 'UNKNOWN' THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM v""")
def validate_postal_code(q: Inputs):
    return _opened(q.view("contacts"), validate.validate_postal_code("postal"), "id")


@query("validate_phone", ["V3"], r"""
    WITH c AS (SELECT id, regexp_replace(phone, '\D', '', 'g') AS cleaned FROM contacts),
         d AS (SELECT *, regexp_extract(cleaned, '^(1?)([2-9]\d\d)([2-9]\d\d)(\d{4})$', ['cc', 'a', 'b', 'c']) AS p FROM c)
    SELECT id, cleaned, CASE WHEN p.a <> '' THEN concat(CASE WHEN p.cc = '1' THEN '+1 ' ELSE '' END,
                                                        '(', p.a, ') ', p.b, '-', p.c) END AS formatted,
           p.a <> '' AS is_valid, CASE WHEN p.a = '' THEN 'Invalid phone number format' END AS error FROM d""")
def validate_phone(q: Inputs):
    return _opened(q.view("contacts"), validate.validate_phone("phone"), "id")


@query("validate_email", ["V4"], r"""
    WITH c AS (SELECT id, lower(<strip:email>) AS normalized FROM contacts),
         v AS (SELECT *, regexp_matches(normalized, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') AS is_valid FROM c)
    SELECT id, normalized, CASE WHEN is_valid THEN split_part(normalized, '@', 1) END AS local_part,
           CASE WHEN is_valid THEN split_part(normalized, '@', 2) END AS domain,
           CASE WHEN is_valid THEN string_split(normalized, '.')[-1] END AS tld, is_valid FROM v""")
def validate_email(q: Inputs):
    return _opened(q.view("contacts"), validate.validate_email("email"), "id")


@query("contact_summary", ["V1", "V2", "V3", "V4"], r"""
    WITH c AS (SELECT upper(<strip:postal>) AS code, lower(<strip:email>) AS mail, regexp_replace(phone, '\D', '', 'g') AS digits,
                      regexp_replace(sin, '[\s\-]', '', 'g') AS nine FROM contacts),
         v AS (SELECT coalesce(code LIKE 'K%', false) AS in_k,
                      regexp_full_match(nine, '[1-79]\d{8}') AND list_sum(list_transform(range(1, 10), lambda i:
                          CASE WHEN i % 2 = 0 THEN [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][try_cast(nine[i] AS INT) + 1] ELSE try_cast(nine[i] AS INT) END)) % 10 = 0 AS sin_ok,
                      regexp_full_match(code, '[A-Z]\d[A-Z]\s?\d[A-Z]\d|\d{5}(-\d{4})?') AS postal_ok,
                      regexp_full_match(digits, '1?[2-9]\d\d[2-9]\d\d\d{4}') AS phone_ok,
                      regexp_full_match(mail, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') AS email_ok FROM c)
    SELECT in_k, count(*) AS row_count, count(*) FILTER (sin_ok) AS valid_sins, count(*) FILTER (postal_ok) AS valid_postal_codes,
           count(*) FILTER (phone_ok) AS valid_phones, count(*) FILTER (email_ok) AS valid_emails,
           count(*) FILTER (sin_ok AND postal_ok AND phone_ok AND email_ok) AS all_valid FROM v GROUP BY in_k""")
def contact_summary(q: Inputs):
    rules = {"valid_sins": validate.validate_sin("sin"), "valid_postal_codes": validate.validate_postal_code("postal"),
             "valid_phones": validate.validate_phone("phone"), "valid_emails": validate.validate_email("email")}
    rows = q.view("contacts").select(F.coalesce(F.upper(strip("postal")).startswith("K"), F.lit(False)).alias("in_k"),
                                     *[rule["is_valid"].alias(name) for name, rule in rules.items()])
    every = F.col("valid_sins") & F.col("valid_postal_codes") & F.col("valid_phones") & F.col("valid_emails")
    return rows.groupBy("in_k").agg(F.count(F.lit(1)).alias("row_count"), *[count_true(F.col(name)).alias(name) for name in rules],
                                    count_true(every).alias("all_valid"))


@query("validate_date_range", ["V5"], """
    WITH t AS (SELECT *, try_strptime(start_date, ['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y', '%Y/%m/%d', '%d-%m-%Y']) AS a,
                      try_strptime(end_date, ['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y', '%Y/%m/%d', '%d-%m-%Y']) AS b
               FROM date_texts),
         u AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE date_diff('day', a, b) END AS days FROM t)
    SELECT id, coalesce(days, 0)::BIGINT AS days_difference, coalesce(days >= 0, false) AS is_chronological,
           days IS NOT NULL AND coalesce(days <= max_days, true) AS within_max_days,
           coalesce(days >= 0 AND coalesce(days <= max_days, true), false) AS is_valid,
           days IS NOT NULL AND a > TIMESTAMP '1998-01-01' AS start_in_future,
           days IS NOT NULL AND b > TIMESTAMP '1998-01-01' AS end_in_future,
           CASE WHEN a IS NULL THEN concat('Cannot parse date: ', start_date)
                WHEN b IS NULL THEN concat('Cannot parse date: ', end_date)
                WHEN days < 0 THEN 'End date before start date'
                WHEN days > max_days THEN format('Range exceeds {} days', max_days) END AS error
    FROM u""")
def validate_date_range(q: Inputs):
    as_of = F.expr("TIMESTAMP_NTZ'1998-01-01 00:00:00'")
    return _opened(q.view("date_texts"),
                   validate.validate_date_range("start_date", "end_date", as_of, "max_days"), "id").fillna(
        0, ["days_difference"]).fillna(
        False, ["is_chronological", "within_max_days", "start_in_future", "end_in_future"])


# Financial.

_PERIODS = "CASE lower(<strip:period>) WHEN 'weekly' THEN 52 WHEN 'biweekly' THEN 26 WHEN 'semi-monthly' THEN 24 " \
           "WHEN 'monthly' THEN 12 WHEN 'quarterly' THEN 4 WHEN 'annual' THEN 1 END"


@query("annual_income", ["M1"], f"""
    SELECT applicant, lower(<strip:period>) AS period, coalesce({_PERIODS}, 0)::INT AS periods_per_year,
           amount * {_PERIODS} AS annual_income, amount * {_PERIODS} / 12 AS monthly_income,
           amount * {_PERIODS} / 52 AS weekly_income,
           CASE WHEN {_PERIODS} IS NULL THEN concat('Unknown pay period: ', period) END AS error FROM pay""")
def annual_income(q: Inputs):
    return _opened(q.view("pay"), finance.annual_income("amount", "period"), "applicant").fillna(
        0, ["periods_per_year"])


@query("debt_ratios", ["M2"], """
    WITH t AS (SELECT id, principal / 12 AS monthly_income, debts + tax + heating + condo * 0.5 AS housing_costs,
                      debts + tax + heating + condo * 0.5 + debts AS total_debts FROM loans),
         r AS (SELECT *, housing_costs / nullif(monthly_income, 0) * 100 AS g,
                      total_debts / nullif(monthly_income, 0) * 100 AS t FROM t)
    SELECT id, monthly_income, housing_costs, total_debts, round(g, 2) AS gds_ratio, round(t, 2) AS tds_ratio,
           coalesce(g <= 39, false) AS gds_qualified, coalesce(t <= 44, false) AS tds_qualified,
           coalesce(g <= 39 AND t <= 44, false) AS fully_qualified,
           CASE WHEN monthly_income = 0 THEN 'division by zero' END AS error FROM r""")
def debt_ratios(q: Inputs):
    return _opened(q.view("loans"),
                   finance.debt_ratios("principal", "debts", "tax", "heating", "condo", "debts"), "id").fillna(
        False, ["gds_qualified", "tds_qualified", "fully_qualified"])


_LTV = """CASE WHEN property_value > 0 THEN principal / nullif(property_value, 0) * 100 END"""


@query("loan_to_value", ["M3"], f"""
    WITH t AS (SELECT id, principal, property_value, property_value > 0 AS ok, {_LTV} AS ltv FROM loans),
         p AS (SELECT *, CASE WHEN NOT ok THEN NULL WHEN ltv > 95 THEN 4.0 WHEN ltv > 90 THEN 3.1 WHEN ltv > 85 THEN 2.8
                              WHEN ltv > 80 THEN 2.4 ELSE 0 END::DOUBLE AS rate FROM t)
    SELECT id, round(ltv, 2) AS ltv_ratio, CASE WHEN ok THEN property_value - principal END AS down_payment,
           CASE WHEN ok THEN round((1 - principal / nullif(property_value, 0)) * 100, 2) + 0 END AS down_payment_percent,
           coalesce(ltv > 80, false) AS needs_insurance, rate AS premium_rate, principal * (rate / 100) AS premium,
           CASE WHEN NOT ok THEN 'Property value must be > 0' END AS error FROM p""")
def loan_to_value(q: Inputs):
    rows = _opened(q.view("loans"), finance.loan_to_value("principal", "property_value"), "id")
    return rows.withColumns({"needs_insurance": F.coalesce("needs_insurance", F.lit(False))})


_PAYMENT = """
    f AS (SELECT *, CASE WHEN freq IN ('biweekly', 'weekly') THEN freq ELSE 'monthly' END AS known,
                 CASE WHEN principal <= 0 THEN 'Principal must be > 0' WHEN annual_rate < 0 OR annual_rate > 30
                      THEN 'Interest rate must be between 0-30%' END AS pay_error FROM loans),
    g AS (SELECT *, CASE known WHEN 'weekly' THEN 52 WHEN 'biweekly' THEN 26 ELSE 12 END AS per_year,
                 (pow(1 + annual_rate / 100 / 2, 1 / 6::DOUBLE) - 1)
                 / CASE known WHEN 'weekly' THEN 4.33333 WHEN 'biweekly' THEN 2.16667 ELSE 1.0 END::DOUBLE AS rate FROM f),
    h AS (SELECT *, years * per_year AS n, pow(1 + rate, years * per_year) AS growth FROM g),
    i AS (SELECT *, CASE WHEN pay_error IS NOT NULL THEN NULL WHEN rate = 0 THEN principal / n
                         ELSE principal * (rate * growth) / nullif(growth - 1, 0) END AS each FROM h),
    paid AS (SELECT *, CASE WHEN known = 'monthly' THEN each ELSE each * per_year / 12 END AS monthly FROM i)"""


@query("loan_payment", ["M4"], "WITH " + _PAYMENT + """
    SELECT id, known AS frequency, round(each, 2) AS payment, round(monthly, 2) AS monthly_payment,
           round(CASE WHEN known = 'biweekly' THEN each ELSE monthly * 12 / 26 END, 2) AS biweekly_payment,
           round(CASE WHEN known = 'weekly' THEN each ELSE monthly * 12 / 52 END, 2) AS weekly_payment,
           n AS total_payments, round(each * n, 2) AS total_paid, round(each * n - principal, 2) + 0 AS total_interest,
           round((each * n - principal) / nullif(principal, 0) * 100, 2) + 0 AS interest_percent, pay_error AS error
    FROM paid""")
def loan_payment(q: Inputs):
    rows = finance.with_payment(q.view("loans"), "principal", "annual_rate", "years", F.col("freq"))
    return rows.select("id", "payment.*")


_BOOK = "WITH " + _PAYMENT + f""",
    inc AS (SELECT applicant, amount * {_PERIODS} AS annual_income,
                   CASE WHEN {_PERIODS} IS NULL THEN concat('Unknown pay period: ', period) END AS inc_error FROM pay),
    j AS (SELECT p.*, annual_income, inc_error, round(monthly, 2) AS pay_m, {_LTV} AS ltv
          FROM paid p LEFT JOIN inc ON p.applicant = inc.applicant),
    k AS (SELECT *, (pay_m + tax + heating + condo * 0.5) / nullif(annual_income / 12, 0) * 100 AS gds,
                 (pay_m + tax + heating + condo * 0.5 + debts) / nullif(annual_income / 12, 0) * 100 AS tds FROM j),
    book AS (SELECT id, applicant, segment, principal, annual_income, pay_m AS monthly_payment,
                 round(gds, 2) AS gds_ratio, round(tds, 2) AS tds_ratio, coalesce(gds <= 39 AND tds <= 44, false) AS fully_qualified,
                 round(ltv, 2) AS ltv_ratio,
                 CASE WHEN property_value > 0 THEN principal * (CASE WHEN ltv > 95 THEN 4.0 WHEN ltv > 90 THEN 3.1
                      WHEN ltv > 85 THEN 2.8 WHEN ltv > 80 THEN 2.4 ELSE 0 END::DOUBLE / 100) END AS premium,
                 coalesce(inc_error, pay_error, CASE WHEN property_value <= 0 THEN 'Property value must be > 0' END,
                          CASE WHEN annual_income = 0 THEN 'division by zero' END) AS error FROM k)"""


@query("loan_book", ["M5"], _BOOK + " SELECT * FROM book")
def loan_book(q: Inputs):
    return books.loan_book(q.view("loans"), q.view("pay")).fillna(False, ["fully_qualified"])


@query("loan_segments", ["M5"], _BOOK + """
    SELECT segment, count(*) AS loans, count(*) FILTER (error IS NULL) AS sound_loans,
           count(*) FILTER (error IS NULL AND fully_qualified) AS qualified_loans,
           round(avg(ltv_ratio) FILTER (error IS NULL), 4) AS avg_ltv,
           round(avg(gds_ratio) FILTER (error IS NULL), 4) AS avg_gds FROM book GROUP BY segment""")
def loan_segments(q: Inputs):
    return books.loan_segments(books.loan_book(q.view("loans"), q.view("pay")))


@query("income_history", ["A13"], """
    WITH p AS (SELECT *, lag(amount) OVER (PARTITION BY applicant ORDER BY year) AS previous FROM t4),
         g AS (SELECT applicant, round(avg(amount), 2) AS average_income, round(sum(amount), 2) AS total_income,
                      round(min(amount), 2) AS min_income, round(max(amount), 2) AS max_income, count(*) AS years,
                      arg_max(amount, year) AS latest, arg_max(coalesce(previous, -1), year) AS previous
               FROM p GROUP BY applicant)
    SELECT applicant, average_income, total_income, min_income, max_income, years,
           CASE WHEN years = 1 THEN 0 ELSE round((latest - previous) / nullif(previous, 0) * 100, 2) END AS trend_percent,
           CASE WHEN years = 1 THEN 'single_year' WHEN previous = 0 THEN NULL WHEN latest > previous THEN 'increasing'
                WHEN latest < previous THEN 'decreasing' ELSE 'stable' END AS trend,
           CASE WHEN years > 1 AND previous = 0 THEN 'division by zero' END AS error FROM g""")
def income_history(q: Inputs):
    return books.income_history(q.view("t4"))


@query("income_trend", ["W7"], """
    WITH p AS (SELECT *, lag(amount) OVER (PARTITION BY applicant ORDER BY year) AS previous FROM t4)
    SELECT applicant, year, amount, previous, round((amount - previous) / nullif(previous, 0) * 100, 2) AS trend_percent,
           CASE WHEN previous IS NULL THEN 'single_year' WHEN previous = 0 THEN NULL WHEN amount > previous THEN 'increasing'
                WHEN amount < previous THEN 'decreasing' ELSE 'stable' END AS trend FROM p""")
def income_trend(q: Inputs):
    return books.income_trend(q.view("t4"))


@query("sql_rules", ["Q1"], f"""
    SELECT l.id, CASE WHEN property_value > 0 THEN round(principal / nullif(property_value, 0) * 100, 2) END AS ltv,
           coalesce({_PERIODS}, 0)::INT AS periods
    FROM loans l JOIN pay p ON l.applicant = p.applicant""")
def sql_rules(q: Inputs):
    register_sql_rules(q.spark)
    joined = q.view("loans").join(q.view("pay"), "applicant")
    return joined.selectExpr("id", "ltv_percent(principal, property_value) AS ltv",
                             "coalesce(pay_periods(period), 0) AS periods")
