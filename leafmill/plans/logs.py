"""Queries over console and network capture."""

import pyarrow as pa
from pyspark.sql import functions as F

from leafmill.functions.common import stamp
from leafmill.operators import logs as console, reports, requests as network, rule_tables
from leafmill.registry import Inputs, query


def _any(name: str) -> str:
    tests = [f"WHEN regexp_matches(lower(text), '{p}') THEN '{p}'" for p in console.ISSUE_PATTERNS[name]]
    return f"SELECT *, '{name}' AS category, CASE {' '.join(tests)} END AS pattern FROM console_logs"


_HITS = "WITH hits AS (SELECT * FROM (" + " UNION ALL ".join(map(_any, console.ISSUE_PATTERNS)) + \
    ") WHERE pattern IS NOT NULL) "
_SEVERITY = "CASE WHEN category IN ('javascript', 'security') THEN 'high' ELSE 'medium' END AS severity"


def _issue_rules(q: Inputs):
    """The fixed patterns as a rule table for all tenants."""
    rules = [(c, p) for c, patterns in console.ISSUE_PATTERNS.items() for p in patterns]
    table = pa.table({"category": [c for c, _ in rules], "rank": list(range(len(rules))), "pattern": [p for _, p in rules]})
    return q.spark.createDataFrame(table).withColumn("tenant", F.lit(None).cast("string"))


@query("log_issues_by_rules", ["A8", "W5"], _HITS + "SELECT seq, category, pattern FROM hits")
def log_issues_by_rules(q: Inputs):
    return rule_tables.first_matches(rule_tables.rule_matches(q.view("console_logs"), _issue_rules(q), "seq"), "seq")


@query("tenant_rule_hits", ["A8", "W5"], """
    SELECT seq, category, arg_min(pattern, rank) AS pattern
    FROM console_logs l JOIN tenant_rules r ON l.session_id % 50 = r.tenant AND regexp_matches(lower(l.text), r.pattern) GROUP BY seq, category""")
def tenant_rule_hits(q: Inputs):
    logs = q.view("console_logs").withColumn("tenant", F.col("session_id") % 50)
    return rule_tables.first_matches(rule_tables.rule_matches(logs, rule_tables.lowest_ranks(q.view("tenant_rules")), "seq", tenant="tenant"), "seq")


@query("log_errors", ["F4"], """
    SELECT seq, session_id, type, text FROM console_logs WHERE type IN ('error', 'pageerror')""")
def log_errors(q: Inputs):
    return console.log_errors(q.view("console_logs")).drop("ts")


@query("log_error_counts", ["F4"], """
    SELECT session_id, count(*) FILTER (type IN ('error', 'pageerror', 'warning')) AS error_count,
           count(*) FILTER (type IN ('error', 'pageerror', 'warning')) > 0 AS has_errors
    FROM console_logs GROUP BY session_id""")
def log_error_counts(q: Inputs):
    return console.error_counts(q.view("console_logs"), "session_id", include_warnings=True)


@query("logs_by_type", ["F5"], "SELECT seq, session_id, type, text FROM console_logs WHERE type = 'warning'")
def logs_by_type(q: Inputs):
    return console.logs_by_type(q.view("console_logs"), "warning").drop("ts")


@query("log_type_counts", ["F5"], """
    SELECT type, count(*) AS by_type, type = 'warning' AS selected FROM console_logs GROUP BY type""")
def log_type_counts(q: Inputs):
    return console.type_counts(q.view("console_logs"), "warning")


@query("search_logs", ["F6"], """
    SELECT seq, session_id, type, text FROM console_logs WHERE contains(lower(text), '100%_d')""")
def search_logs(q: Inputs):
    return console.search_logs(q.view("console_logs"), "100%_D").drop("ts")


@query("search_requests", ["F6"], """
    SELECT seq, url, method FROM request_log WHERE contains(lower(url), '/items/1')""")
def search_requests(q: Inputs):
    return network.search_requests(q.view("request_log"), "/ITEMS/1").select("seq", "url", "method")


@query("log_issues", ["A8", "W5"], _HITS + f"""
    SELECT category, count(*) AS issue_count, {_SEVERITY} FROM hits GROUP BY category""")
def log_issues(q: Inputs):
    return console.log_issues(q.view("console_logs"))


@query("session_log_issues", ["A8"], _HITS + f"""
    SELECT session_id, category, count(*) AS issue_count, {_SEVERITY} FROM hits GROUP BY session_id, category""")
def session_log_issues(q: Inputs):
    return console.log_issues(q.view("console_logs"), "session_id")


@query("issue_examples", ["A8", "W12"], _HITS + """
    SELECT category, row_number() OVER (PARTITION BY category ORDER BY seq)::INT AS rank, seq, pattern, type,
           text[1:200] AS message
    FROM hits QUALIFY row_number() OVER (PARTITION BY category ORDER BY seq) <= 5""")
def issue_examples(q: Inputs):
    return console.issue_examples(q.view("console_logs"))


_FAILED = """
    WITH failed AS (SELECT *, CASE WHEN status = 'failed' THEN 'network_failure' ELSE 'http_error' END AS failure
                    FROM request_log WHERE status = 'failed' OR response_status >= 400)"""


@query("failed_requests", ["F7"], _FAILED + """
    SELECT seq, url, method, failure,
           CASE WHEN status = 'failed' THEN coalesce(failure_text, 'Unknown') END AS error,
           coalesce(CASE WHEN status <> 'failed' THEN response_status END, 0) AS http_status FROM failed""")
def failed_requests(q: Inputs):
    return network.failed_requests(q.view("request_log")).select(
        "seq", "url", "method", "failure", "error", F.coalesce("http_status", F.lit(0)).alias("http_status"))


@query("requests_filtered", ["F8"], """
    SELECT seq, url, method, resource_type, status FROM request_log
    WHERE resource_type = 'fetch' AND status = 'completed'""")
def requests_filtered(q: Inputs):
    return network.requests_filtered(q.view("request_log"), "fetch", "completed").select(
        "seq", "url", "method", "resource_type", "status")


@query("request_stats", ["A7"], """
    WITH c AS (SELECT resource_type, CASE WHEN coalesce(response_status, 0) = 0 THEN 'pending'
                   WHEN response_status < 300 THEN '2xx' WHEN response_status < 400 THEN '3xx'
                   WHEN response_status < 500 THEN '4xx' ELSE '5xx' END AS class FROM request_log)
    SELECT 'resource_type' AS dimension, resource_type AS value, count(*) AS requests FROM c GROUP BY 2
    UNION ALL SELECT 'status_class', class, count(*) FROM c GROUP BY 2""")
def request_stats(q: Inputs):
    return network.request_stats(q.view("request_log"))


_LAST = """
    WITH last AS (SELECT * FROM responses QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC, seq DESC) = 1)"""


@query("requests_last_response", ["J2"], _LAST + """
    SELECT r.seq, r.url, r.method, coalesce(l.status, 0) AS har_status, l.status_text AS resp_status_text
    FROM request_log r LEFT JOIN last l ON r.url = l.url""")
def requests_last_response(q: Inputs):
    return network.requests_last_response(q.view("request_log"), q.view("responses")).select(
        "seq", "url", "method", "har_status", "resp_status_text")


@query("api_calls", ["J3"], _LAST + """
    SELECT r.seq, r.method, r.url, coalesce(l.status::VARCHAR, r.response_status::VARCHAR, 'pending') AS status,
           CASE WHEN l.url IS NOT NULL THEN l.ok ELSE r.status = 'completed' END AS ok
    FROM request_log r LEFT JOIN last l ON r.url = l.url WHERE contains(r.url, '/api')""")
def api_calls(q: Inputs):
    return network.api_calls(q.view("request_log"), q.view("responses")).drop("ts")


@query("api_call_totals", ["J3"], _LAST + """
    SELECT count(*) AS calls,
           count(*) FILTER (NOT CASE WHEN l.url IS NOT NULL THEN l.ok ELSE r.status = 'completed' END) AS failed
    FROM request_log r LEFT JOIN last l ON r.url = l.url WHERE contains(r.url, '/api')""")
def api_call_totals(q: Inputs):
    calls = network.api_calls(q.view("request_log"), q.view("responses"))
    return calls.agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(~F.col("ok"), 1)).alias("failed"))


FIFO_ORACLE = """
    WITH ev AS (SELECT url, ts, seq, 0 AS done, NULL AS kind, NULL::INT AS code FROM requests_sent
                UNION ALL SELECT url, ts, seq, 1, kind, status FROM completions),
         s AS (SELECT *, sum(done) OVER w AS c, sum(1 - done) OVER w AS r FROM ev
               WINDOW w AS (PARTITION BY url ORDER BY ts, seq)),
         d AS (SELECT *, greatest(0, max(c - r) OVER (PARTITION BY url ORDER BY ts, seq)) AS d FROM s),
         k AS (SELECT *, d > coalesce(lag(d) OVER (PARTITION BY url ORDER BY ts, seq), 0) AS ignored FROM d)
    SELECT q.seq, q.url, coalesce(x.seq, -1) AS completion_seq,
           CASE WHEN x.seq IS NULL THEN 'pending' WHEN x.kind = 'failed' THEN 'failed' ELSE 'completed' END AS status,
           coalesce(x.code, 0) AS response_status
    FROM (SELECT * FROM k WHERE done = 0) q
    LEFT JOIN (SELECT * FROM k WHERE done = 1 AND NOT ignored) x ON q.url = x.url AND q.r = x.c - x.d"""


@query("match_requests_fifo", ["J4", "X4"], FIFO_ORACLE)
def match_requests_fifo(q: Inputs):
    rows = network.match_requests_fifo(q.view("requests_sent"), q.view("completions"))
    return rows.select("seq", "url", F.coalesce("completion_seq", F.lit(-1)).alias("completion_seq"), "status",
                       F.coalesce("response_status", F.lit(0)).alias("response_status"))


_CLASS = "coalesce(response_status, 0)"


@query("debug_report", ["A25"], f"""
    SELECT session_id, n_err AS console_errors, n_failed AS failed_requests, total AS total_requests,
           status_pending, status_2xx, status_3xx, status_4xx, status_5xx, has_critical,
           n_err + n_failed > 0 AS has_issues
    FROM (SELECT session_id, count(*) FILTER (type IN ('error', 'pageerror', 'warning')) AS n_err,
                 bool_or(regexp_matches(lower(text), '{"|".join(
                     console.ISSUE_PATTERNS["javascript"] + console.ISSUE_PATTERNS["security"])}')) AS has_critical
          FROM console_logs GROUP BY session_id)
    JOIN (SELECT user_id AS session_id, count(*) FILTER (status = 'failed' OR response_status >= 400) AS n_failed,
                 count(*) AS total, count(*) FILTER ({_CLASS} = 0) AS status_pending,
                 count(*) FILTER ({_CLASS} BETWEEN 1 AND 299) AS status_2xx,
                 count(*) FILTER ({_CLASS} BETWEEN 300 AND 399) AS status_3xx,
                 count(*) FILTER ({_CLASS} BETWEEN 400 AND 499) AS status_4xx,
                 count(*) FILTER ({_CLASS} >= 500) AS status_5xx
          FROM request_log GROUP BY user_id) USING (session_id)""")
def debug_report(q: Inputs):
    return reports.debug_report(q.view("console_logs"), _session_requests(q), "session_id")


def _session_requests(q: Inputs):
    return q.view("request_log").withColumnRenamed("user_id", "session_id")


_CAUSES = """
    WITH e AS (SELECT session_id, 1 AS source, seq AS no, lower(text) AS low, text[1:200] AS evidence FROM console_logs
               WHERE type IN ('error', 'pageerror')
               QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq) <= 5),
         f AS (SELECT user_id AS session_id, 2 AS source, seq AS no, url, status, failure_text,
                      CASE WHEN status = 'failed' THEN 0 ELSE response_status END AS code FROM request_log
               WHERE status = 'failed' OR response_status >= 400
               QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq) <= 5),
         h AS (SELECT session_id, source, no, CASE WHEN regexp_matches(low, 'undefined|null') THEN 'null_reference'
                      WHEN regexp_matches(low, 'network|fetch|cors') THEN 'network_error'
                      WHEN regexp_matches(low, 'react|hook') THEN 'react_error' END AS type, evidence, 0 AS code FROM e
               UNION ALL
               SELECT session_id, source, no, CASE WHEN code = 404 THEN 'missing_resource'
                      WHEN code >= 500 THEN 'server_error' WHEN status = 'failed' THEN 'network_failure' END,
                      CASE WHEN status = 'failed' THEN concat('URL: ', url, ', Error: ', coalesce(failure_text, 'Unknown'))
                           ELSE concat('URL: ', url) END, code FROM f),
         causes AS (SELECT session_id, type, evidence, source, no,
                      CASE type WHEN 'missing_resource' THEN 0.9 WHEN 'server_error' THEN 0.85
                           WHEN 'network_error' THEN 0.85 WHEN 'react_error' THEN 0.75 ELSE 0.8 END::DOUBLE AS confidence,
                      CASE type WHEN 'null_reference' THEN 'A value that is not set was used'
                           WHEN 'network_error' THEN 'The network or an origin rule stopped a call'
                           WHEN 'react_error' THEN 'A component broke its update rules'
                           WHEN 'missing_resource' THEN 'The address has nothing to give (404)'
                           WHEN 'server_error' THEN format('The server gave up ({})', code)
                           ELSE 'The connection broke' END AS description,
                      CASE type WHEN 'null_reference' THEN 'Test the value before its use'
                           WHEN 'network_error' THEN 'Check the address and the origins it allows'
                           WHEN 'react_error' THEN 'Check when the component changes its state'
                           WHEN 'missing_resource' THEN 'Correct the path or restore the resource'
                           WHEN 'server_error' THEN 'Read the server log of that time'
                           ELSE 'Check that the server can be reached' END AS suggestion
               FROM h WHERE type IS NOT NULL),
         ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY confidence DESC, source, no)::INT
                    AS rank FROM causes)"""


@query("bug_hypotheses", ["C9", "T2", "W12"], _CAUSES + """
    SELECT session_id, rank, type, confidence, description, suggestion, evidence FROM ranked""")
def bug_hypotheses(q: Inputs):
    return reports.bug_hypotheses(q.view("console_logs"), _session_requests(q))


@query("har_entries", ["S8", "J2"], _LAST + r"""
    SELECT r.seq, to_json({
        'startedDateTime': strftime(r.ts, '%Y-%m-%d %H:%M:%S.%f'),
        'request': {'method': r.method, 'url': r.url,
                    'headers': [{'name': 'accept', 'value': '*/*'}, {'name': 'x-type', 'value': r.resource_type}],
                    'postData': CASE WHEN r.post_data IS NOT NULL THEN {'text': r.post_data} END},
        'response': {'status': coalesce(l.status, 0), 'statusText': coalesce(l.status_text, ''), 'headers': []::VARCHAR[]},
        'cache': MAP {}, 'timings': {'send': 0, 'wait': 0, 'receive': 0}})::VARCHAR AS entry
    FROM request_log r LEFT JOIN last l ON r.url = l.url""")
def har_entries(q: Inputs):
    headers = F.create_map(F.lit("accept"), F.lit("*/*"), F.lit("x-type"), F.col("resource_type"))
    return network.har_entries(q.view("request_log").withColumn("headers", headers), q.view("responses"))


@query("export_report", ["S9"], _CAUSES + """,
         er AS (SELECT session_id, string_agg(concat('- `', type, '`: ', text[1:150]), chr(10) ORDER BY seq) AS part FROM (
                    SELECT * FROM console_logs WHERE type IN ('error', 'pageerror', 'warning')
                    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq) <= 10) GROUP BY session_id),
         fr AS (SELECT user_id AS session_id, string_agg(concat('- `', method, ' ', url, '` - ',
                       CASE WHEN status = 'failed' THEN coalesce(failure_text, 'Unknown')
                            ELSE response_status::VARCHAR END), chr(10) ORDER BY seq) AS part FROM (
                    SELECT * FROM request_log WHERE status = 'failed' OR response_status >= 400
                    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq) <= 10) GROUP BY user_id),
         ca AS (SELECT session_id, string_agg(concat('- **', type, '** (', round(confidence * 100)::INT, '%): ',
                       description, '. ', suggestion, '.'), chr(10) ORDER BY rank) AS part,
                       min(concat('- **', type, '** (', round(confidence * 100)::INT, '%): ', description, '. ', suggestion, '.')) FILTER (rank = 1) AS lead FROM ranked WHERE rank <= 5 GROUP BY session_id),
         n AS (SELECT session_id, count(*) FILTER (type IN ('error', 'pageerror', 'warning')) AS ne
               FROM console_logs GROUP BY session_id),
         m AS (SELECT user_id AS session_id, count(*) FILTER (status = 'failed' OR response_status >= 400) AS nf
               FROM request_log GROUP BY user_id)
    SELECT session_id, concat('# Nightly', chr(10), chr(10), 'All sessions of the night', chr(10), chr(10), '## Likeliest cause', chr(10), chr(10),
           coalesce(ca.lead, '- none found'), chr(10), chr(10), '## Messages on the console: ', ne,
           chr(10), chr(10), er.part, chr(10), chr(10), '## Requests without success: ', nf, chr(10), chr(10),
           fr.part, chr(10), chr(10), '## Causes', chr(10), chr(10), ca.part) AS report
    FROM n JOIN m USING (session_id) LEFT JOIN er USING (session_id) LEFT JOIN fr USING (session_id)
    LEFT JOIN ca USING (session_id)""")
def export_report(q: Inputs):
    return reports.export_report(q.view("console_logs"), _session_requests(q), "Nightly", description="All sessions of the night")


@query("log_issue_windows", ["X3"], _HITS + f"""
    SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, category,
           count(*) AS issue_count, {_SEVERITY} FROM hits GROUP BY 1, category""")
def log_issue_windows(q: Inputs):
    rows = console.windowed_issues(q.view("console_logs"))
    return rows.withColumn("window_start", stamp("window_start"))
