"""Queries over documents, pages, uploads and merges."""

from pyspark.sql import functions as F

from leafmill.functions.text import last_line, page_number
from leafmill.operators import pages as ops, search
from leafmill.registry import Inputs, query


@query("text_stats", ["A9"], r"""
    SELECT doc_id, count(*) AS total_pages, sum(length(text))::BIGINT AS character_count,
           sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS word_count, sum(length(text)) > 0 AS has_text
    FROM doc_pages GROUP BY doc_id""")
def text_stats(q: Inputs):
    return ops.text_stats(q.view("doc_pages"))


@query("page_stats", ["A10"], """
    SELECT doc_id, count(*) AS total_pages, sum(length(text))::BIGINT AS total_characters,
           count(*) FILTER (length(text) > 0) AS pages_with_text, max(length(text))::INT AS longest_page
    FROM doc_pages GROUP BY doc_id""")
def page_stats(q: Inputs):
    return ops.page_stats(q.view("doc_pages"))


@query("pages_with_text", ["F13", "A10"], """
    SELECT doc_id, page_num, text FROM doc_pages WHERE length(text) > 0""")
def pages_with_text(q: Inputs):
    return ops.pages_with_text(q.view("doc_pages"))


@query("count_pages", ["A11"], """
    SELECT doc_id, split_part(string_split(path, '/')[-1], '?', 1) AS file_name, length AS file_size, page_count
    FROM files JOIN (SELECT doc_id, count(*) AS page_count FROM doc_pages GROUP BY doc_id) USING (doc_id)""")
def count_pages(q: Inputs):
    return ops.count_pages(q.view("doc_pages"), q.view("files"))


@query("extract_page", ["F10"], """
    WITH t AS (SELECT doc_id, max(page_num) AS total_pages FROM doc_pages GROUP BY doc_id)
    SELECT r.request_id, r.doc_id, r.page_number, coalesce(t.total_pages, 0) AS total_pages, p.text,
           coalesce(r.page_number <= t.total_pages, false) AS ok,
           CASE WHEN t.total_pages IS NULL THEN 'Unknown document' WHEN r.page_number > t.total_pages
                THEN format('Page {} out of range (1-{})', r.page_number, t.total_pages) END AS error
    FROM page_requests r LEFT JOIN t ON r.doc_id = t.doc_id
    LEFT JOIN doc_pages p ON p.doc_id = r.doc_id AND p.page_num = r.page_number""")
def extract_page(q: Inputs):
    return ops.extract_page(q.view("doc_pages"), q.view("page_requests")).fillna(0, ["total_pages"])


@query("drop_blank_pages", ["F11"], """
    SELECT p.doc_id, p.page_num, p.text FROM doc_pages p JOIN page_features f
        ON p.doc_id = f.doc_id AND p.page_num = f.page_num WHERE NOT f.is_blank""")
def drop_blank_pages(q: Inputs):
    return ops.drop_blank_pages(q.view("doc_pages"), q.view("page_features").filter("is_blank"))


@query("rotate_pages", ["F14"], """
    WITH t AS (SELECT doc_id, max(page_num) AS total_pages FROM doc_pages GROUP BY doc_id),
         c AS (SELECT r.doc_id, page_number, degrees,
                      CASE WHEN total_pages IS NULL THEN 'Unknown document' WHEN degrees = 45 THEN 'Invalid rotation 45'
                           WHEN page_number > total_pages
                           THEN format('Page {} out of range (1-{})', page_number, total_pages) END AS error
               FROM page_requests r LEFT JOIN t ON r.doc_id = t.doc_id),
         g AS (SELECT doc_id, page_number, (sum(degrees) % 360 + 360) % 360 AS turn FROM c WHERE error IS NULL GROUP BY ALL),
         e AS (SELECT doc_id, min(error) AS error FROM c GROUP BY doc_id)
    SELECT p.doc_id, p.page_num, coalesce(turn, 0)::INT AS rotation, error
    FROM doc_pages p LEFT JOIN e ON p.doc_id = e.doc_id LEFT JOIN g ON p.doc_id = g.doc_id AND p.page_num = g.page_number
    UNION ALL SELECT doc_id, 0, 0, error FROM e WHERE doc_id NOT IN (SELECT doc_id FROM t)""")
def rotate_pages(q: Inputs):
    return ops.rotate_pages(q.view("doc_pages"), q.view("page_requests")).fillna(0, ["page_num"])


_SPLITS = r"""
    WITH t AS (SELECT doc_id, max(page_num) AS total_pages FROM doc_pages GROUP BY doc_id),
         q AS (SELECT r.request_id, r.doc_id, r.ranges, t.total_pages FROM page_requests r LEFT JOIN t ON r.doc_id = t.doc_id),
         i AS (SELECT request_id, doc_id, total_pages, unnest(string_split(ranges, ',')) AS piece,
                      unnest(range(1, len(string_split(ranges, ',')) + 1)) AS part FROM q),
         x AS (SELECT *, <strip:piece> AS label FROM i),
         y AS (SELECT *, try_cast(split_part(label, '-', 1) AS INT) AS a,
                      try_cast(CASE WHEN contains(label, '-') THEN split_part(label, '-', 2) ELSE label END AS INT) AS b
               FROM x),
         z AS (SELECT *, coalesce(a >= 1 AND b <= total_pages AND a <= b, false) AS valid FROM y),
         bad AS (SELECT request_id, doc_id, total_pages, arg_min(label, part) AS label FROM z WHERE NOT valid GROUP BY ALL),
         good AS (SELECT * FROM z WHERE request_id NOT IN (SELECT request_id FROM bad))"""


@query("plan_splits", ["J7"], _SPLITS + """
    SELECT request_id, doc_id, total_pages, part::INT AS part, a AS first_page, b AS last_page, b - a + 1 AS page_count,
           NULL AS error FROM good
    UNION ALL SELECT request_id, doc_id, coalesce(total_pages, 0), 0, 0, 0, 0, CASE WHEN total_pages IS NULL THEN 'Unknown document'
           ELSE format('Invalid range {} (total pages: {})', label, total_pages) END FROM bad""")
def plan_splits(q: Inputs):
    return ops.plan_splits(q.view("page_requests"), q.view("doc_pages")).fillna(
        0, ["total_pages", "part", "first_page", "last_page", "page_count"])


@query("split_pages", ["J7"], _SPLITS + """
    SELECT request_id, p.doc_id, part::INT AS part, p.page_num, p.page_num - a + 1 AS position, p.text
    FROM good JOIN doc_pages p ON p.doc_id = good.doc_id AND p.page_num BETWEEN a AND b""")
def split_pages(q: Inputs):
    return ops.split_pages(q.view("page_requests"), q.view("doc_pages"))


@query("merge_files", ["A12"], """
    SELECT merge_id, file_no, page_count, file_size,
           row_number() OVER (PARTITION BY merge_id ORDER BY file_no) AS file_number FROM merge_parts""")
def merge_files(q: Inputs):
    return ops.merge_files(q.view("merge_parts"))


@query("merge_summary", ["A12"], """
    SELECT merge_id, count(*) AS files_merged, sum(page_count)::BIGINT AS total_pages,
           sum(file_size)::BIGINT AS total_size, count(*) >= 2 AS ok,
           CASE WHEN count(*) < 2 THEN 'Only one file (nothing to merge)' END AS error
    FROM merge_parts GROUP BY merge_id""")
def merge_summary(q: Inputs):
    return ops.merge_summary(q.view("merge_parts"))


@query("merge_pages", ["U1"], """
    SELECT merge_id, file_no, page_num, row_number() OVER (PARTITION BY merge_id ORDER BY file_no, page_num)
           AS merged_page
    FROM (SELECT merge_id, file_no, unnest(range(1, page_count + 1))::INT AS page_num FROM merge_parts)""")
def merge_pages(q: Inputs):
    return ops.merge_pages(q.view("merge_parts"))


@query("expired_objects", ["S3"], """
    SELECT seq, url AS path FROM request_log
    WHERE ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 168 HOUR""")
def expired_objects(q: Inputs):
    files = q.view("request_log").select("seq", F.col("url").alias("path"), F.col("ts").alias("modificationTime"))
    as_of = F.expr("TIMESTAMP_NTZ'2024-01-31 00:00:00'")
    return ops.expired_objects(files, as_of, 168).drop("modificationTime")


@query("admit_uploads", ["S4"], """
    SELECT session_id, doc_id, file_name, reason, reason IS NULL AS accepted FROM (
        SELECT *, CASE WHEN count(*) OVER (PARTITION BY session_id) > 50 THEN 'Maximum 50 files allowed'
                       WHEN mode = 'unknown' THEN 'Invalid mode'
                       WHEN NOT suffix(file_name, '.pdf') THEN 'Not a .pdf name' END AS reason
        FROM (SELECT *, split_part(string_split(path, '/')[-1], '?', 1) AS file_name FROM files))""")
def admit_uploads(q: Inputs):
    return ops.admit_uploads(q.view("files")).select("session_id", "doc_id", "file_name", "reason", "accepted")


_FOOTERS = [r"page\s+(\d+)\s+of\s+(\d+)", r"page\s+(\d+)\s*/\s*(\d+)", r"(\d+)\s+of\s+(\d+)", r"(\d+)\s*/\s*(\d+)"]


def _footer(group: int) -> str:
    arms = " ".join(f"WHEN regexp_matches(low, '{p}') THEN regexp_extract(low, '{p}', {group})" for p in _FOOTERS)
    return f"try_cast(CASE {arms} END AS INT)"


@query("page_numbers", ["P3"], f"""
    WITH f AS (SELECT doc_id, page_num, lower(string_split(text, chr(10))[-1]) AS low FROM triage_pages)
    SELECT doc_id, page_num, coalesce({_footer(1)}, 0) AS current, coalesce({_footer(2)}, 0) AS total,
           coalesce({_footer(1)} = 1, false) AS is_page_one
    FROM f""")
def page_numbers(q: Inputs):
    return q.view("triage_pages").select("doc_id", "page_num", page_number(last_line("text")).alias("n")).select(
        "doc_id", "page_num", "n.current", "n.total", "n.is_page_one").fillna(0, ["current", "total"])


SEARCH = r"tion[ ,.]"


@query("search_text", ["P7"], r"""
    WITH g AS (SELECT doc_id, page_num, text, regexp_extract_all(text, '(?i)tion[ ,.]') AS m,
                      string_split_regex(text, '(?i)tion[ ,.]') AS gaps FROM doc_pages),
         e AS (SELECT doc_id, page_num, text, unnest(m) AS matched_text, unnest(gaps[1:len(m)]) AS gap,
                      unnest(range(1, len(m) + 1)) AS i FROM g),
         s AS (SELECT *, (sum(length(gap) + length(matched_text)) OVER (PARTITION BY doc_id, page_num ORDER BY i)
                      - length(matched_text))::INT AS position FROM e)
    SELECT doc_id, page_num, matched_text, position,
           replace(substring(text, greatest(position - 50, 0) + 1,
                             position + length(matched_text) + 50 - greatest(position - 50, 0)), chr(10), ' ') AS context
    FROM s""")
def search_text(q: Inputs):
    return search.search_text(q.view("doc_pages"), SEARCH).drop("error")


@query("search_zero_width", ["P7"], r"""
    WITH g AS (SELECT doc_id, page_num, text, regexp_extract_all(text, '(?i)(?:tion)+') AS m,
                      string_split_regex(text, '(?i)(?:tion)+') AS gaps FROM chat_pages),
         e AS (SELECT doc_id, page_num, unnest(m) AS matched_text, unnest(gaps[1:len(m)]) AS gap,
                      unnest(range(1, len(m) + 1)) AS i FROM g)
    SELECT doc_id, page_num, matched_text, (sum(length(gap) + length(matched_text))
           OVER (PARTITION BY doc_id, page_num ORDER BY i) - length(matched_text))::INT AS position FROM e
    UNION ALL SELECT doc_id, page_num, '', 0 FROM chat_pages WHERE NOT regexp_matches(text, '^(?i)tion')""")
def search_zero_width(q: Inputs):
    # This pattern also matches the empty string; the full matches and those at the start are shown.
    found = search.search_text(q.view("chat_pages"), "(?:tion)*")
    return found.filter("matched_text <> '' OR position = 0").drop("context", "error")


@query("search_text_errors", ["P7"], r"""
    SELECT 'tion[.]' AS pattern, count(*) AS row_count, NULL AS error
    FROM (SELECT unnest(regexp_extract_all(text, '(?i)tion[.]')) FROM doc_pages)
    UNION ALL SELECT '(open', 1, 'Invalid pattern: (open'""")
def search_text_errors(q: Inputs):
    parts = [search.search_text(q.view("doc_pages"), p).withColumn("pattern", F.lit(p)) for p in ("tion[.]", "(open")]
    return parts[0].unionByName(parts[1]).groupBy("pattern").agg(F.count(F.lit(1)).alias("row_count"), F.max("error").alias("error"))


@query("search_summary", ["A24"], r"""
    SELECT doc_id, sum(n)::BIGINT AS total_matches, count(*) FILTER (n > 0) AS pages_with_matches,
           count(*) AS total_pages
    FROM (SELECT doc_id, len(regexp_extract_all(text, '(?i)tion[ ,.]')) AS n FROM doc_pages) GROUP BY doc_id""")
def search_summary(q: Inputs):
    return search.search_summary(q.view("doc_pages"), SEARCH)


_URLS = r"""
    WITH tx AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, 'https?://[!$-_a-z]+')) AS url FROM web_texts),
         lk AS (SELECT DISTINCT doc_id, CASE WHEN href[1] = '/' THEN concat(site, href) ELSE href END AS url
                FROM (SELECT page_id AS doc_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS site,
                             unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)),
         u AS (SELECT doc_id, url, bool_or(t) AS in_text, bool_or(NOT t) AS in_links
               FROM (SELECT *, true AS t FROM tx UNION ALL SELECT *, false FROM lk) GROUP BY doc_id, url)"""


def _doc_urls(q: Inputs):
    return search.doc_urls(search.extract_urls(q.view("web_texts")), search.extract_links(q.table("pages")))


@query("extract_urls", ["P8"], _URLS + "SELECT * FROM tx")
def extract_urls(q: Inputs):
    return search.extract_urls(q.view("web_texts"))


@query("doc_urls", ["A28", "U2", "T3"], _URLS + "SELECT * FROM u")
def doc_urls(q: Inputs):
    return _doc_urls(q)


@query("doc_url_counts", ["A28"], _URLS + """
    SELECT doc_id, count(*) AS url_count, count(*) FILTER (in_text) AS from_text,
           count(*) FILTER (in_links) AS from_links, min(url) AS first_url, max(url) AS last_url
    FROM u GROUP BY doc_id""")
def doc_url_counts(q: Inputs):
    return search.doc_url_counts(_doc_urls(q))


_TABLES = r"""
    WITH s AS (SELECT doc_id, page_num, line_no, <strip:text> AS row FROM table_pages),
         k AS (SELECT *, len(string_split_regex(row, '\s{2,}|\t')) AS columns FROM s
               WHERE regexp_matches(row, '\s{2,}|\t')
                  OR (len(regexp_extract_all(row, '\d+')) >= 2 AND regexp_matches(row, '[|,;]'))),
         b AS (SELECT *, CASE WHEN abs(columns - lag(columns) OVER w) <= 1 THEN 0 ELSE 1 END AS brk FROM k
               WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY line_no)),
         r AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page_num ORDER BY line_no) AS run FROM b),
         c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_num, run) AS row_count FROM r),
         t AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page_num ORDER BY run) AS table_number
               FROM c WHERE row_count >= 2)"""


@query("table_rows", ["W3"], _TABLES + """
    SELECT doc_id, page_num, line_no, row, columns::INT AS columns, row_count, table_number FROM t""")
def table_rows(q: Inputs):
    return search.table_rows(q.view("table_pages"))


@query("table_blocks", ["W3"], _TABLES + """
    SELECT doc_id, page_num, table_number, count(*) AS row_count, min(line_no) AS first_line,
           max(line_no) AS last_line, max(columns)::INT AS widest FROM t GROUP BY doc_id, page_num, table_number""")
def table_blocks(q: Inputs):
    return search.table_blocks(q.view("table_pages"))
