"""Queries over the catalog, settings and code lists."""

from pyspark.sql import functions as F

from leafmill.operators import catalog as ops
from leafmill.registry import Inputs, query


@query("executions_with_category", ["J1"], """
    SELECT e.id, e.tool_name, coalesce(c.category, 'unknown') AS category,
           coalesce(c.subcategory, 'unknown') AS subcategory
    FROM tool_executions e LEFT JOIN tool_catalog c ON e.tool_name = c.tool_name""")
def executions_with_category(q: Inputs):
    return ops.with_category(q.view("tool_executions"), q.view("tool_catalog")).select(
        "id", "tool_name", "category", "subcategory")


@query("calls_by_category", ["J1"], """
    SELECT coalesce(c.category, 'unknown') AS category, coalesce(c.subcategory, 'unknown') AS subcategory,
           count(*) AS calls, count(*) FILTER (e.success) AS successes
    FROM tool_executions e LEFT JOIN tool_catalog c ON e.tool_name = c.tool_name GROUP BY 1, 2""")
def calls_by_category(q: Inputs):
    return ops.calls_by_category(q.view("tool_executions"), q.view("tool_catalog"))


@query("category_rollup", ["A6"], """
    SELECT category, subcategory,
           CASE grouping_id(category, subcategory) WHEN 0 THEN 'subcategory' WHEN 1 THEN 'category'
                ELSE 'total' END AS level, count(*) AS tools
    FROM tool_catalog WHERE category IS NOT NULL GROUP BY ROLLUP (category, subcategory)""")
def category_rollup(q: Inputs):
    return ops.category_rollup(q.view("tool_catalog"))


@query("catalog_search", ["F9"], """
    SELECT tool_name, category, subcategory, short_description, description FROM tool_catalog
    WHERE category = 'economy'
      AND (contains(lower(tool_name), 'red') OR contains(lower(short_description), 'red')
           OR contains(lower(description), 'red'))""")
def catalog_search(q: Inputs):
    return ops.catalog_search(q.view("tool_catalog"), category="economy", text="RED")


@query("load_settings", ["S7"], """
    SELECT tenant,
           coalesce(try_cast(max(svalue) FILTER (skey = 'blank_page_variance_threshold') AS DOUBLE), 100.0::DOUBLE)
               AS blank_page_variance_threshold,
           coalesce(try_cast(max(svalue) FILTER (skey = 'blank_page_density_threshold') AS DOUBLE), 0.02::DOUBLE)
               AS blank_page_density_threshold,
           coalesce(try_cast(max(svalue) FILTER (skey = 'default_pdf_dpi') AS INT), 150) AS default_pdf_dpi,
           coalesce(try_cast(max(svalue) FILTER (skey = 'max_file_size_mb') AS INT), 50) AS max_file_size_mb,
           coalesce(try_cast(max(svalue) FILTER (skey = 'temp_file_cleanup_hours') AS INT), 24)
               AS temp_file_cleanup_hours
    FROM tenant_settings GROUP BY tenant""")
def load_settings(q: Inputs):
    return ops.load_settings(q.view("tenant_settings"), "tenant")


@query("reconcile_tools", ["U3"], """
    SELECT tool_name, 'missing' AS side FROM
        (SELECT tool_name FROM tool_catalog EXCEPT SELECT tool_name FROM tool_executions)
    UNION ALL SELECT tool_name, 'extra' AS side FROM
        (SELECT tool_name FROM tool_executions EXCEPT SELECT tool_name FROM tool_catalog)""")
def reconcile_tools(q: Inputs):
    return ops.reconcile(q.view("tool_catalog"), q.view("tool_executions"), "tool_name")


def _codes(df, code: str, label: str):
    return df.select(F.col(code).alias("code"), F.col(label).alias("label"))


@query("catalog_add", ["J9"], """
    WITH dim AS (SELECT upper(replace(p_name, ' ', '_')) AS code, min(p_type) AS label
                 FROM part GROUP BY 1),
         fresh AS (SELECT upper(replace(code, ' ', '_')) AS code, min(label) AS label FROM (
                       SELECT c_mktsegment AS code, c_name AS label FROM customer
                       UNION ALL SELECT p_name, p_brand FROM part) GROUP BY 1)
    SELECT code, label FROM dim UNION ALL
    SELECT code, label FROM fresh WHERE code NOT IN (SELECT code FROM dim)""")
def catalog_add(q: Inputs):
    part = q.table("part")
    dim = (_codes(part, "p_name", "p_type")
           .groupBy(ops.normalized_code(F.col("code"), True).alias("code"))
           .agg(F.min("label").alias("label")))
    rows = _codes(q.table("customer"), "c_mktsegment", "c_name").unionByName(_codes(part, "p_name", "p_brand"))
    return ops.catalog_add(dim, rows)


@query("catalog_delete", ["J10"], """
    SELECT p_partkey AS code, p_name AS label FROM part
    WHERE p_partkey NOT IN (SELECT code FROM returned_parts)""")
def catalog_delete(q: Inputs):
    return ops.catalog_delete(_codes(q.table("part"), "p_partkey", "p_name"), q.view("returned_parts"))


@query("templates_with_labels", ["J11"], """
    SELECT document_type,
           CASE document_type WHEN 'tax_form' THEN 'Tax Form (T4, T1, etc.)' WHEN 'id_card' THEN 'ID Card / Permit'
                WHEN 'bank_statement' THEN 'Bank Statement' END AS label,
           CASE document_type WHEN 'tax_form' THEN 'tax' WHEN 'id_card' THEN 'identity'
                WHEN 'bank_statement' THEN 'financial' END AS label_category,
           id, logo_name FROM tool_templates""")
def templates_with_labels(q: Inputs):
    rows = q.view("tool_templates").select("id", "logo_name", "document_type")
    return ops.with_code_labels(rows, "document_type", ops.DOCUMENT_TYPES)
