"""Queries over payloads, form fields and session results."""

from pyspark.sql import functions as F

from leafmill.operators import records as ops
from leafmill.registry import Inputs, query

_READ = """
    WITH t AS (SELECT doc_id, skip, trim(CASE WHEN contains(payload, '```json')
                          THEN split_part(split_part(payload, '```json', 2), '```', 1)
                      WHEN contains(payload, '```') THEN split_part(payload, '```', 2) ELSE payload END,
                      concat(' ', chr(10))) AS body FROM detections),
         j AS (SELECT doc_id, skip, json_valid(body) AS ok, CASE WHEN json_valid(body) THEN body ELSE '{}' END::JSON AS j FROM t),
         p AS (SELECT doc_id, skip, ok, CASE WHEN NOT ok THEN 'Invalid JSON response' END AS error,
                      coalesce(json_array_length(j, '$.logos_detected'), 0)::INT AS n_logos,
                      coalesce(json_array_length(j, '$.zones'), 0)::INT AS n_zones,
                      j->>'$.document_type' AS document_type, coalesce((j->>'$.valid')::BOOLEAN, false) AS valid,
                      coalesce((j->>'$.confidence')::DOUBLE, 0) AS confidence, j FROM j)"""


@query("parse_detections", ["P9"], _READ + """
    SELECT doc_id, ok, error, n_logos, n_zones, document_type, valid, confidence FROM p""")
def parse_detections(q: Inputs):
    return ops.parse_detections(q.view("detections")).select(
        "doc_id", "ok", "error", F.size("logos").alias("n_logos"), F.size("zones").alias("n_zones"),
        "document_type", "valid", "confidence")


@query("detected_logos", ["P9"], _READ + """
    SELECT doc_id, i::INT AS position, j->'logos_detected'->i->>'name' AS name,
           (j->'logos_detected'->i->>'confidence')::DOUBLE AS confidence
    FROM (SELECT *, unnest(range(0, n_logos)) AS i FROM p)""")
def detected_logos(q: Inputs):
    return ops.detected_logos(ops.parse_detections(q.view("detections")))


@query("review_filter", ["F12"], _READ + """
    SELECT doc_id, CASE WHEN n_logos > 0 THEN 'logo' WHEN n_zones > 0 THEN 'zones' ELSE 'manual' END AS outcome,
           j->'logos_detected'->0->>'name' AS logo,
           CASE WHEN n_logos > 0 THEN CASE WHEN (j->'logos_detected'->0->>'confidence')::DOUBLE < 0.8 THEN 'low'
                                           ELSE 'high' END END AS tag,
           CASE WHEN n_logos > 0 THEN document_type END AS document_type, n_zones AS zone_count
    FROM p WHERE NOT skip""")
def review_filter(q: Inputs):
    return ops.review_filter(ops.parse_detections(q.view("detections")))


@query("parse_validated", ["P10"], """
    WITH j AS (SELECT doc_id, json_valid(payload) AS ok, CASE WHEN json_valid(payload) THEN payload ELSE '{}' END::JSON AS j
               FROM validated)
    SELECT doc_id, ok, CASE WHEN NOT ok THEN 'Invalid JSON data' END AS error,
           CASE WHEN ok THEN coalesce(j->>'$.tool_name', 'logo_detector') END AS tool_name,
           j->>'$.document_type' AS document_type, j->>'$.logo_name' AS logo_name, ok AS is_active,
           CASE WHEN ok THEN coalesce((j->>'$.confidence')::DOUBLE, 0) END AS precision_rate FROM j""")
def parse_validated(q: Inputs):
    return ops.parse_validated(q.view("validated")).drop("zones", "thresholds")


@query("form_fields", ["A15"], """
    SELECT doc_id, field_no, name, CASE field_type WHEN '/Tx' THEN 'text' WHEN '/Btn' THEN 'button'
           WHEN '/Ch' THEN 'choice' WHEN '/Sig' THEN 'signature' ELSE field_type END AS type,
           nullif(value, '') AS value FROM form_fields""")
def form_fields(q: Inputs):
    return ops.form_fields(q.view("form_fields"))


@query("form_summary", ["A15"], """
    SELECT doc_id, count(*) > 0 AS has_form, count(*) AS field_count, count(*) FILTER (length(value) > 0) AS filled,
           count(*) FILTER (field_type = '/Tx') AS text_fields FROM form_fields GROUP BY doc_id""")
def form_summary(q: Inputs):
    return ops.form_summary(q.view("form_fields"))


@query("signature_fields", ["A14"], """
    SELECT doc_id, field_no, name, value IS NOT NULL AS signed FROM form_fields
    WHERE field_type = '/Sig' OR contains(lower(name), 'sign')""")
def signature_fields(q: Inputs):
    return ops.signature_fields(q.view("form_fields"))


@query("signature_summary", ["A14"], """
    WITH s AS (SELECT *, field_type = '/Sig' OR contains(lower(name), 'sign') AS sig FROM form_fields)
    SELECT doc_id, count(*) FILTER (sig) AS signature_count, count(*) FILTER (sig AND value IS NOT NULL) AS signed_count,
           count(*) FILTER (sig AND value IS NULL) AS unsigned_count,
           count(*) FILTER (sig) > 0 AND count(*) FILTER (sig AND value IS NULL) = 0 AS all_signed
    FROM s GROUP BY doc_id""")
def signature_summary(q: Inputs):
    return ops.signature_summary(q.view("form_fields"))


@query("session_summary", ["A26"], """
    SELECT session_id, count(*) AS total_analyzed, count(*) FILTER (success) AS succeeded,
           count(*) FILTER (NOT success) AS failed, min(error) AS first_error FROM session_results GROUP BY session_id""")
def session_summary(q: Inputs):
    return ops.session_summary(q.view("session_results"))
