"""Jobs over detection payloads, form fields and session results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafmill.functions.common import count_true, first_match, settle
from leafmill.functions.payloads import DEFAULT_TOOL, parse_detection, parse_template

# Field type codes and their names.
FIELD_TYPES = {"/Tx": "text", "/Btn": "button", "/Ch": "choice", "/Sig": "signature"}


def parse_detections(rows: DataFrame) -> DataFrame:
    """Payloads with missing parts filled in; text that is not JSON gives an error row."""
    read = settle(rows, parse_detection("payload").alias("d"))
    bad = F.col("d").isNull() | F.col("d.broken").isNotNull()
    logos = F.coalesce("d.logos_detected", F.array().cast("array<struct<name:string,confidence:double>>"))
    empty_zones = F.array().cast("array<struct<type:string,label:string,value:string>>")
    zones = F.coalesce("d.zones", "d.zones_detected", empty_zones)
    return read.select(
        *[c for c in rows.columns if c != "payload"], (~bad).alias("ok"),
        F.when(bad, "Invalid JSON response").alias("error"), logos.alias("logos"), zones.alias("zones"),
        F.coalesce("d.suggestions", F.array().cast("array<string>")).alias("suggestions"),
        F.col("d.document_type").alias("document_type"), F.coalesce("d.valid", F.lit(False)).alias("valid"),
        F.coalesce("d.confidence", F.lit(0.0)).alias("confidence"))


def detected_logos(parsed: DataFrame) -> DataFrame:
    """One row per detected logo with its place in the payload."""
    return parsed.select("doc_id", F.posexplode("logos").alias("position", "logo")).select(
        "doc_id", "position", "logo.name", "logo.confidence")


def review_filter(parsed: DataFrame, low: float = 0.8) -> DataFrame:
    """What a reviewer sees: the first logo with a confidence tag, else the
    zones, else manual entry. Rows marked to skip are dropped."""
    logo = F.try_element_at("logos", F.lit(1))
    has_logo, zones = F.size("logos") > 0, F.size("zones")
    return parsed.filter(~F.col("skip")).select(
        "doc_id", first_match([(has_logo, F.lit("logo")), (zones > 0, F.lit("zones"))], F.lit("manual")).alias("outcome"),
        logo["name"].alias("logo"),
        F.when(has_logo, F.when(logo["confidence"] < low, "low").otherwise("high")).alias("tag"),
        F.when(has_logo, F.col("document_type")).alias("document_type"), zones.alias("zone_count"))


def parse_validated(rows: DataFrame) -> DataFrame:
    """Reviewer payloads to template rows; text that is not JSON is refused."""
    read = settle(rows, parse_template("payload").alias("t"))
    bad = F.col("t").isNull() | F.col("t.broken").isNotNull()
    empty_zones = F.create_map().cast("map<string,struct<x:int,y:int,width:int,height:int>>")
    return read.select(
        "doc_id", (~bad).alias("ok"), F.when(bad, "Invalid JSON data").alias("error"),
        F.when(~bad, F.coalesce("t.tool_name", F.lit(DEFAULT_TOOL))).alias("tool_name"),
        "t.document_type", "t.logo_name", F.when(~bad, F.coalesce("t.zones", empty_zones)).alias("zones"),
        F.when(~bad, F.coalesce("t.thresholds", F.create_map().cast("map<string,double>"))).alias("thresholds"),
        (~bad).alias("is_active"), F.when(~bad, F.coalesce("t.confidence", F.lit(0.0))).alias("precision_rate"))


def form_fields(fields: DataFrame) -> DataFrame:
    """Fields with readable types; codes without a name stay, empty values become NULL."""
    names = F.create_map(*[F.lit(x) for pair in FIELD_TYPES.items() for x in pair])
    return fields.select("doc_id", "field_no", "name",
                         F.coalesce(F.try_element_at(names, F.col("field_type")), F.col("field_type")).alias("type"),
                         F.nullif("value", F.lit("")).alias("value"))


def form_summary(fields: DataFrame) -> DataFrame:
    count = F.count(F.lit(1))
    return fields.groupBy("doc_id").agg(
        (count > 0).alias("has_form"), count.alias("field_count"),
        count_true(F.length("value") > 0).alias("filled"),
        count_true(F.col("field_type") == "/Tx").alias("text_fields"))


def signature_fields(fields: DataFrame) -> DataFrame:
    """Signature fields by type, or by a name that speaks of signing."""
    named = F.lower("name").contains("sign")
    return fields.filter((F.col("field_type") == "/Sig") | named).select(
        "doc_id", "field_no", "name", F.col("value").isNotNull().alias("signed"))


def signature_summary(fields: DataFrame) -> DataFrame:
    """Signatures per document; all signed only when there is one."""
    wanted = (F.col("field_type") == "/Sig") | F.lower("name").contains("sign")
    total, signed = count_true(wanted), count_true(wanted & F.col("value").isNotNull())
    return fields.groupBy("doc_id").agg(
        total.alias("signature_count"), signed.alias("signed_count"), (total - signed).alias("unsigned_count"),
        ((total > 0) & (total == signed)).alias("all_signed"))


def session_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_analyzed"), count_true(F.col("success")).alias("succeeded"),
        count_true(~F.col("success")).alias("failed"), F.min("error").alias("first_error"))
