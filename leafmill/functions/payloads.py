"""Reading of JSON payloads from detection models and reviewers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leafmill.functions.common import col, strip

DETECTION_SCHEMA = (
    "logos_detected ARRAY<STRUCT<name: STRING, confidence: DOUBLE>>, "
    "zones ARRAY<STRUCT<type: STRING, label: STRING, value: STRING>>, "
    "zones_detected ARRAY<STRUCT<type: STRING, label: STRING, value: STRING>>, "
    "suggestions ARRAY<STRING>, issues ARRAY<STRING>, document_type STRING, valid BOOLEAN, "
    "confidence DOUBLE, broken STRING"
)
TEMPLATE_SCHEMA = (
    "tool_name STRING, document_type STRING, logo_name STRING, "
    "zones MAP<STRING, STRUCT<x: INT, y: INT, width: INT, height: INT>>, "
    "thresholds MAP<STRING, DOUBLE>, confidence DOUBLE, broken STRING"
)
DEFAULT_TOOL = "logo_detector"


def strip_fences(text: str | Column) -> Column:
    """What stands inside the first code fence, or the whole text without one."""
    body = strip(text)
    fence = F.when(body.contains("```json"), "```json").when(body.contains("```"), "```")
    inner = F.split_part(F.split_part(body, fence, F.lit(2)), F.lit("```"), F.lit(1))
    return strip(F.when(fence.isNotNull(), inner).otherwise(body))


def _read(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})


def parse_detection(text: str | Column) -> Column:
    """Detection struct; ``broken`` holds text that is not JSON."""
    return _read(strip_fences(text), DETECTION_SCHEMA)


def parse_template(text: str | Column) -> Column:
    return _read(col(text), TEMPLATE_SCHEMA)
