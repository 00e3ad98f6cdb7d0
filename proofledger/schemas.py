"""Schemas and vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: the raw record contract, field order included ----
RAW_FIELDS = [
    "month",
    "town",
    "flat_type",
    "block",
    "street_name",
    "storey_range",
    "floor_area_sqm",
    "flat_model",
    "lease_commence_date",
    "remaining_lease",
    "resale_price",
]
RAW_HEADER = ",".join(RAW_FIELDS)
CORRUPT = "_corrupt"
RAW_NUMERIC = {"floor_area_sqm": "double", "lease_commence_date": "int", "resale_price": "double"}

# ---- fixed values: result and verdict vocabularies ----
QUESTION_TYPES = ["filter", "aggregation", "ratio", "grouping", "window", "distinct", "date", "ambiguous"]
OUTCOMES = ["ok", "guardrail_reject", "timeout", "sql_error", "result_contract_error"]
STATUSES = ["pass_first_try", "pass_after_retry", "fail"]
FAILURE_CLASSES = ["value_mismatch", "wrong_row_count", "sql_error", "guardrail_reject", "timeout"]
MISMATCHES = ["", *FAILURE_CLASSES, "result_contract_error"]
VERDICT_FIELDS = [
    "question_id",
    "type",
    "trap",
    "status",
    "mismatch_type",
    "attempts",
    "attempt1_status",
    "attempt1_mismatch",
    "attempt2_status",
    "attempt2_mismatch",
    "note",
]
ROW_CAP = 10_000  # a limit that a run may ask for; no rows are cut
NOTE_LENGTH = 120

# All-text raw schema: a wrong number of fields is then the only thing that marks a record corrupt.
RAW_TEXT_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in [*RAW_FIELDS, CORRUPT]])

QUESTION_SCHEMA = """
    question_id STRING, type STRING, trap BOOLEAN, question STRING, why STRING, sql STRING,
    order_by ARRAY<STRING>, rows BIGINT, sha256 STRING
"""

# ---- fixed values: fields of log records and of a run's identity ----
ATTEMPT_STRUCT = """
    STRUCT<n: INT, sql: STRING, outcome: STRING, note: STRING,
           fingerprint: ARRAY<STRING>, response_text: STRING>
"""

META_STRUCT = """
    STRUCT<contract_sha256: STRING, serializer_version: INT, provider: STRING, run_date: STRING,
           run_at: STRING, model: STRING, temperature: DOUBLE, max_tokens: INT, thinking_budget: INT,
           prompt: STRING, golden_set_version: INT, listed_models: ARRAY<STRING>>
"""

LOG_SCHEMA = f"""
    meta {META_STRUCT}, id STRING, question STRING, model STRING, attempts ARRAY<{ATTEMPT_STRUCT}>
"""

VERDICT_SCHEMA = ", ".join(f"{f} {'INT' if f == 'attempts' else 'STRING'}" for f in VERDICT_FIELDS)

RUN_IDENTITY = [
    "provider",
    "model",
    "temperature",
    "max_tokens",
    "golden_set_version",
    "contract_sha256",
    "serializer_version",
]
