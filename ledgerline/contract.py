"""The data contract: schemas, codes, limits and statuses.

Fixed values — these must equal the behaviour being reproduced, so they are
stated here plainly, in natural order, in one place.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: input file contract ------------------------------------
EXPECTED_HEADER = ["transaction_id", "occurred_at", "amount", "category"]
MAX_RECORD_CHARS_DEFAULT = 4096
MAX_RECORD_CHARS_MIN = 512
MAX_RECORD_CHARS_MAX = 1_000_000
TRANSACTION_ID_MAX = 64
CATEGORY_MAX = 100
AMOUNT_SCALE = 2
AMOUNT_PRECISION = 19
BATCH_SIZE_DEFAULT = 1000
BATCH_SIZE_MIN = 1
BATCH_SIZE_MAX = 100_000
FAILURE_REASON_MAX = 1000
ERROR_REASON_MAX = 500
PAGE_LIMIT_DEFAULT = 50
PAGE_LIMIT_MIN = 1
PAGE_LIMIT_MAX = 200

# --- fixed values: row error codes, in ladder order (first failing wins) ---
COLUMN_COUNT = "COLUMN_COUNT"
TRANSACTION_ID_REQUIRED = "TRANSACTION_ID_REQUIRED"
TRANSACTION_ID_TOO_LONG = "TRANSACTION_ID_TOO_LONG"
OCCURRED_AT_INVALID = "OCCURRED_AT_INVALID"
OCCURRED_AT_NOT_UTC = "OCCURRED_AT_NOT_UTC"
AMOUNT_INVALID = "AMOUNT_INVALID"
AMOUNT_SCALE_INVALID = "AMOUNT_SCALE_INVALID"
AMOUNT_PRECISION_INVALID = "AMOUNT_PRECISION_INVALID"
AMOUNT_ZERO = "AMOUNT_ZERO"
CATEGORY_REQUIRED = "CATEGORY_REQUIRED"
CATEGORY_TOO_LONG = "CATEGORY_TOO_LONG"

ERROR_CODES = [
    COLUMN_COUNT, TRANSACTION_ID_REQUIRED, TRANSACTION_ID_TOO_LONG,
    OCCURRED_AT_INVALID, OCCURRED_AT_NOT_UTC, AMOUNT_INVALID,
    AMOUNT_SCALE_INVALID, AMOUNT_PRECISION_INVALID, AMOUNT_ZERO,
    CATEGORY_REQUIRED, CATEGORY_TOO_LONG,
]

# Our own wording (codes are the contract; reasons must be non-blank, <= 500).
ERROR_REASONS = {
    COLUMN_COUNT: "The record must have exactly 4 columns.",
    TRANSACTION_ID_REQUIRED: "transaction_id is required.",
    TRANSACTION_ID_TOO_LONG: "transaction_id exceeds 64 characters.",
    OCCURRED_AT_INVALID: "occurred_at must be an ISO-8601 date-time with offset.",
    OCCURRED_AT_NOT_UTC: "occurred_at must be in UTC.",
    AMOUNT_INVALID: "amount must be a decimal number.",
    AMOUNT_SCALE_INVALID: "amount must have exactly two decimal places.",
    AMOUNT_PRECISION_INVALID: "amount exceeds NUMERIC(19,2) precision.",
    AMOUNT_ZERO: "amount must be different from zero.",
    CATEGORY_REQUIRED: "category is required.",
    CATEGORY_TOO_LONG: "category exceeds 100 characters.",
}

# --- fixed values: file-level verdicts --------------------------------------
FILE_OK = "OK"
FILE_REFUSED_NAME = "REFUSED_NAME"
FILE_REFUSED_EMPTY = "REFUSED_EMPTY"
FILE_BAD_UTF8 = "INVALID_UTF8"
FILE_OVERSIZE = "RECORD_TOO_LARGE"
FILE_SYNTAX = "CSV_SYNTAX"
FILE_HEADER = "HEADER_MISMATCH"

# --- fixed values: job statuses ---------------------------------------------
RECEIVED = "RECEIVED"
QUEUED = "QUEUED"
PROCESSING = "PROCESSING"
COMPLETED = "COMPLETED"
COMPLETED_WITH_ERRORS = "COMPLETED_WITH_ERRORS"
FAILED = "FAILED"
STATUSES = [RECEIVED, QUEUED, PROCESSING, COMPLETED, COMPLETED_WITH_ERRORS, FAILED]
TERMINAL_STATUSES = [COMPLETED, COMPLETED_WITH_ERRORS, FAILED]
DEFAULT_FAILURE_REASON = "Ingestion failed without a reported reason."

# --- schemas -----------------------------------------------------------------
TRANSACTION_SCHEMA = T.StructType([
    T.StructField("import_id", T.StringType(), False),
    T.StructField("id", T.LongType(), False),
    T.StructField("source_row", T.LongType(), False),
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("occurred_at", T.TimestampType(), False),
    T.StructField("amount", T.DecimalType(19, 2), False),
    T.StructField("category", T.StringType(), False),
])

ERROR_SCHEMA = T.StructType([
    T.StructField("import_id", T.StringType(), False),
    T.StructField("source_row", T.LongType(), False),
    T.StructField("error_code", T.StringType(), False),
    T.StructField("reason", T.StringType(), False),
])

# One row per ledger event (append-only). The current job row is derived.
LEDGER_SCHEMA = T.StructType([
    T.StructField("import_id", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("attempt", T.StringType(), True),
    T.StructField("original_filename", T.StringType(), True),
    T.StructField("path", T.StringType(), True),
    T.StructField("import_no", T.LongType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("accepted_rows", T.LongType(), False),
    T.StructField("rejected_rows", T.LongType(), False),
    T.StructField("first_batch", T.LongType(), True),
    T.StructField("last_batch", T.LongType(), True),
    T.StructField("failure_reason", T.StringType(), True),
    T.StructField("event_at", T.TimestampType(), False),
])

ANALYTICS_COLUMNS = ["import_id", "aggregation_type", "category", "month",
                     "transaction_count", "total_amount"]
