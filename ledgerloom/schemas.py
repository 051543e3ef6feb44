"""Table schemas and the input contract of the ledger."""

from __future__ import annotations

from pyspark.sql import types as T

# Names and types of the stored tables' columns.
TRANSACTIONS = (
    T.StructType()
    .add("transaction_id", "string")
    .add("account_id", "string")
    .add("transaction_date", "timestamp")
    .add("amount", "decimal(18,2)")
    .add("currency", "string")
    .add("transaction_type", "string")
    .add("merchant_name", "string")
    .add("merchant_category", "string")
    .add("status", "string")
    .add("country_code", "string")
    .add("ingestion_timestamp", "timestamp")
    .add("natural_key", "string")
    .add("natural_key_hash", "string")
    .add("is_duplicate", "boolean")
)
QUARANTINE = T.StructType([*TRANSACTIONS, T.StructField("error_reason", T.StringType(), True)])
WATERMARK = (
    T.StructType()
    .add("source_name", "string")
    .add("last_successful_transaction_date", "timestamp")
    .add("updated_at", "timestamp")
)
RUN_LOG = (
    T.StructType()
    .add("run_id", "string")
    .add("pipeline", "string")
    .add("source_type", "string")
    .add("source_name", "string")
    .add("catalog_name", "string")
    .add("schema_name", "string")
    .add("started_at", "timestamp")
    .add("completed_at", "timestamp")
    .add("input_records", "long")
    .add("valid_records", "long")
    .add("quarantine_records", "long")
    .add("duplicate_records", "long")
    .add("lookback_hours", "integer")
    .add("watermark_value", "timestamp")
    .add("status", "string")
)
SUMMARY_WATERMARK = (
    T.StructType()
    .add("last_successful_transaction_date", "timestamp")
    .add("updated_at", "timestamp")
)

# The columns that make a natural key, in order.
NATURAL_KEY = ("account_id", "transaction_date", "amount", "currency", "transaction_type", "merchant_name", "merchant_category", "status", "country_code")

# The contract of an input record, as JSON Schema keywords in order.
CONTRACT = {
    "required": ["transaction_id", "account_id", "transaction_date", "amount", "currency", "transaction_type", "merchant_name", "merchant_category", "status", "country_code"],
    "additionalProperties": False,
    "properties": {
        "transaction_id": {"type": "string", "pattern": r"^TXN-[A-Z0-9]+$"},
        "account_id": {"type": "string", "pattern": r"^ACC-\d{4}$"},
        "transaction_date": {"type": "string", "pattern": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\dZ$"},
        "amount": {"type": "number", "exclusiveMinimum": 0, "multipleOf": "0.01"},
        "currency": {"type": "string", "enum": ["USD", "EUR", "GBP", "CHF", "JPY", "AUD", "CAD"]},
        "transaction_type": {"type": "string", "enum": ["debit", "credit"]},
        "merchant_name": {"type": "string", "minLength": 1, "pattern": r".*\S.*"},
        "merchant_category": {"type": "string", "enum": ["e-commerce", "travel", "food_and_beverage", "groceries", "electronics", "retail", "entertainment", "health", "transportation", "home_and_garden", "payroll", "transfer"]},
        "status": {"type": "string", "enum": ["completed", "pending", "failed", "reversed"]},
        "country_code": {"type": "string", "pattern": r"^[A-Z]{2}$", "minLength": 2, "maxLength": 2},
    },
}
FIELDS = tuple(CONTRACT["properties"])
