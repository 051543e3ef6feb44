"""The jobs: basic and incremental ingestion, and the daily summary."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from .functions import contract, normalize
from .operators import dedupe, incremental, summary
from .sources.files import read_file
from .sources.rest import read_rest


@dataclass
class Settings:
    source_type: str = "file"
    source_file: str = "transactions.csv"
    schema_file: str | None = None
    api_url: str = ""
    api_key: str | None = None
    catalog: str = "workspace"
    dataset: str = "bronze"
    transactions_table: str = "transactions"
    quarantine_table: str = "quarantine"
    control_table: str = "ingestion_run_log"
    watermark_table: str = "ingestion_watermark"
    source_name: str = "transactions"
    lookback_hours: int = 0
    output_dataset: str = "gold"
    output_table: str = "daily_account_summary"
    summary_watermark_table: str = "daily_summary_watermark"
    monotonic_mark: bool = False  #: a mark never moves back
    advance_from: str = "all"  #: or 'valid': quarantined rows don't move the mark
    summary_by: str = "transaction_date"  #: or 'ingestion_timestamp': rows that arrive late refresh their days, too
    country_codes: list[str] = field(default_factory=list)  #: empty: those the runtime knows


def stage(raw: DataFrame, existing: DataFrame, run_ts: datetime, codes: list[str], rules: dict = S.CONTRACT) -> DataFrame:
    """raw (texts and batch_seq) normalised, validated, keyed and flagged; nothing is collected."""
    clean = normalize.with_normal_fields(raw)
    names = [c for c in raw.drop("id").columns if c != "batch_seq"]
    checked = clean.withColumn("error_reason", contract.error_text(names, codes, rules))
    too_large = normalize.amount(F.col("amount")).isNull() & F.col("amount").try_cast("decimal(38,18)").isNotNull()
    checked = checked.withColumn("error_reason", F.when(too_large, F.concat_ws("; ", "error_reason", F.lit("amount: too large to store"))).otherwise(F.col("error_reason")))
    checked = checked.drop(*contract.AS_RECEIVED)
    keyed = checked.withColumn("natural_key", normalize.natural_key()).withColumn("natural_key_hash", F.sha2("natural_key", 256))
    typed = keyed.withColumn("transaction_date", normalize.timestamp(F.col("transaction_date"))).withColumn("amount", normalize.amount(F.col("amount"))).withColumn("ingestion_timestamp", F.lit(run_ts.astimezone(timezone.utc).isoformat()).cast("timestamp"))
    return dedupe.flag_duplicates(typed, existing).select(*S.QUARANTINE.names, "batch_seq")


def ensure_tables(store, s: Settings) -> None:
    store.create(s.transactions_table, S.TRANSACTIONS, ["transaction_id"])
    store.create(s.quarantine_table, S.QUARANTINE, ["transaction_id"])
    store.create(s.watermark_table, S.WATERMARK, ["source_name"])
    store.create(s.control_table, S.RUN_LOG)


def _row(spark: SparkSession, schema, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values[n] for n in schema.names)], schema)


def run_ingest(spark: SparkSession, store, s: Settings, use_mark: bool = False, raw: DataFrame | None = None, run_ts: datetime | None = None, run_id: str | None = None) -> dict:
    """One load: data first, then the mark, then the log, so that a crash between them is made good by the next run. Returns the logged values."""
    if s.source_type not in ("file", "rest"):
        raise ValueError(f"unknown source type {s.source_type!r}")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    started = datetime.now(timezone.utc)
    run_ts, run_id = run_ts or started, run_id or uuid.uuid4().hex
    ensure_tables(store, s)
    held = incremental.latest_mark(store.read(s.watermark_table), s.source_name) if use_mark or s.monotonic_mark else None
    mark = held if use_mark else None
    start, inclusive = incremental.start_value(mark, s.lookback_hours), s.lookback_hours > 0
    if raw is None:
        raw = read_rest(spark, s.api_url, s.api_key, start, inclusive or not start) if s.source_type == "rest" else read_file(spark, s.source_file)
    if start and s.source_type == "file":
        known = incremental.known_ids(store.read(s.transactions_table), store.read(s.quarantine_table))
        raw = incremental.past_mark(raw.withColumn("transaction_date", normalize.date_text(F.col("transaction_date"))), start, inclusive, known)
    log = dict(run_id=run_id, pipeline="incremental" if use_mark else "basic", source_type=s.source_type, source_name=s.source_name, catalog_name=s.catalog, schema_name=s.dataset, started_at=started, lookback_hours=s.lookback_hours)
    raw = raw.persist(StorageLevel.MEMORY_AND_DISK) if s.source_type == "rest" else raw  # else its pages would be fetched again for the keys
    staged = stage(raw, store.read(s.transactions_table), run_ts, s.country_codes or contract.country_codes(spark), contract.load(s.schema_file)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = summary.run_counts(staged).first().asDict()
        for table, rows, names in ((s.transactions_table, staged.where("error_reason is null"), S.TRANSACTIONS.names), (s.quarantine_table, staged.where("error_reason is not null"), S.QUARANTINE.names)):
            if counts["valid_records" if table == s.transactions_table else "quarantine_records"]:
                store.upsert(table, dedupe.last_of_each(rows, ["transaction_id"], "batch_seq").select(*names), ["transaction_id"], ["country_code"])
        new = counts["watermark_value"] if s.advance_from == "all" else staged.where("error_reason is null").agg(F.max("transaction_date")).first()[0]
        if incremental.advances(held, new, s.monotonic_mark):
            store.upsert(s.watermark_table, _row(spark, S.WATERMARK, source_name=s.source_name, last_successful_transaction_date=new, updated_at=datetime.now(timezone.utc)), ["source_name"])
        log |= counts | {"completed_at": datetime.now(timezone.utc), "status": "success"}
        store.append(s.control_table, _row(spark, S.RUN_LOG, **log))
    except Exception:
        # What was stored stays: the next run makes the load good. The log says that this one didn't end.
        none = dict.fromkeys(("input_records", "valid_records", "quarantine_records", "duplicate_records", "watermark_value"))
        store.append(s.control_table, _row(spark, S.RUN_LOG, **{**none, **log, "completed_at": datetime.now(timezone.utc), "status": "failed"}))
        raise
    finally:
        staged.unpersist()
        raw.unpersist()
    return log


def run_summary(spark: SparkSession, store, s: Settings, lookback_hours: int = 0, out=None) -> dict:
    """Build the daily summary, or refresh the accounts and days that have rows past the last mark.

    It reads store and writes to out (the output data set; store itself if none is given).
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    out = out or store
    mark = out.read(s.summary_watermark_table).agg(F.max("last_successful_transaction_date")).first()[0] if out.exists(s.summary_watermark_table) else None
    rows = summary.included(store.read(s.transactions_table), store.read(s.quarantine_table))
    if mark is None:
        start, inclusive, mode = None, False, "full refresh"
        out.replace(s.output_table, summary.daily_summary(rows), ["account_id", "transaction_date"], ["transaction_date"])
    else:
        start, inclusive, mode = incremental.start_value(mark.astimezone(timezone.utc), lookback_hours), lookback_hours > 0, "incremental merge"
        out.upsert(s.output_table, summary.changed_summary(rows, start, inclusive, s.summary_by), ["account_id", "transaction_date"], ["transaction_date"])
    recent = summary.past(rows, start, inclusive, s.summary_by)
    new = recent.agg(F.max(s.summary_by)).first()[0]
    if new is not None:
        out.replace(s.summary_watermark_table, _row(spark, S.SUMMARY_WATERMARK, last_successful_transaction_date=new, updated_at=datetime.now(timezone.utc)))
    return {"mode": mode, "rows_computed": summary.group_count(recent).first()[0], "watermark_value": new}
