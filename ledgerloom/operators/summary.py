"""Daily account summaries, and the counts of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def included(transactions: DataFrame, quarantine: DataFrame | None = None) -> DataFrame:
    """Completed rows that are no duplicates and whose id was never quarantined."""
    rows = transactions.where((F.col("status") == "completed") & ~F.coalesce(F.col("is_duplicate"), F.lit(False)))
    return rows if quarantine is None else rows.join(quarantine.select("transaction_id"), "transaction_id", "left_anti")


def past(rows: DataFrame, start: str | None, inclusive: bool = False, by: str = "transaction_date") -> DataFrame:
    if start is None:
        return rows
    at, from_ = F.col(by), F.lit(start).cast("timestamp")
    return rows.where(at >= from_ if inclusive else at > from_)


def _sum(kind: str) -> Column:
    return F.sum(F.when(F.col("transaction_type") == kind, F.col("amount")).otherwise(F.lit(0).cast(MONEY)))


def daily_summary(rows: DataFrame) -> DataFrame:
    """One row for each account and day of included rows.

    Two aggregates on one shuffle key: by merchant category first, which shrinks a hot account before it is
    shuffled, then by account and day. The top category has the greatest debit sum above zero, of equals the first by name.
    """
    day = F.col("transaction_date").cast("date").alias("transaction_date")
    fine = rows.groupBy("account_id", day, "merchant_category", "merchant_name", "currency").agg(
        _sum("debit").alias("debit"), _sum("credit").alias("credit"), F.count("*").alias("n"), F.max("ingestion_timestamp").alias("updated_at"))
    category = fine.groupBy("account_id", "transaction_date", "merchant_category").agg(
        F.sum("debit").alias("debit"), F.sum("credit").alias("credit"), F.sum("n").alias("n"), F.max("updated_at").alias("updated_at"),
        F.collect_set("merchant_name").alias("merchants"), F.collect_set("currency").alias("currencies"))
    spent = F.when(F.col("debit") > 0, F.struct((-F.col("debit")).alias("less"), F.col("merchant_category").alias("category")))
    merged = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    day_ = category.groupBy("account_id", "transaction_date").agg(
        F.sum("debit").cast(MONEY).alias("total_debit_amount"), F.sum("credit").cast(MONEY).alias("total_credit_amount"), F.sum("n").alias("transaction_count"),
        F.size(merged("merchants")).cast("long").alias("distinct_merchants"), F.min(spent)["category"].alias("top_category"),
        F.array_join(F.sort_array(merged("currencies")), ",").alias("currencies"), F.max("updated_at").alias("updated_at"))
    return day_.select("account_id", "transaction_date", "total_debit_amount", "total_credit_amount",
                       (F.col("total_credit_amount") - F.col("total_debit_amount")).cast(MONEY).alias("net_amount"), "transaction_count", "distinct_merchants", "top_category", "currencies", "updated_at")


def changed_keys(rows: DataFrame, start: str, inclusive: bool = False, by: str = "transaction_date") -> DataFrame:
    return past(rows, start, inclusive, by).select("account_id", F.col("transaction_date").cast("date").alias("day")).distinct()


def changed_summary(rows: DataFrame, start: str, inclusive: bool = False, by: str = "transaction_date") -> DataFrame:
    """daily_summary of all rows of those accounts and days that have any row past start."""
    if start is None:
        raise ValueError("an incremental summary needs a start value")
    keys = changed_keys(rows, start, inclusive, by).withColumnsRenamed({"account_id": "__a", "day": "__d"})
    return daily_summary(rows.join(keys, (F.col("account_id") == F.col("__a")) & (F.col("transaction_date").cast("date") == F.col("__d")), "left_semi"))


def group_count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("account_id", F.col("transaction_date").cast("date")).count().agg(F.count("*").alias("computed_rows"))


def run_counts(staged: DataFrame) -> DataFrame:
    """All counts of a run, and the latest date, in one pass."""
    return staged.agg(F.count("*").alias("input_records"), F.count_if(F.col("error_reason").isNull()).alias("valid_records"),
                      F.count_if(F.col("error_reason").isNotNull()).alias("quarantine_records"), F.count_if("is_duplicate").alias("duplicate_records"),
                      F.max("transaction_date").alias("watermark_value"))
