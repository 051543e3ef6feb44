"""Cleaning of raw records and natural keys, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FIELDS, NATURAL_KEY


def date_text(c: Column) -> Column:
    """Trimmed; +00:00 as Z; a space for a missing T; Z at the end. Null stays null."""
    text = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    text = F.when(text.endswith("+00:00"), F.replace(text, F.lit("+00:00"), F.lit("Z"))).otherwise(text)
    text = F.when(text.contains(" ") & ~text.contains("T"), F.replace(text, F.lit(" "), F.lit("T"))).otherwise(text)
    return F.when(text.endswith("Z"), text).otherwise(F.concat(text, F.lit("Z")))


def timestamp(c: Column) -> Column:
    """UTC timestamp of a text (the session runs in UTC); null where it is none."""
    return c.try_cast("timestamp")


def amount(c: Column) -> Column:
    """Two decimals, half away from zero; null where the text is no number or too large."""
    return c.try_cast("decimal(18,2)")


def number_text(c: Column) -> Column:
    """A decimal text with at least one and no needless decimal places, as keys hold amounts; other texts stay."""
    plain = c.try_cast("decimal(38,10)").cast("string")
    return F.coalesce(F.regexp_replace(plain, r"(\.[0-9]*?[0-9])0*$", "$1"), c)


def natural_key(date: str = "transaction_date", amount_text: str = "amount") -> Column:
    """The key columns joined by a bar; null as None, amounts as number_text."""
    at = {"transaction_date": date, "amount": amount_text}
    parts = [number_text(F.col(at[c])) if c == "amount" else F.col(at.get(c, c)) for c in NATURAL_KEY]
    return F.concat_ws("|", *(F.coalesce(p, F.lit("None")) for p in parts))


def with_normal_fields(raw: DataFrame) -> DataFrame:
    """raw's text columns with the date text normalised; a surrogate id goes, missing contract fields come as null."""
    frame = raw.drop("id")
    for name in FIELDS:
        if name not in frame.columns:
            frame = frame.withColumn(name, F.lit(None).cast("string"))
    return frame.withColumn("transaction_date", date_text(F.col("transaction_date").cast("string"))).withColumn("amount", F.col("amount").cast("string"))
