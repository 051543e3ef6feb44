"""Duplicates by natural key, in linear form: no set of ids is gathered for a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def flag_duplicates(staged: DataFrame, existing: DataFrame, key: str = "natural_key_hash", id_: str = "transaction_id", order: str = "batch_seq") -> DataFrame:
    """staged with is_duplicate.

    A row is a duplicate if an earlier row of the batch, or any existing row, has its key and none of them has its id.
    Rows without an id are none.
    """
    earlier = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    again = Window.partitionBy(key, id_).orderBy(order)
    in_batch = (F.count(id_).over(earlier) > 0) & (F.row_number().over(again) == 1)
    keys = existing.where(F.col(key).isNotNull() & F.col(id_).isNotNull()).select(F.col(key).alias("__k"), F.col(id_).alias("__i"))
    # Only history with a key of the batch goes on: the batch's keys are the small side, by their measured size.
    near = keys.join(staged.select(F.col(key).alias("__k")).distinct(), "__k", "left_semi").groupBy("__k", "__i").agg(F.lit(True).alias("__own"))
    known = near.groupBy("__k").agg(F.lit(True).alias("__known"))
    frame = staged.drop("is_duplicate").withColumn("__batch", in_batch)
    frame = frame.join(known, F.col(key) == F.col("__k"), "left").drop("__k")
    frame = frame.join(near, (F.col(key) == F.col("__k")) & (F.col(id_) == F.col("__i")), "left")
    before = F.col("__known").isNotNull() & F.col("__own").isNull()
    flagged = F.col(id_).isNotNull() & (F.col("__batch") | before)
    return frame.withColumn("is_duplicate", flagged).drop("__batch", "__k", "__i", "__known", "__own")


def last_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row by order of each key, so that an upsert meets a key once."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("__n = 1").drop("__n")
