"""Keyed deduplication (A2 keep first, A3 keep last).

The kept row is row number 1 of its key. Spark limits the groups below the shuffle (WindowGroupLimit), so a key
holding a third of all rows leaves each map task as one row instead of being sorted inside a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _dedup(df: DataFrame, keys: list[str], order_col: str, last: bool) -> DataFrame:
    order = F.col(order_col).desc_nulls_last() if last else F.col(order_col).asc_nulls_last()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__nth", nth).where(F.col("__nth") == 1).drop("__nth")


def dedup_keep_first(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    return _dedup(df, keys, order_col, last=False)


def dedup_keep_last(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    return _dedup(df, keys, order_col, last=True)
