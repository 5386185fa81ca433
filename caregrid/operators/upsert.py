"""Keyed merge operators: resume anti-join (J3/U2), upsert (J8 + A3), matched-only update.

On DataFrames a merge is two shuffles on the key (anti-join, keep-last dedup of the batch) and one union. On tables
the merges go through ``sources.snapshots``: files that hold no key of the batch stay as they are, and the new
version becomes visible at once or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caregrid.operators.dedup import dedup_keep_last


def pending(source: DataFrame, done: DataFrame, key: str = "facility_id") -> DataFrame:
    """Rows of ``source`` whose key is not in ``done`` (resume; ids are never null)."""
    return source.join(done.select(key).distinct(), key, "left_anti")


def merge(existing: DataFrame | None, updates: DataFrame, key: str, order_col: str) -> DataFrame:
    """Replace matching keys, add new ones; the last row per key in the batch wins (A3).

    ``order_col`` orders the batch (e.g. an ingest ordinal); it is kept in the output.
    """
    latest = dedup_keep_last(updates, [key], order_col)
    if existing is None:
        return latest
    kept = existing.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


def upsert_table(spark: SparkSession, updates: DataFrame, path: str, key: str, order_col: str, rows_per_file: int | None = None) -> DataFrame:
    """J8 on a versioned table (created if absent): only files that hold a key of ``updates`` are rewritten."""
    from caregrid.sources import snapshots

    snapshots.upsert(spark, updates, path, key, order_col, rows_per_file or snapshots.ROWS_PER_FILE)
    return snapshots.read(spark, path)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, or an empty one where nothing has been written."""
    from caregrid.sources.files import read_table, table_exists

    return read_table(spark, path) if table_exists(spark, path) else spark.createDataFrame([], schema)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return p, p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_table(spark: SparkSession, df: DataFrame, path: str, key: str | None = None) -> DataFrame:
    """A new version of the table that holds ``df`` (which may read the table); the old version stays readable."""
    from caregrid.sources import snapshots

    recover(spark, path)
    snapshots.replace(spark, df, path, key)
    return snapshots.read(spark, path)


def recover(spark: SparkSession, path: str) -> bool:
    """A plain folder whose swap by an earlier release was cut short: put ``.__old`` back if no folder is in place."""
    path = path.rstrip("/")
    p, fs = _fs(spark, path)
    if not fs.exists(p(path)) and fs.exists(p(f"{path}.__old")):
        return fs.rename(p(f"{path}.__old"), p(path))
    return False


def update_table(spark: SparkSession, updates: DataFrame, path: str, key: str, columns: list[str]) -> DataFrame:
    """J9 on a versioned table: only files that hold a key of ``updates`` are rewritten."""
    from caregrid.sources import snapshots

    snapshots.update(spark, updates, path, key, columns)
    return snapshots.read(spark, path)


def update_matched(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """J9 (MERGE ... WHEN MATCHED UPDATE): for keys present in ``updates`` (deduplicated by the caller),
    replace ``columns``; other rows and columns untouched; no rows inserted."""
    u = updates.select(key, *[F.col(c).alias(f"__new_{c}") for c in columns]).withColumn("__matched", F.lit(True))
    j = target.join(u, key, "left")
    out = j.select(*[
        F.when(F.col("__matched"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in target.columns
    ])
    return out
