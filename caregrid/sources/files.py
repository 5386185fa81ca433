"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


class TableMissing(FileNotFoundError):
    """A required stage table has not been built yet."""


def read_csv_all_string(spark: SparkSession, path: str, columns: list[str] | None = None,
                        multi_line: bool = False) -> DataFrame:
    """CSV with header, every column read as text (typing happens later with try_cast, so bad
    values become nulls, not failures). Quoted fields may hold line breaks only with ``multi_line``,
    which keeps Spark from splitting a file."""
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    else:
        reader = reader.option("inferSchema", False)
    return reader.csv(path)


def read_registry_csv(spark: SparkSession, path: str, columns: list[str] | None = None,
                      multi_line: bool = False, order_col: str = "src_ord") -> DataFrame:
    """S1 for ingest: the rows with their source order, by file, then block of the file, then place in it."""
    raw = read_csv_all_string(spark, path, columns, multi_line)
    cols = raw.columns
    placed = raw.select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                                      F.monotonically_increasing_id()).alias(order_col))
    return placed.select(*cols, order_col)


def table_exists(spark: SparkSession, path: str) -> bool:
    from caregrid.operators.upsert import recover
    from caregrid.sources import snapshots

    recover(spark, path)
    if snapshots.is_table(spark, path):
        return True
    try:
        spark.read.parquet(path).schema  # noqa: B018 - metadata only
        return True
    except AnalysisException:
        return False


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """S3: the newest version of a versioned table, or a Parquet scan with an existence guard and an optional schema."""
    from caregrid.operators.upsert import recover
    from caregrid.sources import snapshots

    recover(spark, path)
    if snapshots.is_table(spark, path):
        df = snapshots.read(spark, path)
        return df if schema is None else df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
    try:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path)
    except AnalysisException as e:
        raise TableMissing(f"table not found: {path}") from e


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Parquet write - 'overwrite', 'errorifexists' or 'append' (append adds files, never rewrites)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with header."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines sink."""
    df.write.mode(mode).json(path)


def write_parquet_and_csv(df: DataFrame, parquet_path: str, csv_path: str) -> None:
    """One computation, two sinks: the Parquet copy is written first and the CSV
    is produced from it, so the source plan runs once."""
    write_table(df, parquet_path, mode="overwrite")
    df.sparkSession.read.parquet(parquet_path).write.mode("overwrite").option("header", True).csv(csv_path)


def register_views(spark: SparkSession, tables: dict[str, str]) -> list[str]:
    """A temp view per existing table path; returns the registered names."""
    done = []
    for name, path in tables.items():
        if table_exists(spark, path):
            read_table(spark, path).createOrReplaceTempView(name)
            done.append(name)
    return done
