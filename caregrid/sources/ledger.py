"""A ledger of model calls (L1-L3): replies kept by the hash of the messages sent.

Equal messages are sent once. While a task runs, every ``commit_rows`` replies become a Parquet file of the ledger,
written under a hidden name and renamed, so a task that is lost repeats at most the calls since its last file; a second
attempt of the task reads the files of the first. Later runs send only messages without a reply. Failed calls are kept
for the run's result, but do not count as replies: they are sent again next time.
"""

from __future__ import annotations

import io
import uuid
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT_ROWS = 50
ROW = "input_hash string, content string, prompt_tokens long, completion_tokens long, latency_ms double, call_error string, run string"


def _files(path: str):
    from pyarrow.fs import FileSystem

    scheme, sep, rest = path.partition("://")
    return FileSystem.from_uri(f"s3://{rest}" if sep and scheme in ("s3a", "s3n") else path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the ledger; an empty frame where there is none."""
    from pyarrow.fs import FileSelector

    fs, inner = _files(path)
    there = any(f.base_name.endswith(".parquet") and not f.base_name.startswith("_") for f in fs.get_file_info(FileSelector(inner, allow_not_found=True)))
    return spark.read.schema(ROW).parquet(path) if there else spark.createDataFrame([], ROW)


def replies(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """One row per hash: a reply if there is one, else a failed call of ``run``."""
    from caregrid.operators.dedup import dedup_keep_first

    rows = read(spark, path).where(F.col("call_error").isNull() | (F.col("run") == F.lit(run)))
    rows = rows.withColumn("_order", F.struct(F.col("call_error").isNotNull(), F.col("run"), F.xxhash64("content")))
    return dedup_keep_first(rows, ["input_hash"], "_order").drop("_order", "run")


def complete_once(df: DataFrame, messages_col: str, completer, path: str, partitions: int | None = None, concurrency: int = 1,
                  commit_rows: int = COMMIT_ROWS) -> DataFrame:
    """L1 through a ledger: ``df`` with ``input_hash`` and the columns of a call, as ``inference.complete`` adds them."""
    from caregrid.operators.inference import CALL_FIELDS, one_call

    spark, run_id = df.sparkSession, uuid.uuid4().hex
    src = df.withColumn("input_hash", F.sha2(F.to_json(messages_col), 256))
    todo = src.select("input_hash", F.col(messages_col).alias("messages")).dropDuplicates(["input_hash"])
    todo = todo.join(read(spark, path).where(F.col("call_error").isNull()).select("input_hash").distinct(), "input_hash", "left_anti")
    todo = todo.repartition(partitions, "input_hash") if partitions else todo
    names = [f.name for f in CALL_FIELDS]

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, inner = _files(path)
        fs.create_dir(inner, recursive=True)
        own = f"{run_id}-{context.partitionId():06d}-"
        done = set()
        if context.attemptNumber():  # what earlier attempts of this task have committed
            for f in fs.get_file_info(FileSelector(inner)):
                if f.base_name.startswith(own):
                    with fs.open_input_file(f.path) as stream:
                        done |= set(pq.read_table(stream, columns=["input_hash"]).column(0).to_pylist())
        sent = 0
        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                left = pdf[~pdf["input_hash"].isin(done)]
                for start in range(0, len(left), commit_rows):
                    part = left.iloc[start:start + commit_rows]
                    calls = list(pool.map(lambda m: one_call(completer, m), part["messages"]))
                    table = pa.table({"input_hash": part["input_hash"].tolist(), **{n: [c[i] for c in calls] for i, n in enumerate(names)}, "run": [run_id] * len(part)},
                                     schema=pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in ROW.split(", ")]))
                    name, buffer = f"{own}{uuid.uuid4().hex}.parquet", io.BytesIO()
                    pq.write_table(table, buffer)
                    with fs.open_output_stream(f"{inner}/_{name}") as out:
                        out.write(buffer.getvalue())
                    fs.move(f"{inner}/_{name}", f"{inner}/{name}")
                    sent += len(part)
        yield pd.DataFrame({"sent": [sent]})

    todo.mapInPandas(run, "sent long").agg(F.sum("sent")).collect()  # one number
    types = {f.name: f.dataType for f in CALL_FIELDS}
    got = replies(spark, path, run_id).select("input_hash", *[F.col(n).cast(types[n]).alias(n) for n in names])
    return src.join(got, "input_hash", "left").select(*df.columns, "input_hash", *names)


