"""Tables bucketed and sorted by a unique key, so that joins on it read them without a shuffle.

The files lie in a folder of their own with a spec (key, number of buckets, columns) that is written last: a folder
without it is a write cut short and is refused. Spark knows buckets through its catalog only, so an entry lives there
for the moment of writing or opening and is dropped in any case; the files and an opened frame stay. Tables that are
joined with one another take the same number of buckets, given by the rows of the largest.

The key should be unique or nearly so (a repeated key lies in one bucket); null keys share a bucket and join nothing.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caregrid.sources.files import TableMissing

ROWS_A_BUCKET = 100_000  # a task sorts a bucket: wide rows (Gold, some KB each) must fit in its memory


def buckets_for(rows: int, rows_a_bucket: int = ROWS_A_BUCKET) -> int:
    return max(1, math.ceil(rows / rows_a_bucket))


def _with_entry(spark: SparkSession, work: Callable[[str], DataFrame | None]) -> DataFrame | None:
    name = f"caregrid_{uuid.uuid4().hex}"
    try:
        return work(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")  # of an external table: its files stay


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """``df`` as a new table of one file per bucket; an existing folder is an error."""
    spark = df.sparkSession
    if buckets < 1 or key not in df.columns:
        raise ValueError("buckets must be at least 1 and the key a column")
    data = df.repartition(buckets, F.col(f"`{key}`")).write.format("parquet").mode("errorifexists").bucketBy(buckets, key).sortBy(key)
    if _exists(spark, path):
        raise FileExistsError(path)
    _with_entry(spark, lambda name: data.option("path", f"{path}/data").saveAsTable(name))
    spec = json.dumps({"key": key, "buckets": buckets, "schema": df.schema.json()})
    spark.createDataFrame([(spec,)], "value string").coalesce(1).write.text(f"{path}/spec")


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table as a frame that Spark knows to be bucketed and sorted."""
    if not _exists(spark, f"{path}/spec/_SUCCESS"):
        raise TableMissing(f"no complete bucketed table: {path}")
    spec = json.loads(spark.read.text(f"{path}/spec").first()["value"])
    schema = T.StructType.fromJson(json.loads(spec["schema"]))
    quoted = "`" + spec["key"].replace("`", "``") + "`"
    columns = ", ".join("`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in schema.fields)
    where = f"{path}/data".replace("\\", "\\\\").replace("'", "\\'")

    def opened(name: str) -> DataFrame:
        spark.sql(f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY ({quoted}) SORTED BY ({quoted}) "
                  f"INTO {int(spec['buckets'])} BUCKETS LOCATION '{where}'")
        return spark.table(name).select(*[F.col("`{}`".format(f.name.replace("`", "``"))) for f in schema.fields])

    return _with_entry(spark, opened)
