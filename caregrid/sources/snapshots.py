"""Versioned tables: immutable Parquet files, a log of versions committed by create-if-absent, and a key index per file.

Layout under the folder of a table::

    _data/<write>/part-*.parquet    files of one write, never changed
    _log/<write>/files              Parquet: the files that the write adds (rows, lowest and highest key) or removes
    _log/<write>/keys               Parquet: Bloom filters of the added files' keys, as bitmaps of 32,768 bits
    _log/v000000000007.json         version 7: its writes, schema and key

A version exists once its small file exists, and that file is created complete or not at all; so a writer that dies at
any step leaves the newest version as it was, and of two writers that start from one version the second gets
``CommitConflict``. Readers take the newest version (or a named one). No write deletes a file; ``vacuum`` removes what
no kept version refers to.

A merge rewrites only files that hold a key of the batch: the lowest and highest key and the Bloom filters, looked up
by an equi-join on the filter's block, name the files that may hold one, and their key column decides. Files are cut
by key order at ``rows_per_file`` rows, so their number grows with the table and a batch of neighbouring keys meets
few of them. The driver handles one row per file, as for any scan; rows and filters stay in the tasks.

A null key is a key like others. An empty table is a version without files. A plain Parquet folder is taken over, as
version 1, by the first write to it.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_FILE = 1_000_000
BLOCK_BITS = 32_768  # bits of the bitmaps that Spark's bitmap functions build
BITS_PER_KEY, HASHES = 14, 4  # a false positive in about 250 probes
PROBES = 20_000_000  # keys x files up to which the filters are asked; beyond that the key columns are read at once
MERGE_WRITES = 16  # writes in a version before their logs are merged into one
# Schemes whose rename never replaces a file; a local file is linked instead.
ATOMIC_RENAME = ("hdfs", "viewfs", "abfs", "abfss")


class CommitConflict(RuntimeError):
    """Another writer committed the version first; nothing of this write is visible."""


# ---- files of the log

def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return p, p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with this content, whole; False if it is there already."""
    p, fs = _fs(spark, path)
    scheme, temp = fs.getUri().getScheme(), f"{path}.{uuid.uuid4().hex}.tmp"
    if scheme != "file" and scheme not in ATOMIC_RENAME:
        raise ValueError(f"no atomic create-if-absent is known for {scheme}://")
    out = fs.create(p(temp), False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if scheme == "file":
            os.link(p(temp).toUri().getPath(), p(path).toUri().getPath())
        else:
            jvm = spark.sparkContext._jvm
            option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(p(temp), p(path), option)
        return True
    except FileExistsError:
        return False
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    finally:
        if fs.exists(p(temp)):
            fs.delete(p(temp), False)


def versions(spark: SparkSession, path: str) -> list[int]:
    p, fs = _fs(spark, path)
    log = p(f"{path}/_log")
    names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d{12})\.json", n)))


def head(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The newest version, or the one named; None where there is no log."""
    path = path.rstrip("/")
    known = versions(spark, path)
    if version is not None and version not in known:
        raise ValueError(f"{path} has no version {version}")
    if not known:
        return None
    p, fs = _fs(spark, path)
    stream = fs.open(p(_version_file(path, known[-1] if version is None else version)))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _version_file(path: str, version: int) -> str:
    return f"{path}/_log/v{version:012d}.json"


def is_table(spark: SparkSession, path: str) -> bool:
    return bool(versions(spark, path.rstrip("/")))


# ---- reading

def _schema(h: dict) -> T.StructType:
    return T.StructType.fromJson(h["schema"])


def _entry_schema(h: dict) -> T.StructType:
    key = _schema(h)[h["key"]].dataType if h["key"] else T.StringType()
    return T.StructType([T.StructField("added", T.BooleanType()), T.StructField("file", T.StringType()), T.StructField("rows", T.LongType()),
                         T.StructField("nulls", T.LongType()), T.StructField("low", key), T.StructField("high", key), T.StructField("blocks", T.IntegerType())])


def files(spark: SparkSession, path: str, h: dict) -> DataFrame:
    """(file, rows, nulls, low, high, blocks) of every file of a version."""
    if not h["writes"]:
        return spark.createDataFrame([], _entry_schema(h)).drop("added")
    e = spark.read.schema(_entry_schema(h)).parquet(*[f"{path}/_log/{w}/files" for w in h["writes"]])
    return e.where("added").drop("added").join(e.where("not added").select("file"), "file", "left_anti")


def _scan(spark: SparkSession, path: str, schema: T.StructType, names: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of an older one that is still kept."""
    path = path.rstrip("/")
    h = head(spark, path, version)
    if h is None:
        raise FileNotFoundError(f"no versioned table at {path}")
    return _scan(spark, path, _schema(h), [r[0] for r in files(spark, path, h).select("file").collect()])


def changes(spark: SparkSession, path: str, old: int | None, new: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the files that only version ``old`` (None: an empty table) and only version ``new`` hold.

    Rows that a merge carried over unchanged are in both.
    """
    path = path.rstrip("/")
    after = head(spark, path, new)
    before = head(spark, path, old) if old is not None else None
    a = {r[0] for r in files(spark, path, after).select("file").collect()}
    b = {r[0] for r in files(spark, path, before).select("file").collect()} if before else set()
    return _scan(spark, path, _schema(before or after), sorted(b - a)), _scan(spark, path, _schema(after), sorted(a - b))


def rows_with(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The rows of the newest version with a key of ``keys`` (unique ones), read from the files that hold one."""
    path = path.rstrip("/")
    h = head(spark, path)
    rows = _scan(spark, path, _schema(h), files_with(spark, path, h, keys))
    return rows.join(keys, rows[h["key"]].eqNullSafe(keys[h["key"]]), "left_semi")


# ---- key index

def _file() -> Column:
    """The file of a row, relative to the table."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"((?:_data/[^/]+/)?[^/]+)$", 1)


def _bits(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(BLOCK_BITS)) for i in range(HASHES)]


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks)


def _bit_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) > 0


def _describe(spark: SparkSession, path: str, write: str, schema: T.StructType, key: str | None, sources: list[str], removed: list[str]) -> None:
    """The log folder of one write: its files with their statistics and the Bloom filters of their keys."""
    log = f"{path}/_log/{write}"
    k = F.col(f"`{key}`") if key else F.lit(None).cast("string")
    entry_schema = _entry_schema({"schema": schema.jsonValue(), "key": key})
    gone = spark.createDataFrame([(False, f) for f in removed], "added boolean, file string").select(
        "added", "file", *[F.lit(None).cast(f.dataType).alias(f.name) for f in entry_schema.fields[2:]])
    if not sources:
        gone.write.parquet(f"{log}/files")
        return
    work = f"{path}/_work/{uuid.uuid4().hex}"
    p, fs = _fs(spark, path)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    try:
        # the files may be many and small: they are opened once
        rows = kept(spark.read.schema(schema).parquet(*sources).select(_file().alias("file"), k.alias("key")), "rows")
        entries = kept(rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("key").isNull()).alias("nulls"),
                                                F.min("key").alias("low"), F.max("key").alias("high"))
                       .withColumn("number", F.monotonically_increasing_id()), "entries")
        blocks, most = 1, entries.agg(F.max("rows")).first()[0] or 0
        while blocks * BLOCK_BITS < most * BITS_PER_KEY:
            blocks *= 2
        if key:
            # bitmaps are aggregated by sorting: by a number, not by long names that begin alike
            names = F.broadcast(entries.select("file", "number"))  # one row per file
            bits = rows.join(names, "file").select("number", _block(F.col("key"), F.lit(blocks)).cast("int").alias("block"),
                                                   F.explode(F.array(*_bits(F.col("key")))).alias("bit"))
            found = bits.groupBy("number", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))
            found.join(names, "number").select("file", "block", "bits").write.parquet(f"{log}/keys")
        entries.select(F.lit(True).alias("added"), *[f for f in entry_schema.names[1:-1]], F.lit(blocks).alias("blocks")).unionByName(gone).write.parquet(f"{log}/files")
    finally:
        fs.delete(p(work), True)


KEYS = "file string, block int, bits binary"


def _filters(spark: SparkSession, path: str, h: dict) -> DataFrame:
    p, fs = _fs(spark, path)
    there = [f"{path}/_log/{w}/keys" for w in h["writes"] if fs.exists(p(f"{path}/_log/{w}/keys"))]
    return spark.read.schema(KEYS).parquet(*there) if there else spark.createDataFrame([], KEYS)


def files_with(spark: SparkSession, path: str, h: dict, keys: DataFrame) -> list[str]:
    """The files of a version that hold a key of ``keys`` (one column with the key's name)."""
    key = h["key"]
    live = files(spark, path, h).cache()
    try:
        names, sizes = [r[0] for r in live.select("file").collect()], [r[0] for r in live.select("blocks").distinct().collect()]
        k = keys.select(F.col(f"`{key}`").alias("key"))
        if not names:
            return []
        if k.count() * len(names) <= PROBES:
            asked = k.select("key", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("blocks"), *[b.alias(f"bit{i}") for i, b in enumerate(_bits(F.col("key")))])
            asked = asked.withColumn("block", _block(F.col("key"), F.col("blocks")).cast("int"))
            index = _filters(spark, path, h).join(live, "file")
            hit = index.join(asked, ["blocks", "block"]).where(
                F.when(F.col("key").isNull(), F.col("nulls") > 0).otherwise(F.col("key").between(F.col("low"), F.col("high"))))
            for i in range(HASHES):
                hit = hit.where(_bit_set(F.col("bits"), F.col(f"bit{i}")))
            names = [r[0] for r in hit.select("file").distinct().collect()]
        if not names:
            return []
    finally:
        live.unpersist()
    have = _scan(spark, path, _schema(h), names).select(_file().alias("file"), F.col(f"`{key}`").alias("have"))
    return sorted(r[0] for r in have.join(k, F.col("have").eqNullSafe(F.col("key")), "left_semi").select("file").distinct().collect())


# ---- writing

def _write_data(df: DataFrame, path: str, write: str, key: str | None, rows_per_file: int) -> str:
    """New files, by key order where there is a key."""
    folder = f"{path}/_data/{write}"
    if key:
        df = df.repartitionByRange(F.col(f"`{key}`")).sortWithinPartitions(F.col(f"`{key}`"))
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(folder)
    return folder


def _part_files(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _fs(spark, folder)
    return [s.getPath().toString() for s in fs.listStatus(p(folder)) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]


def _commit(spark: SparkSession, path: str, base: dict | None, write: str, schema: T.StructType, key: str | None, fresh: bool, meta: dict | None = None) -> int:
    version = base["version"] + 1 if base else 1
    h = {"version": version, "writes": [write] if fresh or not base else [*base["writes"], write], "schema": schema.jsonValue(), "key": key, "at": time.time(),
         "meta": meta or {}}
    if len(h["writes"]) > MERGE_WRITES:
        h["writes"] = [_merge_log(spark, path, h)]
    if not create_if_absent(spark, _version_file(path, version), json.dumps(h)):
        raise CommitConflict(f"{path}: version {version} was committed by another writer; start again from it")
    return version


def _merge_log(spark: SparkSession, path: str, h: dict) -> str:
    """One log folder in place of those of all writes of a version."""
    write = uuid.uuid4().hex
    live = files(spark, path, h)
    _filters(spark, path, h).join(live.select("file"), "file", "left_semi").write.parquet(f"{path}/_log/{write}/keys")
    live.select(F.lit(True).alias("added"), "*").write.parquet(f"{path}/_log/{write}/files")
    return write


def _adopted(spark: SparkSession, path: str, key: str | None) -> dict | None:
    """The newest version; a plain Parquet folder becomes version 1 first."""
    h = head(spark, path)
    if h is not None:
        return h
    p, fs = _fs(spark, path)
    parts = _part_files(spark, path) if fs.exists(p(path)) else []
    if not parts:
        return None
    schema, write = spark.read.parquet(*parts).schema, uuid.uuid4().hex
    _describe(spark, path, write, schema, key, parts, [])
    _commit(spark, path, None, write, schema, key, True)
    return head(spark, path)


def _put(spark: SparkSession, path: str, base: dict | None, df: DataFrame, key: str | None, removed: list[str], rows_per_file: int, fresh: bool,
         meta: dict | None = None) -> int:
    write = uuid.uuid4().hex
    folder = _write_data(df, path, write, key, rows_per_file)
    _describe(spark, path, write, df.schema, key, _part_files(spark, folder), removed)
    return _commit(spark, path, base, write, df.schema, key, fresh, meta)


def replace(spark: SparkSession, df: DataFrame, path: str, key: str | None = None, rows_per_file: int = ROWS_PER_FILE, meta: dict | None = None) -> int:
    """A new version that holds ``df`` alone (which may read the table itself); the old files stay. Returns the version.

    ``meta`` is committed with the version (``head(...)["meta"]``)."""
    path = path.rstrip("/")
    base = _adopted(spark, path, None)
    return _put(spark, path, base, df, key or (base["key"] if base and base["key"] in df.columns else None), [], rows_per_file, True, meta)


def append(spark: SparkSession, df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> int:
    """A new version with the rows of ``df`` besides the old ones."""
    path = path.rstrip("/")
    base = _adopted(spark, path, None)
    if base:
        df = _scan(spark, path, _schema(base), []).unionByName(df, allowMissingColumns=True)
    return _put(spark, path, base, df, base["key"] if base else None, [], rows_per_file, base is None)


def upsert(spark: SparkSession, updates: DataFrame, path: str, key: str, order_col: str, rows_per_file: int = ROWS_PER_FILE, meta: dict | None = None) -> int:
    """Replace the rows with a key of ``updates`` and add those with new keys; of equal keys in the batch the last by ``order_col``."""
    from caregrid.operators.dedup import dedup_keep_last

    return _merge(spark, dedup_keep_last(updates, [key], order_col), path, key, None, rows_per_file, meta)


def update(spark: SparkSession, updates: DataFrame, path: str, key: str, columns: list[str], rows_per_file: int = ROWS_PER_FILE) -> int:
    """Set ``columns`` in the rows with a key of ``updates`` (unique keys); nothing is added."""
    return _merge(spark, updates.select(key, *columns), path, key, columns, rows_per_file)


def _merge(spark: SparkSession, batch: DataFrame, path: str, key: str, columns: list[str] | None, rows_per_file: int, meta: dict | None = None) -> int:
    path = path.rstrip("/")
    base = _adopted(spark, path, key)
    if base and base["key"] != key:
        raise ValueError(f"{path} is keyed by {base['key']}, not {key}")
    work = f"{path}/_work/{uuid.uuid4().hex}"
    p, fs = _fs(spark, path)
    try:
        batch.write.parquet(work)  # read several times
        batch = spark.read.schema(batch.schema).parquet(work)
        if base is None:
            if columns is not None:
                raise FileNotFoundError(f"no table at {path}")
            return _put(spark, path, None, batch, key, [], rows_per_file, True, meta)
        touched = files_with(spark, path, base, batch.select(F.col(f"`{key}`")))
        old = _scan(spark, path, _schema(base), touched)
        same = old[key].eqNullSafe(batch[key])
        if columns is None:
            new = old.join(batch, same, "left_anti").unionByName(batch, allowMissingColumns=True)
        else:
            from caregrid.operators.upsert import update_matched

            if not touched:
                return base["version"]
            new = update_matched(old, batch, key, columns)
        return _put(spark, path, base, new, key, touched, rows_per_file, False, meta)
    finally:
        fs.delete(p(work), True)


def compact(spark: SparkSession, path: str, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Rewrite the files with less than half of ``rows_per_file`` rows together."""
    path = path.rstrip("/")
    base = head(spark, path)
    small = [r[0] for r in files(spark, path, base).where(F.col("rows") < rows_per_file / 2).select("file").collect()]
    if len(small) < 2:
        return base["version"]
    return _put(spark, path, base, _scan(spark, path, _schema(base), small), base["key"], small, rows_per_file, False)


def vacuum(spark: SparkSession, path: str, keep: int = 2, older_than: float = 86_400.0) -> int:
    """Drop all versions but the newest ``keep`` and the data files that none of these holds; returns the files removed.

    Files younger than ``older_than`` seconds stay: they may belong to a write that is under way.
    """
    path = path.rstrip("/")
    if keep < 1:
        raise ValueError("the newest version is kept")
    known = versions(spark, path)
    kept = [head(spark, path, v) for v in known[-keep:]]
    used = {r[0] for h in kept for r in files(spark, path, h).select("file").collect()}
    writes = {w for h in kept for w in h["writes"]}
    p, fs = _fs(spark, path)
    for v in known[:-keep]:
        fs.delete(p(_version_file(path, v)), False)
    limit, gone = (time.time() - older_than) * 1000, 0
    for s in fs.listStatus(p(f"{path}/_data")) if fs.exists(p(f"{path}/_data")) else []:
        for f in fs.listStatus(s.getPath()):
            name = f"_data/{s.getPath().getName()}/{f.getPath().getName()}"
            if f.getModificationTime() < limit and name not in used and name.endswith(".parquet"):
                gone += bool(fs.delete(f.getPath(), False))
    for s in fs.listStatus(p(f"{path}/_log")):
        if s.isDirectory() and s.getModificationTime() < limit and s.getPath().getName() not in writes:
            fs.delete(s.getPath(), True)
    return gone
