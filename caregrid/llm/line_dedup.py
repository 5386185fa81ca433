"""Line deduplication over levelled sorted runs of line hashes (DataFrame operations only).

A run is a table of (key hash, documents, largest doc_id), bucketed and sorted by the hash; no key lies in two runs.
A batch of documents is reduced to one row per key, bucketed likewise, and merge-anti-joined with every run in turn:
the keys that no run holds become the batch's own run, and only the others, known from earlier batches, are kept as
additions to the counts. When ``fanout`` runs stand on a level they are merged into one run of the next level; a run
starts on the level of its batch's size, so few runs are open at any time. Equal bucketing lets these joins read the runs without shuffling them again. At the end a
key's count is that of its run and its additions; keys that never came again need no look-up.

Batches double in size, from ``first_lines`` lines on: their number grows with the logarithm of the input, and all
anti-joins together read a small multiple of the keys. A document lies in one batch whole.

Key: the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; only keys of ``min_chars`` code
points and more are looked at. A key in ``min_docs`` documents or more loses all its lines except in the
largest doc_id that holds it (all of its lines there stay). Null or empty text: one empty line. Rows with a
null doc_id count as one document, smaller than any other; repeated rows of a doc_id are one document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caregrid.llm.common import lower_az, shared_path, stored, text_or_empty

SPACE = " \t\n\x0b\f\r"
MIN_CHARS, MIN_DOCS = 40, 5
FIRST_LINES, FANOUT = 25_000, 2


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, line, h1, h2): every line whose key is long enough; h1 and h2 are 128 bits of its MD5."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("line", "body"))
    # lower-casing A-Z keeps the length, so that only the lines that stay are lower-cased
    long = each.withColumn("trimmed", F.btrim("body", F.lit(SPACE))).where(F.char_length("trimmed") >= min_chars)
    return long.select("doc_id", "text_hash", "line", F.md5(lower_az(F.col("trimmed"))).alias("md5")).select(
        "doc_id", "text_hash", "line", _half("md5", 1).alias("h1"), _half("md5", 17).alias("h2"))


def _half(md5: str, start: int) -> Column:
    """16 hex digits as a (signed) long."""
    return F.conv(F.substring(md5, start, 16), 16, -10).cast("long")


class Runs:
    """The runs of a line store, by level, and the additions to the counts of their keys."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, list[str]] = {}
        self.additions: list[DataFrame] = []
        self.made: list[str] = []

    def tables(self) -> list[str]:
        return [t for level in sorted(self.levels, reverse=True) for t in self.levels[level]]

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.made.append(name)
        (df.select("h1", "h2", "docs", "largest").repartition(self.buckets, "h1")
         .write.bucketBy(self.buckets, "h1").sortBy("h1", "h2").option("path", shared_path(self.spark, name)).saveAsTable(name))
        return name

    def add(self, lines: DataFrame, level: int = 0) -> None:
        """One batch: (doc_id, h1, h2), whole documents; its run starts on this level."""
        own = lines.groupBy("h1", "h2", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d")).agg(F.lit(1).alias("one"))
        own = own.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("d").alias("largest"))
        if not self.levels:
            self.levels[level] = [self._write(own)]
            return
        batch = self._write(own)
        new = self.spark.table(batch)
        for t in self.tables():  # what no run holds yet
            new = new.join(self.spark.table(t).select("h1", "h2"), ["h1", "h2"], "left_anti")
        run = self._write(new)
        known = self.spark.table(batch).join(self.spark.table(run).select("h1", "h2"), ["h1", "h2"], "left_anti")
        self.additions.append(stored(known.select("h1", "h2", "docs", "largest"), "line-additions"))
        self._drop(batch)
        self.levels.setdefault(level, []).append(run)
        self._compact(level)

    def _compact(self, level: int) -> None:
        while len(self.levels.get(level, [])) >= self.fanout:
            old = self.levels.pop(level)
            self.levels.setdefault(level + 1, []).append(self._write(self._all(old)))
            for t in old:
                self._drop(t)
            level += 1

    def _all(self, tables: list[str]) -> DataFrame:
        rows = self.spark.table(tables[0])
        for t in tables[1:]:
            rows = rows.union(self.spark.table(t))
        return rows

    def resolved(self, min_docs: int = 1) -> DataFrame:
        """(h1, h2, docs, largest) of the keys in at least ``min_docs`` documents."""
        if not self.levels:
            raise ValueError("the line store is empty")
        keys = self._all(self.tables())
        if self.additions:
            more = self.additions[0]
            for a in self.additions[1:]:
                more = more.union(a)
            more = more.groupBy("h1", "h2").agg(F.sum("docs").alias("more"), F.max("largest").alias("later"))
            keys = keys.join(more, ["h1", "h2"], "left").select(
                "h1", "h2", (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"), F.greatest("largest", "later").alias("largest"))
        return keys.where(F.col("docs") >= min_docs)

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.made.remove(table)

    def forget(self) -> None:
        """Take the runs out of the catalog; their files stay in the shared folder."""
        for t in list(self.made):
            self._drop(t)
        self.levels, self.additions = {}, []


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, first_lines: int = FIRST_LINES,
                  fanout: int = FANOUT, buckets: int | None = None) -> DataFrame:
    """(doc_id, text_hash, dropped array<int>): the line numbers that a document loses; only documents that lose any."""
    lines = stored(long_lines(docs, min_chars), "line-keys")
    batches = (max(1, -(-lines.count() // first_lines)) - 1).bit_length() + 1
    # of 2 ** (batches - 1) parts the first batch has part 0, the second part 1, then 2 and 3, then 4 to 7, ...
    part = F.pmod(F.xxhash64(F.lit("batch"), "doc_id"), F.lit(1 << batches - 1))
    runs = Runs(docs.sparkSession, fanout, buckets)
    try:
        for i in range(batches):
            runs.add(lines.where((part >= (1 << i >> 1)) & (part < (1 << i))).select("doc_id", "h1", "h2"), max(0, i - 1))
        frequent = stored(runs.resolved(min_docs).select("h1", "h2", "largest"), "frequent-lines")
    finally:
        runs.forget()
    lost = lines.join(frequent, ["h1", "h2"]).where(F.coalesce("doc_id", F.lit(-(1 << 63))) < F.col("largest"))
    return lost.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("dropped"))


def deduplicated(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` with the struct ``__lines`` (n_lines, n_dropped, kept text) beside all their columns."""
    lost = dropped_lines(docs, **params).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("dropped").alias("__dropped"))
    d = docs.select("*", F.col("doc_id").cast("long").alias("__doc_id"), F.xxhash64("text").alias("__text_hash"))
    d = d.join(lost, F.col("__doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left")
    lines = F.split(text_or_empty(), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__dropped", i)), "\n")
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(
        F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("__dropped").isNull(), text_or_empty()).otherwise(kept).alias("kept")).alias("__lines"))


def dedup_lines(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with the remaining lines as text and n_chars, if there, to match; all rows and columns stay."""
    d = deduplicated(docs, **params).withColumn("text", F.when(F.col("__lines.n_dropped") == 0, F.col("text")).otherwise(F.col("__lines.kept")))
    if "n_chars" in docs.columns:
        same = F.when(F.col("__lines.n_dropped") == 0, F.col("n_chars")).otherwise(F.char_length("text"))
        d = d.withColumn("n_chars", same.cast(docs.schema["n_chars"].dataType))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns])
