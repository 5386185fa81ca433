"""Mixing sources to target weights.

Every source gets a target number of words (a share of the total by weight, at most ``max_passes`` times its
own size). Its documents are dealt by hash into blocks; the blocks, in hash order and pass after pass, are its
draw sequence, and the exact block quota is the part of it that covers the target: whole blocks, and of the
last one the documents that fit, largest first, so that the words taken end near the target. A
multivariate-hypergeometric splitting tree then divides the quotas among the output shards: each node splits
its quota vector between its halves, a leaf's vector is the contents of one shard, and shards own disjoint
ranges of each source's sequence. A leaf is computed from the quotas and the seed alone, so leaves run in
parallel and reruns agree. Inside a shard the copies lie in hash order.

Null source: a source of its own, last. Null text: size 0. Rows equal in doc_id and text get equal keys and
are told apart by count; empty input gives no rows. More than ``MAX_SOURCES`` sources are refused, not cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caregrid.llm.common import map_batches, stored, text_or_empty

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MAX_PASSES = 1.5, 2.0
BLOCK_DOCS, SHARD_BLOCKS, SEED = 128, 64, 7
GROUP = 4096  # blocks whose running total is taken in one task
MAX_SOURCES = 100_000  # the tree holds one number per source; more raise an error


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_hash, size): size is the number of white-space separated words."""

    def make():
        return lambda c: {**{n: c[n] for n in ("doc_id", "source", "text_hash")}, "size": [len(t.split()) for t in c["text"]]}

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                      F.xxhash64("text").alias("text_hash"), text_or_empty().cast("binary").alias("text"))
    return map_batches(src, make, "doc_id long, source string, text_hash long, size long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_PASSES) -> DataFrame:
    """(source, docs, source_size, position, target): one row per source."""
    s = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    s = stored(s.select("*", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("position")), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("position", F.lit(len(weights))) + 1).cast("int"))
    cap = F.lit(float(most)) * F.col("source_size")
    s = s.withColumn("weight", weight)
    level, full = None, 0
    while True:  # each round caps at least one more source, or is the last
        free = F.lit(True) if level is None else F.col("weight") * F.lit(level) <= cap
        r = s.agg(F.sum("source_size").alias("all"), F.sum(F.when(~free, cap)).alias("capped"),
                  F.sum(F.when(free, F.col("weight"))).alias("w"), F.count(F.when(~free, 1)).alias("n")).first()
        if level is not None and r["n"] == full or not r["w"]:
            break
        level, full = (share * (r["all"] or 0) - (r["capped"] or 0)) / r["w"], r["n"]
    return s.withColumn("target", F.least(cap, F.col("weight") * F.lit(level or 0.0)))


def _running(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The sum of ``value`` before each row, in two steps so that no task takes a whole source."""
    part = F.floor(F.col(order) / GROUP)
    df = df.withColumn("__part", part)
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = df.groupBy(by, "__part").agg(F.sum(value).alias("__sum")).withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    inner = Window.partitionBy(by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (df.join(whole.select(by, "__part", "__base"), [by, "__part"])
            .withColumn("start", F.col("__base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("__part", "__base"))


def split_leaf(quotas: np.ndarray, shards: int, leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each source's range starts and how many blocks it has in this leaf of the splitting tree."""
    total = int(quotas.sum())
    edge = lambda i: total * i // shards  # noqa: E731  slots before shard i
    lo, hi, start, own = 0, shards, np.zeros_like(quotas), quotas.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = np.empty_like(own)
        rest, slots = int(own.sum()), edge(mid) - edge(lo)
        for i, n in enumerate(own.tolist()):  # the marginals of a multivariate hypergeometric draw
            rest -= n
            left[i] = k = int(rng.hypergeometric(n, rest, slots)) if slots and n + rest else 0
            slots -= k
        if leaf < mid:
            hi, own = mid, left
        else:
            lo, start, own = mid, start + left, own - left
    return start, own


def plan(sizes: DataFrame, seed: int = SEED, block_docs: int = BLOCK_DOCS, shard_blocks: int = SHARD_BLOCKS, **targets) -> tuple[DataFrame, DataFrame]:
    """(rows, sources). rows: sizes with source_size, target and ``shards``, the output shard of each copy taken."""
    spark = sizes.sparkSession
    src = source_targets(sizes, **targets)
    key = F.xxhash64(F.lit(seed), "doc_id", "text_hash")
    rows = sizes.join(src.select(F.col("source").alias("__source"), "docs", "source_size", "position", "target"),
                      F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = stored(rows.select("*", key.alias("key"), F.pmod(key, F.ceil(F.col("docs") / block_docs)).alias("block")), "mix-rows")

    blocks = rows.groupBy("position", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    blocks = _running(blocks, "position", "block", "words")
    copies = F.explode(F.array(F.lit(0), F.lit(1)))
    drawn = blocks.select("*", copies.alias("pass")).withColumn("start", F.col("start") + F.col("pass") * F.col("source_size"))
    drawn = drawn.where((F.col("words") > 0) & (F.col("start") < F.col("target")))
    drawn = stored(drawn.select("position", "block", "pass", (F.col("target") - F.col("start")).alias("room"), "words"), "mix-blocks")

    # the one block of a source that ends beyond the target: documents that fit, largest first
    part = drawn.where("words > room")
    import pandas as pd

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable")
        room, n = float(pdf["room"].iloc[0]) + 0.5, []
        for size, count in zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True):
            k = min(count, int(room // size)) if size else 0
            room -= k * size
            n.append(k)
        return pd.DataFrame({"position": pdf["position"], "block": pdf["block"], "key": pdf["key"], "fits": n})

    inside = rows.join(part.select("position", "block", "room"), ["position", "block"])
    inside = inside.groupBy("position", "block", "key", "size", "room").agg(F.count("*").alias("n"))
    chosen = inside.groupBy("position").applyInPandas(fit, "position int, block long, key long, fits long").where("fits > 0")
    chosen = stored(chosen.select(*[F.col(c).alias(f"c_{c}") for c in ("position", "block", "key")], "fits"), "mix-chosen")

    # exact quotas, the tree, and the shard of every drawn block
    per = drawn.groupBy("position").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()  # one number per source
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: mix groups of sources")
    quotas = {r["position"]: r["n"] for r in per}
    order = sorted(quotas)
    q = np.array([quotas[p] for p in order], np.int64)
    shards = max(1, -(-int(q.sum()) // shard_blocks)) if order else 1

    def leaves(batches):
        for b in batches:
            for leaf in b.column(0).to_pylist():
                start, own = split_leaf(q, shards, leaf, seed)
                i = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([order[x] for x in i], pa.int32()), pa.array(start[i], pa.int64()),
                                                  pa.array(own[i], pa.int64()), pa.array([leaf] * len(i), pa.int64())],
                                                 names=["position", "lo", "n", "shard"])

    owned = spark.range(shards).mapInArrow(leaves, "position int, lo long, n long, shard long") if order else spark.createDataFrame(
        [], "position int, lo long, n long, shard long")
    owned = owned.select("position", "shard", F.explode(F.sequence("lo", F.col("lo") + F.col("n") - 1)).alias("place"))
    seq = _running(drawn.withColumn("one", F.lit(1)).withColumn("nth", F.col("pass") * F.lit(1 << 40) + F.col("block")), "position", "nth", "one")
    placed = seq.select("position", "block", "pass", (F.col("words") > F.col("room")).alias("partial"), F.col("start").alias("place")).join(
        owned, ["position", "place"]).groupBy("position", "block").agg(
        F.sort_array(F.collect_list(F.struct("pass", "partial", "shard"))).alias("draws"))  # two at most
    rows = rows.join(placed, ["position", "block"], "left").join(
        chosen, (F.col("position") == F.col("c_position")) & (F.col("block") == F.col("c_block")) & (F.col("key") == F.col("c_key")), "left")
    rows = rows.withColumn("twin", F.when(F.col("fits").isNull(), 0).otherwise(
        F.row_number().over(Window.partitionBy("position", "block", "key").orderBy("doc_id"))))
    taken = F.filter(F.coalesce("draws", F.expr("array()").cast("array<struct<pass:int,partial:boolean,shard:bigint>>")),
                     lambda d: ~d["partial"] | (F.coalesce("fits", F.lit(0)) >= F.col("twin")) & F.col("fits").isNotNull())
    rows = rows.withColumn("shards", F.transform(taken, lambda d: d["shard"]))
    return rows.select("doc_id", "source", "text_hash", "size", "source_size", "target", "key", "shards"), src


def mixture(docs: DataFrame, **params) -> DataFrame:
    """The mixed documents, every column as it was, a row per copy; ordered by shard and, inside it, by hash."""
    rows, _ = plan(stored(sized(docs), "mix-sizes"), **params)
    times = rows.where(F.size("shards") > 0).groupBy("doc_id", "text_hash", "source", "key").agg(
        F.collect_list("shards").alias("__all"))  # more than one only for equal rows
    times = times.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("source").alias("__source"),
                         F.col("key").alias("__key"), "__all")
    d = docs.select(F.struct("*").alias("__doc"), F.col("doc_id").cast("long").alias("__d"), F.xxhash64("text").alias("__t"),
                    F.col("source").cast("string").alias("__s"))
    same = F.col("__d").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__hash")) & F.col("__s").eqNullSafe(F.col("__source"))
    one = d.join(times, same)
    nth = F.when(F.size("__all") == 1, 1).otherwise(F.row_number().over(
        Window.partitionBy("__d", "__t", "__s").orderBy(F.xxhash64("__doc"))))
    one = one.withColumn("__nth", nth).where(F.col("__nth") <= F.size("__all"))
    out = one.select("__doc", "__key", F.posexplode(F.element_at("__all", F.col("__nth"))).alias("__copy", "__shard"))
    out = out.repartitionByRange("__shard", "__key").sortWithinPartitions("__shard", F.xxhash64("__shard", "__key", "__copy"))
    return out.select("__doc.*")
