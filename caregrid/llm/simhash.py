"""SimHash near-duplicate grouping by tiled exact comparison.

Distinct fingerprints are dealt into tiles by population count. Two fingerprints at most ``radius`` bits
apart have population counts at most ``radius`` apart, so only tile pairs within that difference meet; inside
a pair the same bound, taken over the four 16-bit quarters, skips sub-tiles before the exclusive-or. A pair
emits a spanning forest of its links, never all links, and connected components are found by alternating
star contraction on tables in the shared folder.

Nulls and ties: a null or wordless text has fingerprint zero; a null doc_id takes part but never becomes a
component id unless the whole component has none; repeated rows share a component.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregrid.llm.common import map_batches, stored, text_or_empty

SEED = 42
SHINGLE = 3
RADIUS = 3
TILE = 32_768  # fingerprints of a tile; a task holds two tiles
_CHUNK = 100_000  # shingles whose bits are counted at once


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash over word shingles (ASCII white space, A-Z lower-cased), repeats counted."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    s, e = starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(s), _CHUNK):
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(s[at:at + _CHUNK], e[at:at + _CHUNK], strict=True)])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(s)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, fp): one row per input row; fp is the fingerprint as a signed long."""

    def make():
        def step(c):
            fps = [fingerprint(t, shingle, seed) for t in c["text"]]
            return {"doc_id": c["doc_id"], "text_hash": c["text_hash"],
                    "fp": [x - (1 << 64) if x >> 63 else x for x in fps]}

        return step

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                      text_or_empty().cast("binary").alias("text"))
    return map_batches(src, make, "doc_id long, text_hash long, fp long")


def components_of(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of n nodes over the links (u, v)."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        if not (apart := a != b).any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(label, jump := label[label]):
            label = jump


def _quarters(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int8)


def _subtiles(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by quarter population counts, starts of the sub-tiles, and their lowest and highest counts."""
    q = _quarters(x)
    order = np.lexsort(q.T[::-1])
    starts = np.arange(0, len(x), size)
    return order, starts, np.minimum.reduceat(q[order], starts), np.maximum.reduceat(q[order], starts)


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int, rows: int = 64, cols: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (node, root) fingerprints, of the links between tiles a and b (within a, if b is None)."""
    nodes = a if b is None else np.concatenate([a, b])
    oa, sa, la, ha = _subtiles(a, rows)
    ob, sb, lb, hb = _subtiles(a if b is None else b, cols)
    shift, xb = (0 if b is None else len(a)), (a if b is None else b)[ob]
    xa, u, v, held = a[oa], [], [], 0
    for i, s in enumerate(sa):
        gap = np.maximum(np.maximum(lb - ha[i], la[i] - hb), 0).sum(axis=1)
        near = np.flatnonzero(gap <= radius)
        if not len(near):
            continue
        at = (sb[near][:, None] + np.arange(cols)).ravel()
        at = at[at < len(xb)]
        i1, j1 = np.nonzero(np.bitwise_count(xa[s:s + rows, None] ^ xb[None, at]) <= radius)
        u.append(oa[s + i1])
        v.append(ob[at[j1]] + shift)
        held += len(i1)
        if held > 2_000_000:  # keep a forest only, so that dense groups stay small
            label = components_of(len(nodes), np.concatenate(u), np.concatenate(v))
            u, v = [np.flatnonzero(label != np.arange(len(nodes)))], [label[label != np.arange(len(nodes))]]
            held = len(u[0])
    if not u:
        return nodes[:0], nodes[:0]
    label = components_of(len(nodes), np.concatenate(u), np.concatenate(v))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v): links that connect distinct fingerprints exactly as all links within ``radius`` bits would."""
    import pandas as pd

    of = fps.select("fp", F.bit_count("fp").alias("ones"))
    tiles = of.groupBy("ones").agg(F.ceil(F.count("*") / tile).alias("chunks"))
    dealt = of.join(F.broadcast(tiles), "ones").select(  # 65 rows at most
        "fp", "ones", F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("chunk"))
    each = tiles.select("ones", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    left = each.select("ones", "chunk", F.explode(F.sequence("ones", F.col("ones") + radius)).alias("ones2"))
    right = each.select(F.col("ones").alias("ones2"), F.col("chunk").alias("chunk2"))
    pairs = left.join(right, "ones2").where("ones < ones2 or chunk <= chunk2").select(
        F.struct("ones", "chunk").alias("t1"), F.struct(F.col("ones2").alias("ones"), F.col("chunk2").alias("chunk")).alias("t2"))
    pairs = pairs.withColumn("pair", F.concat_ws(":", "t1.ones", "t1.chunk", "t2.ones", "t2.chunk"))
    sides = pairs.select("pair", F.explode(F.when(F.col("t1") == F.col("t2"), F.array(F.struct("t1", F.lit(0).alias("side")))).otherwise(
        F.array(F.struct("t1", F.lit(0).alias("side")), F.struct(F.col("t2").alias("t1"), F.lit(1).alias("side"))))).alias("s"))
    sides = sides.select("pair", F.col("s.side").alias("side"), F.col("s.t1.ones").alias("ones"), F.col("s.t1.chunk").alias("chunk"))
    met = dealt.join(sides, ["ones", "chunk"]).select("pair", "side", "fp")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, side = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["side"].to_numpy()
        one_tile = pdf["pair"].iloc[0].split(":")
        a, b = x[side == 0], x[side == 1]
        if one_tile[:2] == one_tile[2:]:
            u, v = tile_links(a, None, radius)
        elif len(a) and len(b):
            u, v = tile_links(a, b, radius)
        else:
            u = v = x[:0]
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return met.groupBy("pair").applyInPandas(compare, "u long, v long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node reachable, for every node with a link; alternating star contraction."""

    def turned(e):
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    def large(e):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return turned(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))

    def small(e):
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        return turned(e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")))

    def mark(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = stored(turned(edges), "links")
    before = mark(e)
    while before[0]:
        e = stored(small(large(e)), "links")
        if (now := mark(e)) == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id): root is the same for all rows of a group."""
    rows = stored(with_fingerprints(docs, shingle, seed), "fingerprints")
    own = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fp")
    tree = connected(links(own, radius, tile))
    own = own.join(tree, own.fp == tree.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = own.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(own.select("fp", "root").join(low, "root"), "fp")


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """The documents without near copies: of each group the row with the smallest doc_id stays, whole."""
    from pyspark.sql import Window

    g = near_groups(docs, **params)
    best = g.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.first("component_id").alias("__id"), F.min("text_hash").alias("__hash"))
    best = best.groupBy("__id", "__hash").agg(F.lit(1).alias("__one"))
    d = docs.select(F.struct("*").alias("__doc"), F.col("doc_id").cast("long").alias("__doc_id"), F.xxhash64("text").alias("__text"))
    kept = d.join(best, F.col("__doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")))
    first = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy(F.xxhash64("__doc")))
    return kept.withColumn("__n", first).where("__n = 1").select("__doc.*")
