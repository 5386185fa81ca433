"""A stated query set against all rows, in blocks: the frame that both vector searches share.

Rows are dealt by hash into blocks of a bounded number of vectors and queries into blocks of their own; a task
holds one block of each and hands on its best ``keep`` per query, so memory does not grow with the table and no
list of pairs is made. Equal vectors are searched once: a vector stands for its smallest ids, of which no
result can need more than k + 1.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caregrid.llm.common import stored

ROWS, QUERIES = 32_768, 512


def usable(vectors: DataFrame, vector: Column, zero_ok: bool, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, v, key) of the vectors of finite numbers, and (key, v, ids): distinct ones with their k + 1 smallest ids.

    Vectors of different length share nothing: each length is searched by itself.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), vector.alias("v")).where("id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    v = v.where(~F.coalesce(bad, F.lit(True)))
    if not zero_ok:
        v = v.where(F.exists("v", lambda x: x != 0))
    v = stored(v.withColumn("key", F.sha2(F.to_json("v"), 256)).dropDuplicates(["key", "id"]), "vectors")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    return v, v.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("key").agg(
        F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 at most


def search(vectors: DataFrame, vector: Column, best: Callable, k: int, every: int = 50, zero_ok: bool = False, rows: int = ROWS,
           queries: int = QUERIES, score_type: str = "double") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k best other rows, ties to the smaller id.

    ``best(queries, rows, keep)`` gets two matrices and returns (query index, row index, score) of at least
    the ``keep`` best rows of each query, all rows of a score that it hands on included or the list full.
    """
    all_rows, distinct = usable(vectors, vector, zero_ok, k)
    asked = all_rows.where(F.col("id") % every == 0).select("key", F.col("id").alias("query_id"))
    distinct = stored(distinct.withColumn("dim", F.size("v")), "distinct-vectors")
    q = distinct.join(asked.select("key").distinct(), "key", "left_semi")
    n_rows, n_queries = distinct.count(), q.count()
    b_rows, b_queries = max(1, -(-n_rows // rows)), max(1, -(-n_queries // queries))

    def dealt(df, side, n_own, n_other):
        """The rows under new names (both sides come from one table), in their block, once per block of the other side."""
        return df.select(F.col("dim").alias(f"dim_{side}"), F.pmod(F.xxhash64("key"), F.lit(n_own)).cast("int").alias(f"own_{side}"),
                         F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(f"other_{side}"),
                         F.col("key").alias(f"key_{side}"), F.col("v").alias(f"v_{side}"), F.col("ids")[0].alias(f"low_{side}"))

    left = dealt(q, "q", b_queries, b_rows).groupBy("dim_q", "own_q", "other_q")
    right = dealt(distinct, "r", b_rows, b_queries).groupBy("dim_r", "other_r", "own_r")
    import pandas as pd

    dtype = np.int64 if score_type == "long" else np.float64

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "key": [], "score": []}).astype({"query": object, "key": object, "score": dtype})
        b = b.sort_values("low_r", kind="stable")  # so that equal scores come in the order of ids
        i, j, s = best(np.stack(a["v_q"].to_list()).astype(dtype), np.stack(b["v_r"].to_list()).astype(dtype), k + 1)
        return pd.DataFrame({"query": a["key_q"].to_numpy()[i], "key": b["key_r"].to_numpy()[j], "score": s})

    near = left.cogroup(right).applyInPandas(meet, f"query string, key string, score {score_type}")
    ids = distinct.select("key", "ids")
    near = near.join(ids, "key")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0]))
    near = near.withColumn("place", place).where(F.col("place") <= k + 1).select("query", "score", F.explode("ids").alias("vec_id"))
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    near = near.withColumn("place", first).where(F.col("place") <= k + 1).groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))  # k + 1 at most
    own = asked.join(near, asked.key == near.query).select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
