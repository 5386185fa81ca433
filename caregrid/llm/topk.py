"""Exact top-k inner products over an impact-ordered index, score at a time.

Components are quantised to integers; a posting list per dimension holds the block's rows ordered by value,
so that from either end its segments come in the order of their impact on a query (the query's component
times the value). A query processes the segments of all dimensions level by level, by descending impact,
adding to accumulators. After each level, a row's unprocessed components can add no more than the level
each, and no more than the first unprocessed impacts of all lists together; some rows of high partial scores
are rescored exactly, and the k-th best of these is a score that every member reaches. Rows whose upper bound
falls short of it are out by proof. The search stops as soon as rescoring all that are left takes less than the
next level (``COST``: a posting against a component rescored), or after the last level, and rescores them exactly.

Sums that might leave 62 bits (dimensions x largest components of query and rows) are taken with Python's integers;
a result that no long can hold is an error. Vectors that are null or hold null or non-finite components
take no part (zero vectors do); ties go to the smaller id; fewer rows than k give all of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregrid.llm import blocks

K, SCALE = 5, 256
# The levels as parts of the largest impact; the stop test follows each.
LEVELS = (0.75, 0.55, 0.4, 0.3, 0.22, 0.16, 0.11, 0.07, 0.04, 0.02, 0.0, -0.05, -0.15)
COST = 8.0
ROWS, QUERIES = 32_768, 8_192  # a block of rows, whose index serves this many queries


class Index:
    """The posting lists of a block, and ``read``: postings processed of those there were."""

    def __init__(self, x: np.ndarray):
        self.x = x
        order = np.argsort(x, axis=0, kind="stable")
        value = np.take_along_axis(x, order, axis=0)
        self.posting, self.value = np.ascontiguousarray(order.T.astype(np.int32)), np.ascontiguousarray(value.T)
        self.read = self.there = 0
        self.wide = x if x.dtype == object else x.astype(np.float64)

    def exact(self, rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The products of these rows; by way of floats where these hold every sum exactly."""
        if self.x.dtype == object or len(w) * int(np.abs(w).max(initial=0)) * int(np.abs(self.value[:, [0, -1]]).max(initial=0)) >= 1 << 53:
            return self.x[rows] @ w
        return (self.wide[rows] @ w.astype(np.float64)).astype(np.int64)

    def members(self, w: np.ndarray, keep: int, levels: tuple[float, ...], cost: float) -> np.ndarray:
        """The rows that can be among the ``keep`` best for ``w``; all rows where nothing could be ruled out."""
        x, value, n = self.x, self.value, len(self.x)
        used = np.flatnonzero(w)
        largest = int(np.maximum(w * value[:, 0], w * value[:, -1]).max(initial=0))
        score, count = np.zeros(n, x.dtype), np.zeros(n, np.int64)
        done = np.zeros(len(w), np.int64)
        member = np.arange(n)
        self.there += n * len(used)
        for part in levels:
            limit = int(np.ceil(largest * part))  # segments of this impact and more are processed
            # from the high end of a list if the query's component is positive, else from the low end
            stops = [n - int(np.searchsorted(value[d], -(-limit // int(w[d])), "left")) if w[d] > 0 else int(np.searchsorted(value[d], limit // int(w[d]), "right"))
                     for d in used]
            if sum(stops) * cost >= int(done.sum()) * cost + len(member) * len(used):
                break  # to rescore the members left takes less than to go on
            rows, impacts = [], []
            for d, stop in zip(used, stops, strict=True):
                if stop > done[d]:
                    own = slice(n - stop, n - done[d]) if w[d] > 0 else slice(done[d], stop)
                    rows.append(self.posting[d, own])
                    impacts.append(value[d, own] * w[d])
                    self.read += stop - int(done[d])
                    done[d] = stop
            if rows:
                at, impact = np.concatenate(rows), np.concatenate(impacts)
                count += np.bincount(at, minlength=n)
                if len(used) * largest < 1 << 52 and x.dtype != object:  # floats hold these sums exactly
                    score += np.bincount(at, impact, n).astype(np.int64)
                else:
                    np.add.at(score, at, impact)
            some = np.argpartition(-score, min(n, 4 * keep) - 1)[:4 * keep]
            least = np.partition(self.exact(some, w), len(some) - keep)[len(some) - keep]  # no k-th best score is lower
            unseen = (len(used) - count).astype(x.dtype) * (limit - 1)
            if limit > 0:
                ahead = [value[d, n - k - 1 if w[d] > 0 else k] * w[d] for d, k in zip(used, stops, strict=True) if k < n]
                unseen = np.minimum(unseen, sum(max(0, int(a)) for a in ahead))
            member = np.flatnonzero(score + unseen >= least)
        return member


MOST = (1 << 63) - 1


def _long(scores: np.ndarray) -> np.ndarray:
    """As longs; what no long holds becomes the largest, which a result may not have (a row's product with itself may)."""
    return scores if scores.dtype != object else np.array([max(-MOST, min(MOST, int(s))) for s in scores], np.int64)


def saat_best(levels: tuple[float, ...] = LEVELS, cost: float = COST):
    """The function that finds a block's best rows."""

    def best(q: np.ndarray, x: np.ndarray, keep: int):
        n, dim = x.shape
        widest = dim * max(map(abs, (int(x.min()), int(x.max())))) * max(map(abs, (int(q.min()), int(q.max()))))
        if widest >= 1 << 62:
            q, x = q.astype(object), x.astype(object)
        index, found = Index(x), ([], [], [])
        for i, w in enumerate(q):
            member = index.members(w, keep, levels, cost) if n > keep else np.arange(n)
            exact = index.exact(member, w)
            near = np.flatnonzero(exact >= np.partition(exact, max(0, len(exact) - keep))[max(0, len(exact) - keep)])
            top = near[np.lexsort((member[near], -exact[near]))][:keep] if exact.dtype != object else np.array(
                sorted(near.tolist(), key=lambda j: (-exact[j], member[j]))[:keep])
            for out, v in zip(found, (np.full(len(top), i), member[top], _long(exact[top])), strict=True):
                out.append(v)
        return tuple(np.concatenate(f) if f else np.empty(0, np.int64) for f in found)

    return best


def top_products(vectors: DataFrame, k: int = K, every: int = 50, scale: int = SCALE, **params) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products for each row whose vec_id is divisible by ``every``."""
    exact = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(
        F.floor(F.lit(float(scale)) * x)).cast("long"))
    found = blocks.search(vectors, exact, saat_best(), k, every, zero_ok=True, score_type="long", **{"rows": ROWS, "queries": QUERIES} | params)
    whole = F.when(F.abs("score") == MOST, F.raise_error(F.lit("OverflowError: a score leaves the range of a long"))).otherwise(F.col("score"))
    return found.withColumn("score", whole)
