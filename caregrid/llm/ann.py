"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a unit vector by ``bits`` projections on Gaussian directions, each cut into cells of one width.
A query visits, in every table, its own bucket and then perturbed ones: a perturbation moves some projections
to a neighbouring cell, and sets of them are visited in the order of their estimated success, the sum of the
expected squared distances to the cell borders crossed. The candidates of all tables are merged and ranked
exactly by cosine in double precision. Hash functions come from a seed, so all blocks share them, and every
row is indexed. Recall against brute force is measured in the tests and given in the README.

Vectors that are null, zero, or hold null or non-finite components take no part; equal vectors are searched
once and give ties by id; fewer rows than k give all of them, as a query that meets too few rows of a block to
fill its answer is compared with all of the block.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregrid.llm import blocks

K, TABLES, BITS, WIDTH, PROBES, SEED = 5, 6, 12, 3.0, 300, 11


def probe_sets(projections: int, probes: int) -> np.ndarray:
    """Perturbation sets as 0/1 rows over the 2 * projections border distances in ascending order, best first.

    The expected square of the j-th smallest of the distances is what a set pays for j; a set may not cross
    both borders of one projection, whose distances are the j-th smallest and the j-th largest.
    """
    m = projections
    j = np.arange(1, m + 1)
    low = j * (j + 1) / (4 * (m + 1) * (m + 2))
    i = np.arange(m + 1, 2 * m + 1)
    cost = np.concatenate([low, 1 - (2 * m + 1 - i) / (m + 1) + (2 * m + 1 - i) * (2 * m + 2 - i) / (4 * (m + 1) * (m + 2))])
    out, heap = [np.zeros(2 * m, np.uint64)], [(float(cost[0]), (0,))]
    while heap and len(out) < probes:
        c, s = heapq.heappop(heap)
        if len({min(x, 2 * m - 1 - x) for x in s}) == len(s):
            row = np.zeros(2 * m, np.uint64)
            row[list(s)] = 1
            out.append(row)
        if s[-1] + 1 < 2 * m:
            step = float(cost[s[-1] + 1])
            heapq.heappush(heap, (c - float(cost[s[-1]]) + step, (*s[:-1], s[-1] + 1)))
            heapq.heappush(heap, (c + step, (*s, s[-1] + 1)))
    return np.stack(out)


def lsh_best(tables: int = TABLES, bits: int = BITS, width: float = WIDTH, probes: int = PROBES, seed: int = SEED):
    """The function that finds a block's nearest rows for a block of queries."""

    def best(q: np.ndarray, x: np.ndarray, keep: int):
        rng = np.random.default_rng(seed)
        dim = q.shape[1]
        direction, shift = rng.standard_normal((dim, tables * bits)), rng.uniform(0, width, tables * bits)
        mix = rng.integers(1, 1 << 63, tables * bits, dtype=np.uint64) | np.uint64(1)
        sets = probe_sets(bits, probes)
        xn, qn = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)

        def cells(v, norm):
            at = (v / norm[:, None] @ direction + shift) / width
            low = np.floor(at)
            return low.astype(np.int64).view(np.uint64) * mix, at - low

        x_code, _ = cells(x, xn)
        x_code = np.ascontiguousarray(x_code.reshape(len(x), tables, bits).sum(axis=2, dtype=np.uint64).T)
        order = np.argsort(x_code, axis=1, kind="stable")
        x_code = np.take_along_axis(x_code, order, axis=1)
        q_code, into = cells(q, qn)
        q_code = q_code.reshape(len(q), tables, bits).sum(axis=2, dtype=np.uint64)
        into, own = into.reshape(len(q), tables, bits), mix.reshape(tables, bits)
        found = ([], [], [])
        for i in range(len(q)):
            seen = np.zeros(len(x), bool)
            border = np.concatenate([into[i], 1 - into[i]], axis=1)  # down, up
            move = np.take_along_axis(np.concatenate([np.uint64(0) - own, own], axis=1), np.argsort(border, axis=1, kind="stable"), axis=1)
            codes = q_code[i][:, None] + move @ sets.T
            for t in range(tables):
                lo, hi = np.searchsorted(x_code[t], codes[t], "left"), np.searchsorted(x_code[t], codes[t], "right")
                size = hi - lo
                if (total := int(size.sum())):
                    at = np.arange(total) + np.repeat(lo - (np.cumsum(size) - size), size)
                    seen[order[t, at]] = True
            c = np.flatnonzero(seen)
            if len(c) < keep:  # too few met for a full answer: all rows
                c = np.arange(len(x))
            score = x[c] @ q[i] / (xn[c] * qn[i])
            near = np.argpartition(-score, min(keep, len(c)) - 1)[:keep]
            near = np.flatnonzero(score >= score[near].min())  # with every tie
            top = near[np.lexsort((c[near], -score[near]))][:keep]
            for out, v in zip(found, (np.full(len(top), i), c[top], score[top]), strict=True):
                out.append(v)
        return tuple(np.concatenate(f) if f else np.empty(0, np.int64 if n < 2 else float) for n, f in enumerate(found))

    return best


def nearest(vectors: DataFrame, k: int = K, every: int = 50, **params) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose vec_id is divisible by ``every``."""
    sizes = {n: params.pop(n) for n in ("rows", "queries") if n in params}
    return blocks.search(vectors, F.col("embedding").cast("array<double>"), lsh_best(**params), k, every, **sizes)
