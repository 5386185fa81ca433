"""Periodic runs of words: maximal stretches that repeat a block of words, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q and a length of at least ``max(min_words, 4 q)``
that no neighbouring word extends with period q. The runs come from longest common extensions: a suffix tree of
the words and one of their reversal are built by Ukkonen's algorithm, the Euler tour of a tree (the visits between
two children) answers lowest-common-ancestor questions in constant time, the two tours' leaf orders give for every
word the longest Lyndon word that starts there under an order of the words and under the reversed one, and each
such root is extended to both sides. Every run has a root among them.

Trees cost some hundred bytes a word, so they are built for the stretches that can hold a run and not for all
words: in a run of period q every sequence of m <= q + 1 words occurs three times, the nearest two at most q apart.
Testing this for m = 2, 4, 8, ... (periods m - 1 to 2 m - 2 each) with whole arrays leaves out only words in no run.

Rows are independent (no shuffle); a task holds the words of some documents and two trees of one stretch, one after
the other. Null or empty text: no words, no run, empty result. Repeated rows and null ids are rows like others.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregrid.llm.common import map_batches

MIN_WORDS, TIMES = 6, 4  # a run has MIN_WORDS words and TIMES periods at least
WORDS = 1 << 18  # words looked at together; a longer document is looked at by itself
CELL = 16
TYPE = "array<struct<start:long,length:long,period:long>>"


class Tree:
    """The suffix tree of a sequence of numbers from 1 on, closed by a 0 that occurs nowhere else (Ukkonen)."""

    def __init__(self, s: list[int]):
        s, width = [*s, 0], max(s) + 1
        n = len(s)
        first, last, link, go = [0], [0], [0], {}
        node = edge = depth = left = 0  # where the next suffix goes on, and how many are still to be added
        for i, c in enumerate(s):
            left += 1
            open_ = 0  # the inner node that has no suffix link yet
            while left:
                if not depth:
                    edge = i
                key = node * width + s[edge]
                kid = go.get(key)
                if kid is None:
                    go[key] = len(first)
                    first.append(i)
                    last.append(n)
                    link.append(0)
                    if open_:
                        link[open_] = node
                    open_ = 0
                else:
                    at = first[kid]
                    size = last[kid] - at
                    if depth >= size:
                        node, edge, depth = kid, edge + size, depth - size
                        continue
                    if s[at + depth] == c:
                        depth += 1
                        if open_:
                            link[open_] = node
                        break
                    inner = go[key] = len(first)
                    first += (at, i)
                    last += (at + depth, n)
                    link += (0, 0)
                    first[kid] = at + depth
                    go[inner * width + c] = inner + 1
                    go[inner * width + s[at + depth]] = kid
                    if open_:
                        link[open_] = inner
                    open_ = inner
                left -= 1
                if node:
                    node = link[node]
                elif depth:
                    depth -= 1
                    edge = i - left + 1
        keys, kids = np.fromiter(go.keys(), np.int64, len(go)), np.fromiter(go.values(), np.int64, len(go))
        order = np.argsort(keys)
        self.n, self.kids = n, kids[order]
        self.begin = np.searchsorted(keys[order], np.arange(len(first) + 1) * width).tolist()
        self.length = [b - a for a, b in zip(first, last, strict=True)]

    def tour(self, falling: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The leaves' suffixes in order, and the depth at each visit of the tour between two leaves next to each other.

        ``falling`` reverses the order of the numbers; the closing 0 stays the smallest.
        """
        n, begin, kids, length = self.n, self.begin, self.kids.tolist(), self.length
        suffix, between = [], []
        todo = [(0, 0, -1)]  # node, its depth, the depth of its parent if it is not the first child
        while todo:
            node, depth, above = todo.pop()
            if above >= 0:
                between.append(above)
            a, b = begin[node], begin[node + 1]
            if a == b:
                suffix.append(n - depth)
                continue
            own = kids[a:b]
            if falling:  # a child that is reached by the closing 0 alone is a leaf of one number
                closing = length[own[0]] == 1 and begin[own[0]] == begin[own[0] + 1]
                own = [own[0], *own[:0:-1]] if closing else own[::-1]
            todo += [(k, depth + length[k], depth) for k in own[:0:-1]]
            todo.append((own[0], depth + length[own[0]], -1))
        return np.array(suffix), np.array(between, np.int64)


class Extensions:
    """Longest common extensions to the right, from the tour of a suffix tree: each is the least depth between two leaves."""

    def __init__(self, suffix: np.ndarray, between: np.ndarray):
        self.rank = np.empty(len(suffix), np.int64)
        self.rank[suffix] = np.arange(len(suffix))
        cells = np.append(between, np.full(-len(between) % CELL, between.max(initial=0))).reshape(-1, CELL)
        self.depth = cells.ravel()
        self.head = np.minimum.accumulate(cells, axis=1).ravel()
        self.tail = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
        self.least = [cells.min(axis=1)]  # over 1, 2, 4, ... cells
        while (w := 1 << len(self.least) - 1) * 2 <= len(cells):
            self.least.append(np.minimum(self.least[-1][:-w], self.least[-1][w:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For different suffixes i and j."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b), np.maximum(a, b) - 1
        c, d = low // CELL, high // CELL
        out = np.minimum(self.tail[low], self.head[high])
        far = np.flatnonzero(d - c > 1)
        k = np.frexp((d - c - 1)[far])[1] - 1
        for level in np.unique(k):
            at = far[k == level]
            out[at] = np.minimum(out[at], np.minimum(self.least[level][c[at] + 1], self.least[level][d[at] - (1 << level)]))
        one = np.flatnonzero(c == d)
        x, y = low[one], high[one]
        out[one] = np.min([self.depth[np.minimum(x + t, y)] for t in range(CELL)], axis=0) if len(one) else 0
        return out


def lyndon_ends(rank: list[int]) -> np.ndarray:
    """Where the longest Lyndon word from each place ends: at the next smaller suffix."""
    n = len(rank)
    end = [n] * n
    for i in range(n - 2, -1, -1):
        j, r = i + 1, rank[i]
        while j < n and rank[j] > r:
            j = end[j]
        end[i] = j
    return np.array(end)


def runs(s: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """(start, length, period) of every run of a sequence of numbers, by start, then period."""
    n = len(s)
    names = (np.unique(s, return_inverse=True)[1] + 1).tolist()
    tree = Tree(names)
    suffix, between = tree.tour()
    right = Extensions(suffix, between)
    other = np.empty(n + 1, np.int64)
    other[tree.tour(falling=True)[0]] = np.arange(n + 1)
    ends = [lyndon_ends(rank[:n].tolist()) for rank in (right.rank, other)]
    del tree, suffix, between
    back = Extensions(*Tree(names[::-1]).tour())
    i = np.tile(np.arange(n), 2)
    p = np.concatenate(ends) - i
    keep = (p * TIMES <= n)
    i, p = np.unique(np.stack([i[keep], p[keep]]), axis=1)
    length = p + right(i, i + p)  # i + p = n is the closing 0
    behind = np.zeros(len(i), np.int64)
    k = np.flatnonzero(i > 0)
    behind[k] = back(n - i[k], n - i[k] - p[k])
    out = np.stack([i - behind, length + behind, p], axis=1)
    out = np.unique(out[out[:, 1] >= np.maximum(min_words, TIMES * p)], axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def possible(s: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Which places may lie in a run; names of one document do not occur in another."""
    n, live = len(s), np.zeros(len(s), bool)
    _, name, count = np.unique(s, return_inverse=True, return_counts=True)
    alive, m = count[name] >= TIMES, 1
    while True:
        at = np.flatnonzero(alive[:n - m] & alive[m:]) if m < n else np.array([], int)
        if not len(at):
            return live
        _, pair, count = np.unique(name[at] * (n + 1) + name[at + m], return_inverse=True, return_counts=True)
        name = np.zeros(n, np.int64)
        m *= 2
        name[at] = pair
        alive = np.zeros(n, bool)
        alive[at] = count[pair] >= 3
        by = np.argsort(pair, kind="stable")
        near = np.flatnonzero((np.diff(pair[by]) == 0) & (np.diff(at[by]) <= 2 * m - 2))
        close = np.zeros(n + 2, np.int8)
        close[1 + at[by[near]]] = close[1 + at[by[near + 1]]] = 1
        edge = np.flatnonzero(np.diff(close))  # in turn the first place of a stretch and the place after its last
        long = np.flatnonzero(edge[1::2] - edge[::2] >= max(min_words, TIMES * (m - 1)) - m + 1)
        for a, b in zip(edge[2 * long], edge[2 * long + 1], strict=True):
            live[a:b + m - 1] = True


def find_in(docs: list[list[bytes]], min_words: int = MIN_WORDS) -> list[np.ndarray]:
    """The runs of each document, given as words."""
    ids: dict[bytes, int] = {}
    named = [np.fromiter((ids.setdefault(w, len(ids)) for w in d), np.int64, len(d)) for d in docs]
    out = [np.zeros((0, 3), np.int64) for _ in docs]
    sizes = [len(d) for d in docs]
    if not ids:
        return out
    which = np.repeat(np.arange(len(docs)), sizes)
    base = np.concatenate([[0], np.cumsum(sizes)])
    s = np.concatenate(named)
    live = possible(which * len(ids) + s, min_words)
    at = np.flatnonzero(live)
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(which[at]) > 0)) + 1
    for part in np.split(at, cut) if len(at) else []:
        if len(part) >= min_words:
            found, doc = runs(s[part], min_words), which[part[0]]
            found[:, 0] += part[0] - base[doc]
            out[doc] = np.concatenate([out[doc], found])
    return out


def collapse(words: list[bytes], found: np.ndarray) -> bytes:
    """The words joined by blanks, without those that lie in a run after its first period."""
    if not len(found):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    keep = np.cumsum(change[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of every text by start, then period, and the text without repeats.

    Words are stretches without ``[\\x20\\x09-\\x0D]``; runs count them from 0. ``collapsed`` joins the remaining
    words by one space.
    """

    def make():
        def step(c):
            words = [(t or "").encode().split() for t in c["text"]]  # of bytes: at these six characters alone
            found, group, size = [], [], 0
            for w in words:
                if group and size + len(w) > WORDS:
                    found += find_in(group, min_words)
                    group, size = [], 0
                group.append(w)
                size += len(w)
            found += find_in(group, min_words)
            rows = [[{"start": a, "length": b, "period": p} for a, b, p in f.tolist()] for f in found]
            return {"doc_id": c["doc_id"], "n_words": [len(w) for w in words], "runs": rows,
                    "collapsed": pa.array([collapse(w, f).decode() for w, f in zip(words, found, strict=True)], pa.string())}

        return step

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return map_batches(src, make, f"doc_id long, n_words long, runs {TYPE}, collapsed string")


def strongest(found: str = "runs"):
    """The run with the greatest length / period, compared exactly; ties: the smallest start, then period."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    none = F.lit(None).cast(re.sub(r"^array<(.*)>$", r"\1", TYPE))
    return F.aggregate(found, none, lambda best, x: F.when(best.isNull() | more(x, best), x).otherwise(best))
