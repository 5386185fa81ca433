"""Best-fit packing of tokenised documents by bin completion.

Only the histogram of piece lengths (one count per length, so at most ``capacity`` numbers) reaches the
driver. There the search packs length classes: at each node it takes the largest length left, enumerates the
undominated fillings of the remaining room in order of waste (a table of the sums that the lengths can form
leads to them), and applies one filling as many times as the counts allow, so the number of steps does not grow
with the corpus. The incumbent is the best of some descents that take the best fit for the longest pieces and the
filling of least waste for the others; a branch is cut when its waste exceeds what a solution one sequence better
could have. ``nodes`` bounds the time spent on improving the incumbent, never what is packed. The resulting
patterns are given to the pieces by their rank within their length, counted per salted group.

Documents longer than ``capacity`` tokens are cut into full pieces, the first taking the remainder. Null text
is empty: the end token alone. A doc_id may be null or repeated; every row is packed.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caregrid.llm.common import map_batches, stored, text_or_empty

CAPACITY, END = 2048, 0
NODES, FILLINGS, TRIES = 20_000, 64, 2_000
SWITCHES = 24  # descents for an incumbent, before a few more around the best
RUN = 100_000  # white space in a row that is left to the tokenizers library
# Fixed value: the splitting pattern of the byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters stand
    for themselves, the others, in order, for the bytes left."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """A function from a list of texts to the little-endian 32-bit ids of each, as bytes.

    The ids are those of the byte-level BPE in the tokenizers file at ``path``. Its vocabulary, whose ids are
    the merge ranks, is loaded into tiktoken, which gives the same ids with a third of the CPU time (the tests
    compare the two); a text that holds the string of a special token goes to the tokenizers library, and so does
    one with a very long run of white space, which tiktoken's splitting cannot take (it fails near a million).
    """
    import tiktoken
    from tokenizers import Tokenizer

    tok, byte = Tokenizer.from_file(path), byte_of()
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = [x["content"] for x in file["added_tokens"]]
    ranks = {bytes(byte[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in special}
    blanks = re.compile(rf"(?<!\s)\s{{{RUN}}}")
    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[bytes]:
        return [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if any(s in t for s in special) or len(t) >= RUN and blanks.search(t)
                else fast.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() for t in texts]

    return encode


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32): one row per piece; ``row`` numbers the input rows."""

    def make():
        encode, tail = encoder(tokenizer), np.array([end], "<u4").tobytes()

        def step(c):
            out = {n: [] for n in ("row", "doc_id", "piece", "start", "length", "ids_crc32")}
            for row, doc, text in zip(c["row"], c["doc_id"], c["text"], strict=True):
                ids = encode([text])[0] + tail
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for name, v in zip(out, (row, doc, k, a, b - a, zlib.crc32(ids[4 * a:4 * b])), strict=True):
                        out[name].append(v)
            return out

        return step

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("row", F.monotonically_increasing_id())
    return map_batches(src, make, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


class Sums:
    """Which sums the lengths left can form: ``reach[i]`` has bit s set if some of the ``i`` smallest lengths add up to s.

    From one call to the next only the part above the smallest length whose usable number changed is made anew.
    """

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, (1 << capacity + 1) - 1
        self.have: list[int] = []
        self.copies: list[int] = []  # of each length, no more than fit into a sequence
        self.reach = [1]

    def update(self, counts: np.ndarray) -> None:
        sizes = np.flatnonzero(counts[:self.capacity + 1])
        sizes = sizes[sizes > 0]
        have, copies = sizes.tolist(), np.minimum(counts[sizes], self.capacity // sizes).tolist()
        same = 0
        for old, new in zip(zip(self.have, self.copies, strict=True), zip(have, copies, strict=True), strict=False):
            if old != new:
                break
            same += 1
        self.have, self.copies, self.counts = have, copies, counts
        self.widest = np.maximum.accumulate(np.diff(sizes)).tolist()  # gap between neighbours up to here
        del self.reach[same + 1:]

    def up_to(self, i: int) -> int:
        for j in range(len(self.reach) - 1, i):
            bits, left, step = self.reach[j], self.copies[j], 1
            while left:  # 1, 2, 4, ... copies at once
                n = min(step, left)
                bits |= bits << n * self.have[j]
                left, step = left - n, 2 * step
            self.reach.append(bits & self.mask)
        return self.reach[i]

    def sets(self, target: int, waste: int, i: int, steps: list[int], spare: int = 1 << 31):
        """The undominated sets of the ``i`` smallest lengths with the sum ``target``, large lengths first.

        ``waste`` is the room that they leave and ``spare`` the smallest larger length with a piece left over: a
        member that could be exchanged for it is not tried. ``steps[0]`` bounds the steps.
        """
        if not target:
            yield ()
            return
        fit = bisect_right(self.have, target, 0, i)
        if fit < i:
            i, spare = fit, self.have[fit]
        while i and steps[0] > 0 and self.up_to(i) >> target & 1:
            i -= 1
            x = self.have[i]
            if x + waste < spare:
                steps[0] -= 1
                for c in range(min(self.copies[i], target // x), 0, -1):
                    if self.up_to(i) >> target - c * x & 1:
                        for rest in self.sets(target - c * x, waste, i, steps, x if c < self.counts[x] else spare):
                            yield (x,) * c + rest
            spare = x
            if i and self.widest[i - 1] <= waste:
                return  # below this all lengths are closer to the next than the waste


def fillings(counts: np.ndarray, room: int, most: int = FILLINGS, tries: int = TRIES, sums: Sums | None = None) -> list[tuple[int, ...]]:
    """The first ``most`` undominated sets of available lengths (largest first) that fit in ``room``, least waste first.

    A set that another available length would still fit into is dominated by the larger set, and one whose
    member could be exchanged for a longer available length that fits is dominated by the exchange. The table of
    sums names the wastes there are and leads to the sets of each, so the first is found without a search.
    """
    sums, steps, out = sums or Sums(len(counts) - 1), [tries], []
    sums.update(counts)
    top = bisect_right(sums.have, room)
    can = sums.up_to(top)
    for waste in range(room + 1):
        if can >> room - waste & 1:
            for f in sums.sets(room - waste, waste, top, steps):
                used = {x: f.count(x) for x in f}
                if not waste or not any(counts[y] > used.get(y, 0) for y in sums.have[:bisect_right(sums.have, waste)]):
                    out.append(f)
                if len(out) >= most:
                    return out
            if steps[0] <= 0:
                break
    return out


def best_fit(counts: np.ndarray, room: int) -> tuple[int, ...]:
    """The largest length that fits, again and again."""
    have = [int(x) for x in np.flatnonzero(counts[:room + 1]) if x > 0]
    out: list[int] = []
    i = len(have)
    while i := min(i, bisect_right(have, room)):
        i -= 1
        n = min(int(counts[have[i]]), room // have[i])
        out += [have[i]] * n
        room -= n * have[i]
    return tuple(out)


def complete_bins(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence, how many such sequences) that hold every piece of the histogram."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    total = int((counts * np.arange(capacity + 1)).sum())
    least = -(-total // capacity)
    best: list[tuple[tuple[int, ...], int]] = []
    best_n, budget = None, nodes

    def times(counts: np.ndarray, pattern: tuple[int, ...]) -> int:
        return min(int(counts[x]) // pattern.count(x) for x in set(pattern))

    def taken(counts: np.ndarray, pattern: tuple[int, ...], k: int) -> np.ndarray:
        counts = counts.copy()
        for x in pattern:
            counts[x] -= k
        return counts

    # the incumbent: the best fit while the largest length left is above a switch, then the filling of least waste;
    # large pieces that take small ones early can cost as many sequences as small ones that are left till last
    sums = Sums(capacity)
    tried: dict[int, int] = {}

    def descend(switch: int) -> None:
        nonlocal best, best_n
        switch = min(max(switch, 0), capacity)
        if switch in tried or best_n == least:
            return
        now, n, steps = counts, 0, []
        while now.any():
            big = int(np.flatnonzero(now)[-1])
            rest = taken(now, (big,), 1)
            pattern = (big, *(best_fit(rest, capacity - big) if big > switch else fillings(rest, capacity - big, 1, sums=sums)[0]))
            k = times(now, pattern)
            steps.append((pattern, k))
            now, n = taken(now, pattern, k), n + k
        tried[switch] = n
        if best_n is None or n < best_n:
            best_n, best = n, steps

    grid = -(-capacity // SWITCHES)
    largest = max(histogram, default=0)
    for switch in [capacity, *(x for x in range(capacity - grid, -grid, -grid) if x < largest)]:
        descend(switch)
    while grid > 1 and best_n > least:
        grid = -(-grid // 2)
        at = min(tried, key=lambda x: (tried[x], x))
        descend(at - grid)
        descend(at + grid)

    # branch and bound, depth first: only solutions with a sequence less are looked for. A frame holds the counts of a
    # node and the branches not yet taken, so memory grows with the depth only
    def branches(now: np.ndarray, waste: int) -> list[tuple]:
        big = int(np.flatnonzero(now)[-1])
        rest = taken(now, (big,), 1)
        allowed = (best_n - 1) * capacity - total
        out = []
        for f in fillings(rest, capacity - big, sums=sums):
            pattern = (big, *f)
            lost = capacity - sum(pattern)
            k = times(now, pattern)
            for m in {k, 1} if lost else {k}:
                if waste + lost * m <= allowed:
                    out.append((lost, -m, pattern))
        return sorted(out, reverse=True)

    stack = []
    if budget > 0 and best_n > least:
        budget -= 1
        stack.append((counts, (), 0, 0, branches(counts, 0)))
    while stack and budget > 0 and best_n > least:
        before, chain, n, waste, left = stack[-1]
        if not left:
            stack.pop()
            continue
        lost, m, pattern = left.pop()
        budget -= 1
        if not left:
            stack.pop()
        now, chain, n, waste = taken(before, pattern, -m), (chain, (pattern, -m)), n - m, waste - lost * m
        if now.any():
            stack.append((now, chain, n, waste, branches(now, waste)))
        elif n < best_n:
            best_n, best = n, []
            while chain:
                chain, step = chain
                best.append(step)
    return best


def packed(table: DataFrame, capacity: int = CAPACITY, nodes: int = NODES, group: int = 50_000) -> DataFrame:
    """``table`` (stored pieces) with sequence_id and offset; ``group`` bounds the rows ranked together."""
    spark = table.sparkSession
    full, open_ = table.where(F.col("length") == capacity), table.where(F.col("length") < capacity)
    salts = max(16, -(-open_.count() // group))
    salted = open_.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    per = stored(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    ranges, sequence, used = [], 0, dict.fromkeys(histogram, 0)
    for pattern, k in complete_bins(histogram, capacity, nodes):
        at = 0
        for x in sorted(set(pattern), reverse=True):
            c = pattern.count(x)
            ranges.append((x, used[x], used[x] + k * c, c, sequence, at))
            used[x] += k * c
            at += c * x
        sequence += k
    places = spark.createDataFrame(ranges, "length long, lo long, hi long, each long, first long, at long").groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi", "each", "first", "at"))).alias("places"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "piece")) - 1
    ranked = salted.withColumn("nth", rank).join(base, ["length", "salt"]).withColumn("nth", F.col("nth") + F.col("base"))
    ranked = ranked.join(F.broadcast(places), "length")  # a few thousand ranges, whatever the corpus
    p = F.filter("places", lambda x: (x["lo"] <= F.col("nth")) & (F.col("nth") < x["hi"]))[0]
    ranked = ranked.withColumn("p", p).withColumn("i", F.col("nth") - F.col("p.lo"))
    cols = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*cols, (F.col("p.first") + F.floor(F.col("i") / F.col("p.each"))).alias("sequence_id"),
                           (F.col("p.at") + F.pmod("i", F.col("p.each")) * F.col("length")).alias("offset"))
    # a full piece is a sequence by itself; its number is negative and unique
    alone = full.select(*cols, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.union(alone).drop("row")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, nodes: int = NODES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return packed(stored(pieces(docs, tokenizer, capacity, end), "pieces"), capacity, nodes)
