"""Alignment of two tokenizers' ids: groups between common ends, and how often id pairs are linked over the corpus.

Both tokenizers give every text as tokens with known bytes. Where a token of A and one of B end at the same byte the
text is cut into groups, and the tokens that end there are linked (a token has one byte at least: one link per group). The corpus-wide counts of linked id pairs come from
inverted pair bitmaps. Documents are numbered (``row``); for every pair and every 65,536 rows a container holds the
documents with that pair (plane 0) and, for multiplicities above one, the bits of the multiplicity less one (planes 1,
2, ... of weight 1, 2, ...). A container is a sorted array of 16-bit numbers, or a bitmap of 8,192 bytes from 4,096
documents on. A task writes its containers whenever enough links have come together; those of one pair, block of rows
and plane are OR-merged and popcounted: plane 0 gives the documents of a pair, the weighted planes its links.
The counts return along the postings: every container hands its pair's count to its documents.

Pairs meet by (pair, block of rows), so the containers of a pair that is in every document are spread; the counts are
summed with partial sums. Nothing reaches the driver. A task holds the links of ``FLUSH`` tokens or of one document.

Texts that are null or empty, or whose tokens of A or B do not join to the bytes of a space and the text, have no
tokens. Repeated rows and null ids are rows like others. Pairs are ``a * (number of B's ids) + b``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caregrid.llm.common import shared_path, stored
from caregrid.llm.packing import RUN, SPLIT, byte_of

BLOCK_BITS = 16  # rows of a container: 2 ** 16
BITMAP = 1 << BLOCK_BITS >> 3
FLUSH = 1 << 22  # links that a task holds
LONG = 1_000_000  # characters from which on a text goes to sentencepiece in parts
SPLIT_COUNT = 26  # counts are summed in two parts that floats hold exactly


# ---- tokenizers

@dataclass
class Tokens:
    """``encode(texts)`` gives an array of ids for each text, ``pieces[id]`` the bytes of an id."""

    encode: Callable[[list[str]], list[np.ndarray]]
    pieces: list[bytes]


def byte_level(path: str) -> Tokens:
    """A byte-level BPE (file of the tokenizers library) on a space and the text; special tokens' strings are plain text."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special, byte = {x["id"]: x["content"] for x in file["added_tokens"]}, byte_of()
    vocab = {i: special[i].encode() if i in special else bytes(byte[c] for c in t) for t, i in file["model"]["vocab"].items()}
    vocab |= {i: t.encode() for i, t in special.items()}
    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks={b: i for i, b in vocab.items() if i not in special}, special_tokens={})
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    blanks = re.compile(rf"(?<!\s)\s{{{RUN}}}")

    def one(text: str) -> np.ndarray:
        if len(text) >= RUN and blanks.search(text):  # more than tiktoken's splitting can take
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.int64)
        return fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    return Tokens(lambda texts: [one(" " + t) for t in texts], [vocab.get(i, b"") for i in range(max(vocab) + 1)])


def sentence_pieces(path: str) -> Tokens:
    """A sentencepiece model, which puts a space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.vocab_size())]
    pieces = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in names]
    apart = not any("▁" in p.lstrip("▁") for p in names)  # then no token goes on over the space after a word

    gap = re.compile("(?<=[^ ▁]) (?=.)", re.S)  # the sign in a text counts as a space

    def ids(text: str) -> np.ndarray:
        return model.encode(text, return_type="numpy").astype(np.int64)

    def one(text: str) -> np.ndarray:
        if len(text) < LONG or not apart:
            return ids(text)
        parts, at = [], 0
        while at < len(text):
            cut = gap.search(text, at + LONG)
            end = cut.start() if cut else len(text)
            parts.append(ids(text[at:end]))
            at = end + 1  # the model puts this space before the next part
        return np.concatenate(parts)

    return Tokens(lambda texts: [one(t) for t in texts], pieces)


# ---- one document

class Joined:
    """The bytes of tokens one after the other; every token has one byte at least."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.start, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(pieces), np.uint8)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]


class Aligner:
    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        self.joined_a, self.joined_b = Joined(a.pieces), Joined(b.pieces)
        self.names = np.array([f"{i}{sep}".encode() for i in range(max(len(a.pieces), len(b.pieces))) for sep in ",|;"])  # ends filled up with zeros

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        if text:
            a, b = self.a.encode([text])[0], self.b.encode([text])[0]
            plain = np.frombuffer(b" " + text.encode(), np.uint8)
            if all(np.array_equal(joined(ids), plain) for joined, ids in ((self.joined_a, a), (self.joined_b, b))):
                return a, b
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens of A and of B end together with one of the other side; they are linked in turn and close the groups."""
        end_a, end_b = np.cumsum(self.joined_a.size[a]), np.cumsum(self.joined_b.size[b])
        ends = np.zeros(int(end_a[-1]) + 1 if len(a) else 0, np.int8)
        ends[end_a] = 1
        ends[end_b] += 1
        return ends[end_a] == 2, ends[end_b] == 2

    def text(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the groups in order."""
        if not len(a):
            return ""
        done_a, done_b = np.flatnonzero(last_a) + 1, np.append(0, np.flatnonzero(last_b) + 1)  # tokens up to the end of a group
        names = np.empty(len(a) + len(b), np.int64)
        names[np.arange(len(a)) + done_b[np.cumsum(last_a) - last_a]] = 3 * a + last_a
        names[np.arange(len(b)) + done_a[np.cumsum(last_b) - last_b]] = 3 * b + 2 * last_b
        return self.names[names].tobytes().translate(None, b"\0")[:-1].decode()


# ---- containers

def containers(key: np.ndarray, low: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(bits, key, documents) for each key; keys and then documents ascend and no (key, document) comes twice."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    data = low.astype("<u2")
    dense = 2 * n >= BITMAP
    if dense.any():
        parts, at = [], 0
        for i in np.flatnonzero(dense):
            bits = np.zeros(BITMAP * 8, np.uint8)
            bits[low[first[i]:first[i] + n[i]]] = 1
            parts += [data[at:first[i]].tobytes(), np.packbits(bits, bitorder="little").tobytes()]
            at = first[i] + n[i]
        raw = b"".join([*parts, data[at:].tobytes()])
    else:
        raw = data.tobytes()
    offsets = np.concatenate([[0], np.cumsum(np.where(dense, BITMAP, 2 * n))])
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(raw)]).cast(pa.binary()), key[first], n


def postings(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of the container, document) for each document of these containers."""
    bits = bits.cast(pa.large_binary())
    offsets = np.frombuffer(bits.buffers()[1], "<i8", len(bits) + 1, 8 * bits.offset)
    raw = np.frombuffer(bits.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    size = np.diff(offsets)
    dense = np.flatnonzero(size == BITMAP)
    keep = np.repeat(size != BITMAP, size)
    number, low = [np.repeat(np.arange(len(size)), np.where(size == BITMAP, 0, size // 2))], [raw[keep].view("<u2").astype(np.int64)]
    for i in dense:
        at = offsets[i] - offsets[0]
        low.append(np.flatnonzero(np.unpackbits(raw[at:at + BITMAP], bitorder="little")))
        number.append(np.full(len(low[-1]), i))
    return np.concatenate(number), np.concatenate(low)


def planes(key: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(plane, which entries are in it): all in plane 0, the bits of ``times`` less one in the others."""
    yield 0, np.ones(len(key), bool)
    more, plane = times - 1, 1
    while more.any():
        yield plane, (more & 1).astype(bool)
        more, plane = more >> 1, plane + 1


def weight(plane):
    return np.int64(1) << np.maximum(plane - 1, 0)


DOCS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
CONTAINERS = "pair long, block long, plane int, bits binary"


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _scan(docs: DataFrame, make_a: Callable[[], Tokens], make_b: Callable[[], Tokens], digest: bool) -> tuple[DataFrame, DataFrame]:
    """The documents and the containers of their pairs, both written in one pass over the texts."""
    both = _arrow(f"part int, {DOCS}, {CONTAINERS}")

    def batch(part: int, n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()) if f.name == "part" else pa.array(c, f.type) if (c := columns.get(f.name)) is not None
                                           else pa.nulls(n, f.type) for f in both], schema=both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(make_a(), make_b())
        n_b = len(aligner.b.pieces)
        if len(aligner.a.pieces) * n_b >= 1 << 63 - BLOCK_BITS:
            raise ValueError("too many ids for pairs of 47 bits")
        held, waiting, block = [], 0, None

        def flush():
            nonlocal held, waiting
            if held:
                key, times = np.unique(np.concatenate(held), return_counts=True)
                for plane, within in planes(key, times):
                    bits, pair, _ = containers(key[within] >> BLOCK_BITS, key[within] & (1 << BLOCK_BITS) - 1)
                    yield batch(1, len(pair), pair=pair, block=np.full(len(pair), block), plane=np.full(len(pair), plane, np.int32), bits=bits)
            held, waiting = [], 0

        for b in batches:
            out = {f.split()[0]: [] for f in DOCS.split(", ")}
            for row, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if waiting >= FLUSH or row >> BLOCK_BITS != block:
                    yield from flush()
                    block = row >> BLOCK_BITS
                ids_a, ids_b = aligner.tokens(text)
                last_a, last_b = aligner.align(ids_a, ids_b)
                groups, n = aligner.text(ids_a, ids_b, last_a, last_b), int(last_a.sum())
                if digest and groups:
                    groups = hashlib.sha256(groups.encode()).hexdigest()
                for name, v in zip(out, (row, doc, len(ids_a), len(ids_b), n, n, groups), strict=True):
                    out[name].append(v)
                if n:
                    held.append((ids_a[last_a] * n_b + ids_b[last_b] << BLOCK_BITS) + (row & (1 << BLOCK_BITS) - 1))
                    waiting += n
            yield batch(0, len(out["row"]), **out)
        yield from flush()

    spark = docs.sparkSession
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    path = shared_path(spark, "aligned")
    src.mapInArrow(run, f"part int, {DOCS}, {CONTAINERS}").write.partitionBy("part").parquet(path)
    both_df = spark.read.schema(f"{DOCS}, {CONTAINERS}, part int").parquet(path)
    return (both_df.where("part = 0").select(*[f.split()[0] for f in DOCS.split(", ")]),
            both_df.where("part = 1").select(*[f.split()[0] for f in CONTAINERS.split(", ")]))


def merged(parts: DataFrame) -> DataFrame:
    """(pair, block, plane, bits, docs): containers of one key OR-merged, with their popcounts."""
    keys = ["pair", "block", "plane"]
    schema = _arrow(f"{CONTAINERS}, docs long")

    def merge(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = [t.column(k).to_numpy() for k in keys]
        group = np.cumsum(np.append(0, np.any([c[1:] != c[:-1] for c in cols], axis=0)))
        number, low = postings(t.column("bits").combine_chunks())
        key = np.unique((group[number] << BLOCK_BITS) + low)
        bits, g, n = containers(key >> BLOCK_BITS, key & (1 << BLOCK_BITS) - 1)
        first = np.searchsorted(group, g)
        yield pa.RecordBatch.from_arrays([pa.array(c[first]) for c in cols] + [bits, pa.array(n)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the last key, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            last = np.all([(c := t.column(k).to_numpy()) == c[-1] for k in keys], axis=0)
            cut = int(np.argmax(last))  # sorted: the last key's rows are the tail
            held = t.slice(cut)
            if cut:
                yield from merge(t.slice(0, cut))
        if held is not None:
            yield from merge(held)

    return parts.repartition("pair", "block").sortWithinPartitions(*keys).mapInArrow(run, f"{CONTAINERS}, docs long")


def pair_counts(parts: DataFrame, n_b: int) -> DataFrame:
    """(pair, docs, links, best): documents and links of every pair; ``best``: no other pair of its B id has more links."""
    links = F.sum(F.expr("docs * shiftleft(1L, greatest(plane - 1, 0))"))
    pairs = parts.groupBy("pair").agg(F.sum(F.when(F.col("plane") == 0, F.col("docs")).otherwise(0)).alias("docs"), links.alias("links"))
    top = F.max("links").over(Window.partitionBy(F.col("pair") % n_b))  # at most one pair per id of A
    return pairs.withColumn("best", F.col("links") == top)


def returned(parts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row, n_best, count_sum): the pairs' counts summed over each document's links."""
    scored = parts.join(pairs.select("pair", "links", "best"), "pair").select("block", "plane", "links", "best", "bits")
    size, low_part = 1 << BLOCK_BITS, (1 << SPLIT_COUNT) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, total, seen = None, None, None, None

        def out():
            at = np.flatnonzero(seen)
            return pa.RecordBatch.from_arrays([pa.array((block << BLOCK_BITS) + at), pa.array(best[at]), pa.array(total[at])], names=["row", "n_best", "count_sum"])

        for b in batches:
            blocks = b.column(0).to_numpy()
            for piece in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(blocks)) + 1) if len(blocks) else []:
                rows = b.slice(piece[0], len(piece))
                if blocks[piece[0]] != block:
                    if block is not None:
                        yield out()
                    block = int(blocks[piece[0]])
                    best, total, seen = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
                number, low = postings(rows.column(4))
                w = weight(rows.column(1).to_numpy().astype(np.int64))
                links = rows.column(2).to_numpy()
                add = lambda v: np.bincount(low, weights=v[number], minlength=size).astype(np.int64)
                total += (add(w * (links & low_part)) + (add(w * (links >> SPLIT_COUNT)) << SPLIT_COUNT))
                best += add(w * rows.column(3).to_numpy(zero_copy_only=False))
                seen[low] = True
        if block is not None:
            yield out()

    return scored.repartition("block").sortWithinPartitions("block").mapInArrow(run, "row long, n_best long, count_sum long")


def align(docs: DataFrame, make_a: Callable[[], Tokens], make_b: Callable[[], Tokens], digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the most links of its B id), count_sum
    (the pairs' counts over the links), groups (the text of ``Aligner.text``, or its SHA-256 where ``digest``; empty
    without tokens). Pairs: a, b, docs, links, best.
    """
    rows, parts = _scan(docs, make_a, make_b, digest)
    n_b = len(make_b().pieces)
    parts = stored(merged(parts), "pair-bitmaps")
    pairs = stored(pair_counts(parts, n_b), "pair-counts")
    back = returned(parts, pairs)
    out = rows.join(back, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
                                                F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups")
    return out, pairs.select(F.expr(f"pair div {n_b}").alias("a"), (F.col("pair") % n_b).alias("b"), "docs", "links", "best")
