"""Token ids in files: a canonical length-limited Huffman code, read in independent blocks.

Writing takes three steps. Every text is encoded once and its ids go to a table in the shared folder; the ids are
counted over all documents (one sum per id of the vocabulary reaches the driver, which makes the best code of at
most ``limit`` bits by package-merge); then the documents are range-partitioned by doc_id, and every task writes its
range as one file. File names are new for each attempt, and a manifest table names the files of the attempts that
counted, so a lost executor or a second attempt leaves at most a file that nobody reads.

A file: the bits of all ids in order, highest bit first, the last byte filled up; then, at the place that the last
16 bytes give, the symbols (u32), their code lengths (u8), the documents (id i64, null flag u8, ids u64) and the
checkpoints (u64: the bit at which every ``block``-th id starts). Codes follow from the lengths: shorter ones first,
then by symbol. All numbers are little-endian.

Reading deals out spans of whole documents (about ``SPAN`` ids, a longer document by itself). A task fetches a span's
bytes from the nearest checkpoint on and decodes all its blocks side by side with one table of ``2 ** limit`` entries.

Order: ascending doc_id, null ones first, rows with one doc_id in the order of the stored table. Null text is empty:
the end id alone. An empty table gives no file, and reading it gives no row.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caregrid.llm.common import map_batches, shared_path, stored, text_or_empty

END, BLOCK, LIMIT = 0, 512, 16
SPAN = 1 << 20  # ids that are read together
FLUSH = 1 << 16  # ids that are coded together
MOST_BITS = 24  # a code and the 7 bits before it fit into 32
MANIFEST = "path string, first_null boolean, first_id long, first_row long, file_ids long, index_at long, doc long, docs long, id long, ids long"


# ---- the code

def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """The lengths of the best prefix code with at most ``limit`` bits for symbols with these counts (package-merge)."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = items = counts[order].astype(np.int64)
    is_leaf = [np.ones(n, bool)]
    for _ in range(limit - 1):
        both = np.concatenate([leaves, items[:len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)])
        by = np.argsort(both, kind="stable")
        items = both[by]
        is_leaf.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        k = int(flags[:take].sum())
        lengths[order[:k]] += 1
        take = 2 * (take - k)
    return lengths


class Code:
    """The canonical code of symbols (ascending) with given lengths."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.symbols, self.lengths = symbols.astype(np.int64), lengths.astype(np.int64)
        self.bits = int(self.lengths.max())
        order = np.lexsort((self.symbols, self.lengths))
        width = np.int64(1) << (self.bits - self.lengths[order])
        first = np.cumsum(width) - width
        self.codes = np.empty(len(order), np.uint64)
        self.codes[order] = (first >> (self.bits - self.lengths[order])).astype(np.uint64)
        self.place = np.zeros(int(self.symbols[-1]) + 1, np.int64) if self.symbols[-1] < 1 << MOST_BITS else None
        if self.place is not None:
            self.place[self.symbols] = np.arange(len(self.symbols))
        table = np.repeat((order << 5 | self.lengths[order]).astype(np.int64), width)
        self.table = np.append(table, np.full((1 << self.bits) - len(table), table[-1]))

    def pack(self, ids: np.ndarray, carry: int = 0, filled: int = 0) -> tuple[bytes, np.ndarray, int, int]:
        """The whole bytes of the coded ids after ``filled`` bits (``carry``), the bit where each id starts, and the rest."""
        at = np.searchsorted(self.symbols, ids) if self.place is None else self.place[ids]
        size = self.lengths[at]
        end = filled + np.cumsum(size)
        begin, total = end - size, int(end[-1])
        code, word = self.codes[at], begin >> 6
        over = size - (64 - (begin & 63))  # bits that go to the next word
        high = np.where(over <= 0, code << np.maximum(-over, 0).astype(np.uint64), code >> np.maximum(over, 0).astype(np.uint64))
        words = np.zeros((total >> 6) + 2, np.uint64)
        group = np.append(0, np.flatnonzero(np.diff(word)) + 1)
        words[word[group]] = np.add.reduceat(high, group)  # their bits are apart: the sum is their union
        split = np.flatnonzero(over > 0)
        words[word[split] + 1] |= code[split] << (64 - over[split]).astype(np.uint64)
        if filled:
            words[0] |= np.uint64(carry << (64 - filled))
        data, rest = words.astype(">u8").tobytes(), total & 7
        return data[:total >> 3], begin, data[total >> 3] >> (8 - rest), rest

    def unpack(self, data: bytes, starts: np.ndarray, block: int, n: int) -> np.ndarray:
        """The ``n`` ids of blocks that start at these bits, all blocks decoded side by side, a step for each id of a block."""
        b = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
        window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        at, last = starts.astype(np.int64), 8 * len(data)
        out = np.empty((min(block, n), len(at)), np.int64)
        drop = np.uint32(32 - self.bits)
        for i in range(len(out)):
            entry = self.table[(window[at >> 3] << (at & 7).astype(np.uint32)) >> drop]
            out[i] = entry >> 5
            at = np.minimum(at + (entry & 31), last)  # a short last block goes on over its end, unused
        return self.symbols[out.T.reshape(-1)[:n]]


# ---- files

def file_system(path: str):
    """(file system, path in it) for a folder that all executors see."""
    from pyarrow.fs import FileSystem

    scheme, sep, rest = path.partition("://")
    return FileSystem.from_uri(f"s3://{rest}" if sep and scheme in ("s3a", "s3n") else path)


class Writer:
    """One file: ids are taken document by document; ``close`` gives the rows of the manifest."""

    def __init__(self, path: str, code: Code, block: int, span: int):
        fs, inner = file_system(path)
        self.path, self.code, self.block, self.span = path, code, block, span
        self.out = fs.open_output_stream(inner, compression=None)
        self.pending: list[np.ndarray] = []
        self.waiting = self.coded = self.ids = self.bits = self.carry = self.filled = 0
        self.doc, self.null, self.size, self.points, self.spans = [], [], [], [], []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        if not self.spans or self.ids - self.spans[-1][1] >= self.span or len(ids) >= self.span:
            self.spans.append((len(self.doc), self.ids))
        self.doc.append(doc or 0)
        self.null.append(doc is None)
        self.size.append(len(ids))
        self.ids += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= FLUSH:
            self._flush()

    def _flush(self) -> None:
        if not self.waiting:
            return
        ids = np.concatenate(self.pending)
        data, begin, self.carry, rest = self.code.pack(ids, self.carry, self.filled)
        self.points.append(begin[-self.coded % self.block::self.block] - self.filled + self.bits)
        self.bits += 8 * len(data) + rest - self.filled
        self.coded += len(ids)
        self.filled = rest
        self.out.write(data)
        self.pending, self.waiting = [], 0

    def close(self, first: tuple) -> list[tuple]:
        self._flush()
        if self.filled:
            self.out.write(bytes([self.carry << (8 - self.filled)]))
        index_at = -(-self.bits // 8)
        points = np.concatenate(self.points) if self.points else np.zeros(0)
        for values, kind in ((self.code.symbols, "<u4"), (self.code.lengths, "u1"), (self.doc, "<i8"), (self.null, "u1"), (self.size, "<u8"), (points, "<u8")):
            self.out.write(np.asarray(values).astype(kind).tobytes())
        self.out.write(struct.pack("<QII", len(self.doc), len(self.code.symbols), self.block))
        self.out.close()
        ends = [*self.spans[1:], (len(self.doc), self.ids)]
        return [(self.path, *first, self.ids, index_at, d, d2 - d, i, i2 - i) for (d, i), (d2, i2) in zip(self.spans, ends, strict=True)]


class Reader:
    """Spans of one file."""

    def __init__(self, path: str, index_at: int):
        fs, inner = file_system(path)
        self.f, self.index_at = fs.open_input_file(inner), index_at
        self.docs, symbols, self.block = struct.unpack("<QII", self._bytes(self.f.size() - 16, 16))
        self.code = Code(np.frombuffer(self._bytes(index_at, 4 * symbols), "<u4"), np.frombuffer(self._bytes(index_at + 4 * symbols, symbols), "u1"))
        self.doc_at = index_at + 5 * symbols

    def _bytes(self, at: int, n: int) -> bytes:
        return self.f.read_at(n, at)

    def _part(self, at: int, kind: str, first: int, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.frombuffer(self._bytes(at + first * size, n * size), kind)

    def span(self, doc: int, docs: int, first: int, ids: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place in the file, ids) of ``docs`` documents from number ``doc`` on, whose ids start at ``first``."""
        at = self.doc_at
        doc_id, null, size = self._part(at, "<i8", doc, docs), self._part(at + 8 * self.docs, "u1", doc, docs), self._part(at + 9 * self.docs, "<u8", doc, docs)
        start, stop = first // self.block, -(-(first + ids) // self.block)
        points_at = at + 17 * self.docs
        blocks = (self.f.size() - 16 - points_at) // 8
        points = self._part(points_at, "<u8", start, min(stop + 1, blocks) - start).astype(np.int64)
        low = int(points[0]) >> 3
        high = int(points[stop - start]) + 7 >> 3 if stop < blocks else self.index_at
        skip = first - start * self.block
        got = self.code.unpack(self._bytes(low, high - low), points[:stop - start] - 8 * low, self.block, skip + ids)[skip:]
        cut = np.concatenate([[0], np.cumsum(size.astype(np.int64))])
        for k in range(docs):
            yield None if null[k] else int(doc_id[k]), first + int(cut[k]), got[cut[k]:cut[k + 1]]


# ---- Spark

def encoded(docs: DataFrame, make_encoder: Callable, end: int = END) -> DataFrame:
    """(row, doc_id, ids, wide): the ids of every text and the end id, of 32 bits where ``wide``, else of 16."""

    def make():
        encode, tail = make_encoder(), np.array([end], "<u4")

        def step(c):
            ids = [np.append(np.frombuffer(encode([t])[0], "<u4"), tail) for t in c["text"]]
            wide = [bool(x.max() >> 16) for x in ids]
            return {"row": c["row"], "doc_id": c["doc_id"], "ids": [x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(ids, wide, strict=True)], "wide": wide}

        return step

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("row", F.monotonically_increasing_id())
    return map_batches(src, make, "row long, doc_id long, ids binary, wide boolean")


def unpacked(ids: pa.Scalar, wide: pa.Scalar) -> np.ndarray:
    return np.frombuffer(ids.as_buffer(), "<u4" if wide.as_py() else "<u2")


def count_ids(ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how often each occurs): one sum per id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for wide, kind in ((False, "<u2"), (True, "<u4")):
                n = np.bincount(np.frombuffer(b"".join(batch.filter(pc.equal(batch.column(1), wide)).column(0).to_pylist()), kind))
                if len(n) > len(total):
                    total = np.append(total, np.zeros(len(n) - len(total), np.int64))
                total[:len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = ids.select("ids", "wide").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    rows.sort()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def write_ids(docs: DataFrame, make_encoder: Callable, end: int = END, block: int = BLOCK, limit: int = LIMIT, span: int = SPAN, folder: str | None = None) -> str:
    """Write the ids of all documents; the folder, new under the shared one unless given, holds the files and the manifest.

    ``make_encoder()`` is called in the tasks and gives a function from texts to little-endian 32-bit ids.
    ``limit`` is raised where the used ids need longer codes.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "ids")
    ids = stored(encoded(docs, make_encoder, end), "encoded")
    symbols, counts = count_ids(ids)
    limit = max(limit, (len(symbols) - 1).bit_length() if len(symbols) else 0)
    if limit > MOST_BITS:
        raise ValueError(f"codes of {limit} bits; at most {MOST_BITS} are read at once")
    lengths = code_lengths(counts, limit) if len(symbols) else counts
    data = f"{folder}/data"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = first = None
        for batch in batches:
            for row, doc, x, wide in zip(*batch.columns, strict=True):
                doc = doc.as_py()
                if out is None:
                    fs, inner = file_system(data)
                    fs.create_dir(inner, recursive=True)
                    out, first = Writer(f"{data}/{uuid.uuid4().hex}.ids", Code(symbols, lengths), block, span), (doc is None, doc or 0, row.as_py())
                out.add(doc, unpacked(x, wide))
        if out is not None:
            rows = out.close(first)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows, strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    ids.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the folder; ``ids`` are little-endian 32-bit ids, ``start`` counts
    the ids of all documents before it. The driver sees one row per file."""
    spans = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    files = sorted(spans.where("doc = 0").select("first_null", "first_id", "first_row", "path", "file_ids").collect(), key=lambda r: (not r[0], *r[1:]))
    before = np.cumsum([0, *[r["file_ids"] for r in files]]).tolist()
    base = spark.createDataFrame([(r["path"], n) for r, n in zip(files, before, strict=False)], "path string, before long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, path = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if path != r["path"]:
                    open_, path = Reader(r["path"], r["index_at"]), r["path"]
                rows = [(d, r["before"] + at, len(x), x.astype("<u4").tobytes()) for d, at, x in open_.span(r["doc"], r["docs"], r["id"], r["ids"])]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                                 names=["doc_id", "start", "n_tokens", "ids"])

    spans = spans.join(F.broadcast(base), "path").select("path", "index_at", "doc", "docs", "id", "ids", "before")  # one row per file
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spans.repartition(n, "path", "doc").sortWithinPartitions("path", "doc").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
