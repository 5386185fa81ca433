"""Token id files: the code against plain Huffman, round trips, and the registered query against its contract."""

import heapq
import zlib
from collections import Counter

import numpy as np
import pytest

from caregrid.llm import id_files, queries


def plain_huffman(counts):
    """The total of bits of an unlimited Huffman code."""
    heap, total = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


def best_limited(counts, limit):
    """The least total of bits with a length limit, by dynamic programming over lengths that do not fall as counts fall."""
    counts = sorted((int(c) for c in counts), reverse=True)
    best = {0: 0}  # used share of 2 ** limit -> bits
    for c in counts:
        new = {}
        for used, bits in best.items():
            for size in range(1, limit + 1):
                k, b = used + (1 << limit - size), bits + c * size
                if k <= 1 << limit and b < new.get(k, 1 << 60):
                    new[k] = b
        best = new
    return min(best.values())


@pytest.mark.parametrize("n", [2, 3, 5, 9, 60, 400])
def test_lengths_are_best(n):
    counts = np.random.default_rng(n).zipf(1.3, n).clip(max=10**9)
    free = id_files.code_lengths(counts, 40)
    assert (free * counts).sum() == plain_huffman(counts) and (2.0**-free).sum() == 1
    for limit in ((n - 1).bit_length(), (n - 1).bit_length() + 2):
        lengths = id_files.code_lengths(counts, limit)
        assert lengths.max() <= limit and (2.0**-lengths).sum() <= 1
        if n <= 9:
            assert (lengths * counts).sum() == best_limited(counts, limit)
    with pytest.raises(ValueError):
        id_files.code_lengths(np.ones(5), 2)


def test_files_are_read_in_any_span(tmp_path):
    rng = np.random.default_rng(1)
    sizes = [1, 1, 700, 3, 64, 5000, 1, 1, 256, 129, 63, 2]
    ids = [(rng.zipf(1.2, n) % 3000).astype("<u4") for n in sizes]
    symbols, counts = np.unique(np.concatenate(ids), return_counts=True)
    code = id_files.Code(symbols, id_files.code_lengths(counts, 13))
    for block, span, flush in ((64, 100, 10), (1, 1, 1), (512, 1 << 20, 1 << 20), (7, 500, 1000)):
        id_files.FLUSH, old = flush, id_files.FLUSH
        w = id_files.Writer(str(tmp_path / f"{block}-{flush}"), code, block, span)
        for i, x in enumerate(ids):
            w.add(None if i == 2 else -i, x)
        rows = w.close((False, 0, 0))
        id_files.FLUSH = old
        rng.shuffle(rows)  # any order: every span is read by itself
        got = {}
        for r in rows:
            for d, at, x in id_files.Reader(r[0], int(r[5])).span(*map(int, r[6:])):
                got[at] = (d, x.tolist())
        assert [got[k] for k in sorted(got)] == [(None if i == 2 else -i, x.tolist()) for i, x in enumerate(ids)]


def test_query_equals_its_contract(spark, table, nothing, monkeypatch):
    from tokenizers import Tokenizer

    df, rows = table
    tok = Tokenizer.from_file(queries.tokenizer_path())
    monkeypatch.setattr(queries, "read", lambda *a: df)
    got = sorted(queries.op12_token_files(spark, "").collect(), key=lambda r: r["start"])
    want = Counter()
    for doc, text, *_ in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        want[doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got[:-1]]]).tolist()
    monkeypatch.setattr(queries, "read", lambda *a: nothing)
    assert queries.op12_token_files(spark, "").count() == 0


def test_a_lost_attempts_file_is_not_read(spark, tmp_path):
    docs = spark.range(50).selectExpr("id doc_id", "repeat('x', cast(id as int)) text")

    def encoder():
        return lambda texts: [np.full(len(t), 70_000, "<u4").tobytes() for t in texts]

    folder = id_files.write_ids(docs, encoder, block=4, span=30, folder=f"file://{tmp_path}/ids")
    (tmp_path / "ids" / "data" / "left.ids").write_bytes(b"half a file")
    got = id_files.read_ids(spark, folder).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == list(range(1, 51)) and got[-1]["start"] == sum(range(1, 50))
    assert np.frombuffer(got[3]["ids"], "<u4").tolist() == [70_000] * 3 + [0]


def test_one_symbol(spark):
    docs = spark.range(9).selectExpr("id doc_id", "cast(null as string) text")
    got = id_files.read_ids(spark, id_files.write_ids(docs, lambda: lambda texts: [b"" for _ in texts])).collect()
    assert sorted(r["start"] for r in got) == list(range(9)) and {bytes(r["ids"]) for r in got} == {bytes(4)}
