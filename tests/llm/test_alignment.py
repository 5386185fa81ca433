"""Tokenizer alignment against plain loops over the tokens of every document."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from caregrid.llm import alignment, queries



def plain(rows):
    """The contract's rows, with the two libraries called directly."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.tokenizer_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
    docs, pairs = [], Counter()
    for doc, text in rows:
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ba = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
        whole = (" " + (text or "")).encode()
        if b"".join(ba) != whole or b"".join(bb) != whole or not text:
            ia, ib, ba, bb = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in ba], dtype=int).tolist(), np.cumsum([len(x) for x in bb], dtype=int).tolist()
        common, groups, x, y = sorted(set(ends_a) & set(ends_b)), [], 0, 0
        links = []
        at_b = defaultdict(list)
        for e, i in zip(ends_b, ib, strict=True):
            at_b[e].append(i)
        for e, i in zip(ends_a, ia, strict=True):
            links += [(i, j) for j in at_b[e]]
        for e in common:
            g = [[], []]
            while x < len(ia) and ends_a[x] <= e:
                g[0].append(str(ia[x]))
                x += 1
            while y < len(ib) and ends_b[y] <= e:
                g[1].append(str(ib[y]))
                y += 1
            groups.append("|".join(map(",".join, g)))
        pairs.update(links)
        docs.append((doc, len(ia), len(ib), len(groups), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, j), n in pairs.items():
        best[j] = max(best[j], n)
    return Counter((doc, na, nb, ng, len(links), sum(pairs[p] == best[p[1]] for p in links), sum(pairs[p] for p in links),
                    hashlib.sha256(g.encode()).hexdigest() if g else "") for doc, na, nb, ng, links, g in docs), pairs


def test_query_equals_its_contract(spark, table, nothing, monkeypatch):
    df, rows = table
    extra = [(7001, "plain <|endoftext|> text", "en", "s"), (7002, "a ▁ sign", "en", "s"), (7003, "tab\tnew\nline  two   three \x00 end ", "en", "s"),
             (7004, "你好 \U0001f600́ ﬁ Ω", "zh", "s"), (7005, " ", "en", "s")]
    both = df.select("doc_id", "text").unionByName(spark.createDataFrame([r[:2] for r in extra], "doc_id long, text string"))
    monkeypatch.setattr(queries, "read", lambda *a: both)
    monkeypatch.setattr(alignment, "FLUSH", 2000)  # many containers of one pair to merge
    want, pairs = plain([r[:2] for r in rows + extra])
    got = queries.op13_alignment(spark, "")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == want
    assert max(pairs.values()) > 50_000  # a multiplicity with many planes
    monkeypatch.setattr(queries, "read", lambda *a: nothing)
    assert queries.op13_alignment(spark, "").count() == 0


def test_pairs_and_texts(spark):
    a = queries.tokenizer_path()
    b = queries.tokenizer_path("piece_bpe_32k.model")
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["tokenizer", "alignment", "Zürich", "x1y2", "the"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    docs, pairs = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), lambda: alignment.byte_level(a), lambda: alignment.sentence_pieces(b))
    want, links = plain(rows)
    assert Counter({(r["a"], r["b"]): r["links"] for r in pairs.collect()}) == links
    assert Counter(hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "" for r in docs.collect()) == Counter(w[-1] for w in want.elements())
    most = pairs.orderBy("docs", ascending=False).first()
    assert 0 < most["docs"] <= 60 and most["docs"] <= most["links"]


def test_containers_round_trip_and_merge(spark):
    rng = np.random.default_rng(0)
    keys = [(k, np.sort(rng.choice(65536, n, replace=False))) for k, n in ((3, 1), (9, 4095), (10, 4096), (11, 65536), (12, 7))]
    key, low = np.concatenate([np.full(len(v), k) for k, v in keys]), np.concatenate([v for _, v in keys])
    bits, names, n = alignment.containers(key, low)
    assert names.tolist() == [3, 9, 10, 11, 12] and n.tolist() == [len(v) for _, v in keys]
    assert [len(x.as_py()) for x in bits] == [2, 8190, 8192, 8192, 14]
    number, back = alignment.postings(bits.slice(1, 3))
    assert {(int(i), int(x)) for i, x in zip(number, back, strict=True)} == {(i, int(x)) for i, (_, v) in enumerate(keys[1:4]) for x in v}
    halves = [(k, 0, 0, bytes(c.as_py())) for part in (low < 30_000, low >= 25_000) for c, k in zip(*alignment.containers(key[part], low[part])[:2], strict=True) for k in [int(k)]]
    got = alignment.merged(spark.createDataFrame(halves, alignment.CONTAINERS)).orderBy("pair").collect()
    assert [(r["pair"], r["docs"]) for r in got] == [(k, len(v)) for k, v in keys]
    assert [bytes(r["bits"]) for r in got] == [x.as_py() for x in bits]


def test_long_texts_go_in_parts(monkeypatch):
    t = alignment.sentence_pieces(queries.tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["word", " ", "  ", "\n", "Straße", "▁", "x", "\U0001f600", " end "]) for _ in range(rng.randint(1, 40)))
        want = t.encode([text])[0].tolist()
        monkeypatch.setattr(alignment, "LONG", rng.randint(1, 12))
        assert t.encode([text])[0].tolist() == want
        monkeypatch.setattr(alignment, "LONG", 1_000_000)


def test_group_texts_and_ids_are_made_without_an_object_per_token():
    import tracemalloc

    rng = np.random.default_rng(3)
    t = alignment.sentence_pieces(queries.tokenizer_path("piece_bpe_32k.model"))
    aligner = alignment.Aligner(alignment.Tokens(list, [b"x"] * 70_000), alignment.Tokens(list, [b"x"] * 900))
    a, b = rng.integers(0, 70_000, 200_000), rng.integers(0, 900, 200_000)
    ends = rng.random(200_000) < 0.5
    ends[-1] = True
    words = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 50_000))
    tracemalloc.start()
    got = aligner.text(a, b, ends, ends)
    of_text = tracemalloc.get_traced_memory()[1]
    tracemalloc.clear_traces()
    ids = t.encode([words])[0]
    of_ids = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    groups, at = [], 0
    for end in np.flatnonzero(ends) + 1:
        groups.append("|".join(",".join(map(str, x[at:end].tolist())) for x in (a, b)))
        at = end
    assert got == ";".join(groups) and of_text < 60 * (len(a) + len(b))
    assert ids.dtype == np.int64 and len(ids) > 100_000 and of_ids < 30 * len(ids)


def test_planes_add_up():
    times = np.array([1, 2, 3, 7, 8, 100])
    total = np.zeros(6, np.int64)
    for plane, within in alignment.planes(times, times):
        total += alignment.weight(plane) * within
    assert total.tolist() == times.tolist()
