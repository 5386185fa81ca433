"""The document operators on the awkward table: brute force where there is one, and a defined result everywhere."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from caregrid.llm import langid, license_scan, line_dedup, mixing, packing, pii, queries, simhash, toxicity


def ids(df):
    return Counter(r[0] for r in df.select("doc_id").collect())


def all_ids(rows):
    return Counter(r[0] for r in rows)


# ---- 1 personal data

STRICT = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum((int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits))) % 10 == 0


def strict_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(STRICT):
        if kind == "email" and "@" not in text.strip("@"):
            continue  # the plain pattern is quadratic on such texts
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_strict_spans_stay(table, nothing):
    df, rows = table
    found = pii.find(df)
    got, want, more = Counter(), Counter(), {}
    for r in found.collect():
        got[r["doc_id"], tuple((s["start"], s["kind_order"], s["end"]) for s in r["spans"] if s["base"])] += 1
        more[r["doc_id"]] = [s for s in r["spans"] if not s["base"]]
    for doc, text, *_ in rows:
        want[doc, tuple(strict_spans(text or ""))] += 1
    assert got == want
    assert not any(s["start"] < e and b < s["end"] for doc, extra in more.items() for s in extra
                   for b, _, e in strict_spans(next((t for d, t, *_ in rows if d == doc), "") or ""))
    assert pii.find(nothing).count() == 0


def test_a_text_is_split_once_for_a_generator(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd, c@d.ef"), (2, "a@b.cd"), (3, None)], "doc_id long, text string")
    name, _, _, needs, pattern = pii.GENERATORS[0]
    found = docs.select(pii._matches(name, needs, pattern).alias("found"))
    assert [r[0] and [tuple(x) for x in r[0]] for r in found.collect()] == [
        [("email", 0, "a@b.cd", 5, "mail ", ","), ("email", 1, "c@d.ef", 2, ", ", "")], [("email", 0, "a@b.cd", 0, "", "")], None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_vote_model_finds_the_reliable_labeler(spark):
    rng, rows = np.random.default_rng(3), []
    for i in range(600):
        true = i % 2
        votes = [true if rng.random() < p else 1 - true for p in (0.95, 0.9, 0.6, 0.85, 0.7)]
        rows.append((i, "phone", votes))
    m = pii.vote_model(spark.createDataFrame(rows, "row long, kind string, votes array<int>")).first()
    a = m["reliability"]
    assert a[0] > a[3] > a[2] and a[1] > a[4] and abs(m["prior"] - 0.5) < 0.1


# ---- 2 licences

def test_license_places(table, nothing):
    df, rows = table
    got, want = Counter(), Counter()
    for r in license_scan.scan(df).collect():
        got[r["doc_id"], r["n_words"], tuple(sorted((h["label"], h["start"]) for h in r["hits"] if h["phrase"]))] += 1
        assert 0 <= r["score"] <= 1
    for doc, text, *_ in rows:
        w = license_scan.WORD.findall(license_scan.lower(text or ""))
        hits = [(t.label, i) for t in license_scan.TEMPLATES if t.phrase for i in range(len(w)) if w[i:i + len(t.words)] == t.words]
        want[doc, len(w), tuple(sorted(hits))] += 1
    assert got == want
    assert license_scan.scan(nothing).count() == 0


def test_license_join_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = sorted({w for t in license_scan.TEMPLATES for w in t.words}) + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 200)))) for i in range(60)]
    docs += [(100 + i, " ".join(x for x in t.text.split() if rng.random() < 0.9)) for i, t in enumerate(license_scan.TEMPLATES)]
    templates = license_scan.TEMPLATES
    vocabulary = sorted({w for t in templates for w in t.words})
    table = license_scan.blocks_of(spark.createDataFrame(docs, "doc_id long, text string"), vocabulary, min(map(license_scan.needed, templates))).cache()
    doc_of = {r["row"]: r["doc_id"] for r in table.select("row", "doc_id").collect()}
    got = {(doc_of[r["row"]], r["template"], r["block"]) for r in license_scan.matches(table, templates, vocabulary).collect()}
    want, half = set(), license_scan.BLOCK // 2
    for doc, text in docs:
        w = license_scan.WORD.findall(license_scan.lower(text))
        for b in range(len(w) // half + 1):
            own = set(w[b * half:b * half + license_scan.BLOCK])
            want |= {(doc, k, b) for k, t in enumerate(templates) if len(own & set(t.words)) >= license_scan.needed(t)}
    assert got == want and len(want) > 5


def test_whole_licences_are_found_beside_notices(spark):
    """Texts with a whole licence, with most of it, and with half of it, between other words; blocks of both lengths."""
    rng = np.random.default_rng(8)
    long = [t for t in license_scan.TEMPLATES if license_scan.block_length(t) > license_scan.BLOCK]
    assert {t.label for t in long} >= {"mit", "isc"} and all(license_scan.block_length(t) >= 2 * len(t.words) for t in license_scan.TEMPLATES)
    noise = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 500, n))
    docs, want = [], {}
    for i in range(24):
        t, share = long[i % len(long)], (1.0, 0.95, 0.5)[i % 3]
        words = [w for w in t.text.split() if share == 1 or rng.random() < share]
        docs.append((i, f"{noise(int(rng.integers(0, 900)))} {' '.join(words)} {noise(int(rng.integers(0, 900)))}"))
        held = set(license_scan.WORD.findall(license_scan.lower(" ".join(words))))
        want[i] = [x.label for x in [t] if len(held & set(x.words)) >= license_scan.needed(x)]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), long).collect()}
    assert {i: sorted({h["label"] for h in r["hits"]}) for i, r in got.items()} == want and 10 < sum(map(len, want.values())) < 24
    table = license_scan.blocks_by_length(spark.createDataFrame(docs, "doc_id long, text string"), [(long[0].words, 5, 64), (long[1].words, 5, 512)])
    for k, block, t in ((0, 64, long[0]), (1, 512, long[1])):
        one = license_scan.blocks_of(spark.createDataFrame(docs, "doc_id long, text string"), t.words, 5, block)
        assert sorted(map(str, one.select("doc_id", "blocks").collect())) == sorted(
            str(r).replace(f"blocks{k}=", "blocks=") for r in table.select("doc_id", f"blocks{k}").collect())
    with pytest.raises(ValueError):
        license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), [license_scan.Template("x", " -- ")])


# ---- 3 packing

def test_packing_round_trip(table, nothing):
    from tokenizers import Tokenizer

    df, rows = table
    path = queries.tokenizer_path()
    got = packing.pack(df, path).collect()
    tok, want = Tokenizer.from_file(path), Counter()
    for doc, text, *_ in rows:
        t = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(t) if len(t) <= 2048 else len(t) % 2048 or 2048
        cuts = [0, *range(first, len(t) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, k, a, b - a, zlib.crc32(np.array(t[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    assert packing.pack(nothing, path).count() == 0


def test_bins_are_few():
    rng = np.random.default_rng(1)
    for capacity, n, lo, hi in ((10, 14, 2, 9), (12, 12, 3, 11), (20, 40, 1, 20), (100, 300, 20, 60), (2048, 5000, 1, 2047)):
        lengths = rng.integers(lo, hi, n).tolist()
        patterns = packing.complete_bins(Counter(lengths), capacity)
        used = Counter()
        for p, k in patterns:
            assert sum(p) <= capacity
            used.update({x: p.count(x) * k for x in p})
        assert used == Counter(lengths)
        bins, bfd = sum(k for _, k in patterns), []
        for x in sorted(lengths, reverse=True):
            fit = [i for i, room in enumerate(bfd) if room >= x]
            if fit:
                bfd[min(fit, key=lambda i: bfd[i])] -= x
            else:
                bfd.append(capacity - x)
        assert -(-sum(lengths) // capacity) <= bins <= len(bfd)


def test_fillings_are_the_undominated_ones_in_order_of_waste():
    rng = np.random.default_rng(4)
    for _ in range(60):
        counts, room = np.concatenate([[0], rng.integers(0, 3, 14)]), int(rng.integers(1, 15))
        sets = {()}
        for x in range(1, 15):
            sets |= {(x,) * c + f for f in sets for c in range(1, counts[x] + 1) if c * x + sum(f) <= room}
        spare = lambda f: [y for y in range(1, 15) if counts[y] > f.count(y)]
        want = {f for f in sets if not any(y - x <= room - sum(f) and y > x for y in spare(f) for x in (0, *f))}
        got = packing.fillings(counts, room, 10_000, 100_000)
        assert set(got) == want and len(got) == len(want)
        assert [sum(f) for f in got] == sorted(map(sum, got), reverse=True)


def test_bins_without_short_pieces_are_few():
    for lo, hi, most in ((62, 125, 1160), (50, 150, 1198)):
        lengths = np.random.default_rng(6).integers(lo, hi + 1, 3000).tolist()
        assert sum(k for _, k in packing.complete_bins(Counter(lengths), 256, 100)) <= most


def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok, enc = Tokenizer.from_file(path), packing.encoder(path)
    rng, bits = np.random.default_rng(2), [" ", "  ", "\n", "\t", "\x85", "\xa0", "　", "\x1c", "a", "Ab", "é", "12", "'s", "n't", "!", "-", "<|endoftext|>", "\U0001f600", "中"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(1500)]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert enc(texts[:700]) + enc(texts[700:]) == want


def test_ids_of_very_long_white_space():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok, enc = Tokenizer.from_file(path), packing.encoder(path)
    texts = [" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "a b " + " \n" * 60_000 + "\u3000c", "x " * 70_000, ("a" + " " * 99_999) * 2]
    for t in texts:
        assert enc([t]) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]


# ---- 4 language

def test_language(table, nothing):
    df, rows = table
    got = langid.identify(df).collect()
    assert Counter(r["doc_id"] for r in got) == all_ids(rows)
    lang = {d: x for d, _, x, _ in rows if d is not None and d < 9000}
    held = [r for r in got if r["doc_id"] in lang and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    if held:
        assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.9
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (9001, 9002, 9003, 9007, 9012))
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in langid.classify(df, {}).collect()} == {"und"}


def test_a_column_without_languages_is_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    rows = lambda n: spark.createDataFrame([(i, "some words", f"l{i % n}") for i in range(40)], "doc_id long, text string, lang string")
    assert langid.identify(rows(3)).count() == 40
    with pytest.raises(ValueError, match="languages"):
        langid.identify(rows(4))


def test_ngrams():
    t = langid.letters({}, "Ab, ab! é")
    assert t == " ab ab é "
    g, n = langid.grams(t)
    text = {(int(x)): c for x, c in zip(g, n)}
    assert text[ord("a")] == 2 and text[ord("é")] == 1 and text[(ord("a") << 21) | ord("b")] == 2 and ord(" ") not in text


# ---- 5 SimHash

def plain_fingerprint(text):
    w = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if w else 0


def plain_groups(fps, radius=3):
    f = np.array(fps, np.uint64)
    u, v = np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= radius)
    return simhash.components_of(len(f), u, v)


@pytest.mark.parametrize("tile", [simhash.TILE, 8])
def test_simhash_groups(table, nothing, tile):
    df, rows = table
    fps = [plain_fingerprint(t or "") for _, t, *_ in rows]
    label = plain_groups(fps)
    low = {g: min((rows[i][0] for i in np.flatnonzero(label == g) if rows[i][0] is not None), default=None) for g in set(label)}
    want = Counter((r[0], format(f, "016x"), low[g]) for r, f, g in zip(rows, fps, label))
    got = simhash.near_groups(df, tile=tile).selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) f", "component_id").collect()
    assert Counter(tuple(r) for r in got) == want
    assert simhash.near_groups(nothing).count() == 0
    if tile == 8:
        kept = simhash.keep_one(df, tile=tile)
        assert kept.columns == df.columns
        assert Counter(low.values()) == ids(kept)


def test_links_of_a_dense_ball_are_a_forest():
    rng = np.random.default_rng(4)
    flips = (np.uint64(1) << rng.integers(0, 64, (3000, 2)).astype(np.uint64))
    x = np.unique(np.bitwise_xor.reduce(flips, axis=1) ^ np.uint64(0x0123456789ABCDEF))
    u, v = simhash.tile_links(x, None, 3)
    assert len(u) < len(x)
    place = {int(a): i for i, a in enumerate(x)}
    mine = simhash.components_of(len(x), np.array([place[int(a)] for a in u]), np.array([place[int(a)] for a in v]))
    assert len(set(mine)) == len(set(plain_groups(x)))


# ---- 7 mixing

def test_mixing(table, nothing):
    df, rows = table
    sizes = mixing.sized(df)
    plan, _ = mixing.plan(sizes, block_docs=4, shard_blocks=3)
    got = plan.collect()
    total = defaultdict(int)
    for _, t, _, s in rows:
        total[s] += len((t or "").encode().split())
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + ([None] if None in total else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest = 1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: 2 * total[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        if not (over := {s for s in free if target[s] > 2 * total[s]}):
            break
        capped |= over
    taken, small = defaultdict(int), defaultdict(lambda: 10 ** 9)
    for r in got:
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert len(r["shards"]) <= 2
        taken[r["source"]] += r["size"] * len(r["shards"])
        small[r["source"]] = min(small[r["source"]], r["size"] or 10 ** 9)
    assert Counter(r["doc_id"] for r in got) == all_ids(rows)
    for s in order:  # what is missing is less than a document that could still be taken, or a large one at the edge
        assert taken[s] <= target[s] + 0.5
        assert target[s] - taken[s] <= max([len((t or "").split()) for _, t, _, x in rows if x == s])
    again, _ = mixing.plan(sizes, block_docs=4, shard_blocks=3)
    key = lambda r: (str(r["doc_id"]), r["text_hash"], r["shards"])
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))
    out = mixing.mixture(df, block_docs=4, shard_blocks=3)
    assert out.columns == df.columns
    want = Counter()
    for r in got:
        want[r["doc_id"]] += len(r["shards"])
    assert ids(out) == +want
    assert mixing.plan(mixing.sized(nothing))[0].count() == 0 and mixing.mixture(nothing).count() == 0


def test_splitting_tree_is_exact():
    q = np.array([17, 0, 5, 300, 1])
    leaves = [mixing.split_leaf(q, 13, i, 7) for i in range(13)]
    ends = np.zeros(5, int)
    for start, own in leaves:
        assert (start == ends).all()
        ends = start + own
    assert (ends == q).all() and max(o.sum() for _, o in leaves) - min(o.sum() for _, o in leaves) <= 1
    share = np.mean([mixing.split_leaf(np.array([30, 10]), 2, 0, s)[1][0] for s in range(400)])
    assert abs(share - 15) < 0.3


# ---- 9 toxicity

def test_toxicity(spark, nothing):
    rng = np.random.default_rng(6)
    plain = ["".join(rng.choice(["an", "ther", "ing", "on", "st", "ea", "ou", "re"], rng.integers(1, 4))) for _ in range(400)]
    rows = []
    for i in range(900):
        w = rng.choice(plain, rng.integers(20, 120)).tolist()
        if i % 3 == 0:
            for x in rng.choice(["idiot", "scum", "pathetic", "zwurgelheit", "zwurgelung"], 3):
                w.insert(int(rng.integers(0, len(w))), str(x))
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, 1, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "x"), (8000, "", "x")], "doc_id long, text string, score string")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in held])
    assert right >= 0.95 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] < 0.5 for r in got if r["doc_id"] in (None, 8000)} == {True}
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and ids(kept)[8000] == 1 and kept.count() < 700
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(nothing, model).count() == 0


def test_windows_compared_together_equal_one_text_at_a_time(monkeypatch):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 8))) for _ in range(200)]
    model = toxicity.Model(" ".join(vocabulary[:120]).encode(), " ".join(vocabulary[90:150]).encode())
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (0, 1, 2, 3, 60, 5, 0, 400, 7)] + ["\ud800 é", ""]
    monkeypatch.setattr(toxicity, "BATCH", 7)
    monkeypatch.setattr(toxicity, "CHARACTERS", 300)
    length = toxicity.lengths(model.base)
    cut = [w for t in texts for w in toxicity.distinct_windows(t)]
    assert length.many(cut).tolist() == [length(w) for w in cut] and length.many([]).tolist() == []
    difference, calls = toxicity.differences(model), []
    together = toxicity.differences(model)
    many, together.many = together.many, lambda part: calls.append(len(part)) or many(part)
    got = toxicity.features_of(texts, together)
    assert 1 < len(calls) < len(texts) and sum(calls) == len(texts)
    assert got == [toxicity.features_of([t], difference)[0] for t in texts] and toxicity.features_of([], difference) == []
    assert [difference(t) for t in texts] == many(texts)


def test_framed_windows_lie_in_one_buffer(monkeypatch):
    monkeypatch.setattr(toxicity, "BATCH", 4)
    some = [b" a b c ", b"", b" \xc3\xa9 ", b" a b c ", toxicity.FRAME, b" last one "]
    buffers = toxicity.framed(some)
    assert [len(b) for b in buffers] == [4, 2] and toxicity.framed([]) == []
    assert [x.tobytes() for b in buffers for x in b] == [toxicity.FRAME + w + toxicity.FRAME for w in some]
    size = toxicity.lengths(b"some ordinary words of a dictionary")
    assert size.each(buffers).tolist() == size.many(some).tolist() == [size(w) for w in some]


def test_window_differences_equal_plain_compression():
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 8))) for _ in range(300)]
    model = toxicity.Model(" ".join(vocabulary[:150]).encode(), " ".join(vocabulary[150:200]).encode())
    ordinary, toxic = toxicity.lengths(model.base), toxicity.lengths(model.base + model.toxic)
    difference = toxicity.differences(model)
    grams = {model.toxic[i:i + toxicity.GRAM] for i in range(len(model.toxic) - toxicity.GRAM + 1)}
    seen = 0
    for n in (0, 1, 2, 3, 4, 50, 700):
        text = "  ".join(rng.choice(vocabulary, n)).upper() + " \n"
        words = text.lower().encode().split()
        each = [b" " + b" ".join(words[i:i + 3]) + b" " for i in range(max(1, n - 2) if n else 0)]
        shares = [any(w[i:i + toxicity.GRAM] in grams for i in range(len(w) - toxicity.GRAM + 1)) for w in each]
        d = [ordinary(w) - toxic(w) for w in each]
        coarse = {*range(0, len(each), toxicity.STRIDE), len(each) - 1} if each else set()
        near = {j for i in coarse if shares[i] and d[i] >= toxicity.CLOSER for j in (i - 1, i, i + 1) if 0 <= j < len(each)}
        want = Counter({each[i]: d[i] for i in coarse | near if shares[i]}.values())
        more = Counter(dict(zip(each, d, strict=True)).values())
        got, count = difference(text)
        assert count == len(each)
        assert not want - Counter(got) and not Counter(got) - more  # a hash may let a few more windows through
        seen += len(want)
    assert seen > 5


def test_a_toxic_phrase_of_ordinary_words(spark):
    rng = np.random.default_rng(9)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(800)]
    phrase = f"{vocabulary[3]} {vocabulary[71]} {vocabulary[500]} {vocabulary[220]}"
    rows = []
    for i in range(900):
        words = list(rng.choice(vocabulary, rng.integers(40, 120)))
        if i % 3 == 0:
            for _ in range(2):
                words.insert(rng.integers(0, len(words)), phrase)
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    bad, good = [score[i] >= 0.5 for i, _, y in held if y], [score[i] >= 0.5 for i, _, y in held if not y]
    assert len(bad) > 30 and np.mean(bad) >= 0.9 and np.mean(good) <= 0.05


# ---- 10 lines

def plain_lines(rows, min_docs=5):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).encode().lower().decode()
    holders = defaultdict(set)
    for doc, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(doc)
    low = lambda d: (d is not None, d)
    gone = {k: max(h, key=low) for k, h in holders.items() if len(k) >= 40 and len(h) >= min_docs}
    out = Counter()
    for doc, t, *_ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if key(x) not in gone or gone[key(x)] == doc]
        out[doc, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("first_lines", "fanout"), [(60, 3), (25, 2), (10**6, 3)])
def test_line_dedup(spark, table, nothing, first_lines, fanout):
    df, rows = table
    d = line_dedup.deduplicated(df, first_lines=first_lines, fanout=fanout)
    got = d.selectExpr("doc_id", "__lines.n_lines", "__lines.n_dropped", "sha2(__lines.kept, 256) h").collect()
    assert Counter(tuple(r) for r in got) == plain_lines(rows)
    if fanout == 2:
        out = line_dedup.dedup_lines(df, first_lines=200)
        assert out.columns == df.columns and out.dtypes == df.dtypes and ids(out) == all_ids(rows)
        assert line_dedup.deduplicated(nothing).count() == 0


def test_line_keys_are_lower_cased_once_and_only_if_long(spark):
    lines = ["\tA Plain LINE, [Z] and @ `a` {z}, Long Enough to be a key \r", "ÉCOLE İstanbul ΣΑΣ Ⅷ ǅ Straße ＡＢＣ, LONG enough to be a key", "short", "x" * 40, " " + "Y" * 39]
    keys = line_dedup.long_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"))
    az = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t.strip(" \t\n\x0b\f\r"))
    digest = lambda t: hashlib.md5(az(t).encode()).digest()
    want = {(i, *(int.from_bytes(digest(t)[k:k + 8], signed=True) for k in (0, 8))) for i, t in enumerate(lines) if len(az(t)) >= 40}
    assert {(r["line"], r["h1"], r["h2"]) for r in keys.collect()} == want and len(want) == 3
    plan = [x for x in keys._jdf.queryExecution().optimizedPlan().toString().splitlines() if "ABCDEFGHIJKLMNOPQRSTUVWXYZ" in x]
    assert len(plan) == 1 and "Filter" not in plan[0]


def test_runs_hold_each_key_once_and_only_known_keys_add(spark):
    rng, runs, seen, total = np.random.default_rng(1), line_dedup.Runs(spark, fanout=2, buckets=3), set(), Counter()
    try:
        for i in range(5):
            keys = [(int(d), int(k), 0) for d in range(100 * i, 100 * i + 20) for k in rng.integers(0, 60, 4)]
            runs.add(spark.createDataFrame(keys, "doc_id long, h1 long, h2 long"))
            own = Counter(k for _, k in {(d, k) for d, k, _ in keys})
            if i:
                added = {r["h1"]: r["docs"] for r in runs.additions[-1].collect()}
                assert added == {k: n for k, n in own.items() if k in seen}
            seen |= set(own)
            total += own
            held = [r["h1"] for t in runs.tables() for r in spark.table(t).collect()]
            assert sorted(held) == sorted(seen)  # each key in one run
        assert {r["h1"]: r["docs"] for r in runs.resolved().collect()} == total
        assert {r["h1"] for r in runs.resolved(7).collect()} == {k for k, n in total.items() if n >= 7}
        assert max(runs.levels) >= 2 and all(len(v) < 2 for v in runs.levels.values())
    finally:
        runs.forget()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_a_failing_batch_leaves_no_tables(spark, table, monkeypatch):
    monkeypatch.setattr(line_dedup.Runs, "_compact", lambda self, level: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        line_dedup.dropped_lines(table[0], first_lines=50)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
