"""Toxicity by compression distance.

Two zstandard dictionaries are trained on windows of ``WINDOW`` words of labelled documents, one on toxic and one on
ordinary text, and every window of a text is compressed with each. Toxic documents are mostly made of the same prose
as others, so the shared part has to cancel: the toxic dictionary stands behind the content of the ordinary one, and
both are trained in rounds. At first the toxic one learns from the windows of toxic documents that the ordinary
dictionary compresses worst. Then windows of ordinary documents that come out shorter by it go into the ordinary
training set and, trained by themselves, into the ordinary content, and the toxic one learns anew from those windows
of toxic documents whose gain is farthest from such common text. The round with the best calibration is taken.

A document's largest differences of compressed length, its number of windows at each difference and its number of
windows go into a logistic calibration, fitted on labelled documents that the dictionaries have not seen. Windows
slide over the whole text, ``STRIDE`` words at a time, and word by word around those that are ``CLOSER`` bytes shorter
(and where the dictionaries learn). One that shares no ``GRAM`` bytes with the toxic dictionary (found for all windows at once, by a table of hashed grams) counts as
equally long under both and is not compressed.

Null text counts as empty and gets the score of a text without windows. Without labels of both kinds every
score is 0. Extra columns and repeated rows pass through; labels of one doc_id are merged (any 1 wins).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caregrid.llm.common import map_batches, stored, text_or_empty

FOLDS, HELD_OUT = 5, 0  # crc32(doc_id as text) mod 5 = 0 is never learnt from
SAMPLE = 2000  # toxic documents at most; twice as many ordinary ones; a third of each calibrates
WINDOW, STRIDE = 3, 2  # words of a window, and from one scored window to the next: every two neighbours share one
CLOSER = 2  # bytes from which on the windows beside one are looked at too
BASE_BYTES, TOXIC_BYTES, LEAST_BYTES = 32_768, 16_384, 4_096
TOXIC_WINDOWS, ORDINARY_WINDOWS, CHOSEN = 500, 16, 20_000  # windows learnt from: of a document, and of all in a round
ROUNDS, JUDGED = 7, 5  # rounds of training; the last ones are judged by their calibration
GRAM, TABLE = 4, 1 << 20
BATCH, CHARACTERS = 2_000, 200_000  # windows of a call of the compressor, and characters of texts compared together
FRAME = b"\n=== window ===\n"
STEPS = (3, 4, 5, 6, 7, 8, 10, 12)


@dataclass(frozen=True)
class Model:
    """Dictionaries and calibration; a few dozen kB."""

    base: bytes
    toxic: bytes
    weights: tuple[float, ...] | None = None


def _codes(b: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on."""
    x = np.zeros(max(0, len(b) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        x = x << np.uint64(8) | b[i:len(b) - GRAM + 1 + i]
    return (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)  # 20 bits


def windows(text: str) -> tuple[bytes, np.ndarray]:
    """The lower-cased words between single blanks, and the places of the blanks."""
    words = text.lower().encode(errors="replace").split()
    joined = b" " + b" ".join(words) + b" " if words else b""
    return joined, np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)


def ends(blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each window starts and ends, with the blanks around it; a shorter text is one window."""
    n = max(0, len(blanks) - 1)
    first = np.arange(max(1, n - WINDOW + 1) if n else 0)
    return blanks[first], blanks[np.minimum(first + WINDOW, n)] + 1


def distinct_windows(text: str) -> list[bytes]:
    joined, blanks = windows(text)
    return sorted({joined[a:b] for a, b in zip(*map(np.ndarray.tolist, ends(blanks)), strict=True)}, key=lambda w: (zlib.crc32(w), w))


def framed(some: list[bytes]) -> list[zstandard.BufferWithSegments]:
    """The windows between frames, ``BATCH`` to a buffer, where two neighbours share the frame between them."""
    out, frame = [], np.uint64(len(FRAME))
    for i in range(0, len(some), BATCH):
        part = some[i:i + BATCH]
        size = np.fromiter(map(len, part), np.uint64, len(part))
        start = np.cumsum(size + frame) - size - frame
        out.append(zstandard.BufferWithSegments(FRAME + FRAME.join(part) + FRAME, np.stack([start, size + 2 * frame], axis=1).tobytes()))
    return out


def lengths(content: bytes):
    """A function from a window to its compressed length with this dictionary content; ``many`` of it takes a list of
    windows and ``each`` takes them ``framed``, so many to a call of the library, which costs less than half of a call for each."""
    d = zstandard.ZstdCompressionDict(content + FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=3)
    compressor = zstandard.ZstdCompressor(dict_data=d, level=3, write_content_size=False, write_checksum=False, write_dict_id=False)

    def one(window: bytes) -> int:
        return len(compressor.compress(FRAME + window + FRAME))

    def each(buffers: list[zstandard.BufferWithSegments]) -> np.ndarray:
        return np.array([len(x) for b in buffers for x in compressor.multi_compress_to_buffer(b, threads=1)], np.int64)

    one.each, one.many = each, lambda some: each(framed(some))
    return one


def differences(model: Model):
    """A function from a text to the bytes that each of its windows is shorter by under the toxic dictionary (distinct
    windows; those that share no gram with it are left out), and the number of windows; ``many`` of it takes texts."""
    ordinary, toxic = lengths(model.base).each, lengths(model.base + model.toxic).each
    table = np.zeros(TABLE, bool)
    table[_codes(np.frombuffer(model.toxic, np.uint8))] = True

    def placed(text: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The words, where windows start and end, and which of them share a gram."""
        joined, blanks = windows(text)
        start, end = ends(blanks)
        shared = np.concatenate([[0], np.cumsum(table[_codes(np.frombuffer(joined, np.uint8))])])
        last = np.maximum(start, np.minimum(end - GRAM + 1, len(shared) - 1))
        return joined, start, end, shared[last] > shared[np.minimum(start, len(shared) - 1)]

    def many(texts: list[str]) -> list[tuple[list[int], int]]:
        parts = [placed(t) for t in texts]
        known: dict[bytes, int] = {}
        found: list[dict[bytes, int]] = [{} for _ in parts]

        def compare(wanted: list[np.ndarray]) -> list[list[int]]:
            """Compares these windows of each text; those that are ``CLOSER`` bytes shorter."""
            at = [some[shares[some]] for some, (_, _, _, shares) in zip(wanted, parts, strict=True)]
            cut = [[joined[a:b] for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)]
                   for some, (joined, start, end, _) in zip(at, parts, strict=True)]
            new = list({w: None for ws in cut for w in ws if w not in known})
            buffers = framed(new)
            known.update(zip(new, (ordinary(buffers) - toxic(buffers)).tolist(), strict=True))
            closer = []
            for of, some, ws in zip(found, at, cut, strict=True):
                d = list(map(known.__getitem__, ws))
                of.update(zip(ws, d, strict=True))
                closer.append(some[np.array(d, np.int64) >= CLOSER].tolist())
            return closer

        n = [len(start) for _, start, _, _ in parts]
        first = compare([np.unique(np.append(np.arange(0, m, STRIDE), m - 1)) if m else np.zeros(0, np.int64) for m in n])
        compare([np.array(sorted({j for i in some for j in range(max(0, i - STRIDE + 1), min(m, i + STRIDE))}), np.int64)
                 for some, m in zip(first, n, strict=True)])
        return [(list(of.values()), m) for of, m in zip(found, n, strict=True)]

    def one(text: str) -> tuple[list[int], int]:
        return many([text])[0]

    one.many = many
    return one


def features_of(texts: list[str], difference) -> list[list[float]]:
    """The features of each text, ``CHARACTERS`` of text at a time."""
    out, part, held = [], [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= CHARACTERS:
            out += [_features(*of) for of in difference.many(part)]
            part, held = [], 0
    return out + [_features(*of) for of in difference.many(part)]


def _features(found: list[int], n: int) -> list[float]:
    d = sorted((x for x in found if x >= STEPS[0]), reverse=True)
    largest = (d[:3] + [0] * 3)[:3]
    return [1.0, *map(float, largest), *[math.log1p(sum(x >= s for x in d)) for s in STEPS], math.log1p(n)]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` toxic and ``2 * sample`` ordinary labelled documents, chosen by hash."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")).where(fold() != HELD_OUT)
    counts = {r["toxic"]: r["n"] for r in known.where("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    order = F.xxhash64(F.lit("sample"), "doc_id")
    ids = known.where("toxic = 1").orderBy(order, "doc_id").limit(sample).union(
        known.where("toxic = 0").orderBy(order, "doc_id").limit(2 * sample))
    ids = ids.withColumn("calibrates", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)) == 0)
    chosen = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
                    .join(F.broadcast(stored(ids, "toxic-ids")), "doc_id"), "toxic-sample")  # 3 * sample ids at most
    share = counts[1] / (counts[0] + counts[1])  # the sample has more toxic rows than the labels
    best = None
    for model in _dictionaries(chosen.where("not calibrates")):
        found = _calibrated(model, chosen.where("calibrates"), share)
        if found is not None and (best is None or found[1] < best[1]):
            best = found
    return best and best[0]


def _calibrated(model: Model, sample: DataFrame, share: float) -> tuple[Model, float] | None:
    """The model with its weights, and its loss on the sample."""

    def make():
        difference = differences(model)
        return lambda c: {"toxic": c["toxic"], "x": features_of(c["text"], difference)}

    rows = map_batches(sample.select("toxic", "text"), make, "toxic int, x array<double>").collect()  # sample rows
    if len({r["toxic"] for r in rows}) < 2:
        return None
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w = fit_logistic(x, y, weight)
    z = np.clip(x @ w, -30, 30)
    return Model(model.base, model.toxic, tuple(w.tolist())), float((weight * (np.log1p(np.exp(z)) - y * z)).sum())


def _content(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(samples)[:size]


def _dictionaries(sample: DataFrame) -> Iterator[Model]:
    """The models of the last ``JUDGED`` rounds, not calibrated yet; the sample's windows (so many of a document) are held here."""

    def make():
        def step(c):
            return {"toxic": c["toxic"], "windows": [distinct_windows(t)[:TOXIC_WINDOWS if y else ORDINARY_WINDOWS] for t, y in zip(c["text"], c["toxic"], strict=True)]}

        return step

    rows = map_batches(sample.select("text", "toxic"), make, "toxic int, windows array<binary>").collect()
    ordinary = sorted(bytes(w) for r in rows if not r["toxic"] for w in r["windows"])
    bad = sorted({bytes(w) for r in rows if r["toxic"] for w in r["windows"]})
    if not ordinary or not bad:
        return
    base = _content(ordinary, BASE_BYTES)
    plain = lengths(base).many(bad).tolist()
    worst = sorted((-n / len(w) ** 0.5, w) for n, w in zip(plain, bad, strict=True))
    toxic = _content([w for _, w in worst[:max(1, len(bad) // 3)]], TOXIC_BYTES)
    for i in range(ROUNDS):
        a, b = lengths(base).many, lengths(base + toxic).many
        common = [w for w, d in zip(ordinary, a(ordinary) - b(ordinary), strict=True) if d >= STEPS[0]]
        more = _content(common, TOXIC_BYTES // 2) if len(common) > 20 else b""
        base = _content(ordinary + 4 * common, BASE_BYTES) + more
        shorter, plain = b(bad), lengths(base).many
        closer = np.flatnonzero(a(bad) - shorter >= STEPS[0]).tolist()
        gain = sorted((x - y, bad[i]) for i, x, y in zip(closer, shorter[closer].tolist(), plain([bad[i] for i in closer]).tolist(), strict=True))
        if not gain:
            break
        toxic = _content([w for _, w in gain[:CHOSEN]], max(LEAST_BYTES, TOXIC_BYTES >> i))
        if i >= ROUNDS - JUDGED:
            yield Model(base, toxic)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, text_hash, score): one row per input row."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), text_or_empty().alias("text"))
    if model is None or model.weights is None:
        return src.select("doc_id", "text_hash", F.lit(0.0).alias("score"))

    def make():
        difference, w = differences(model), np.array(model.weights)

        def step(c):
            z = np.array(features_of(c["text"], difference)).reshape(-1, len(w)) @ w
            return {"doc_id": c["doc_id"], "text_hash": c["text_hash"], "score": (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()}

        return step

    return map_batches(src, make, "doc_id long, text_hash long, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``, all columns as they were."""
    model = train(docs, labels)
    if model is None or model.weights is None:
        return docs
    w, schema = model.weights, docs.schema

    def run(batches):
        import pyarrow as pa

        difference, v = differences(model), np.array(w)
        for b in batches:
            z = np.array(features_of([t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()], difference)).reshape(-1, len(v)) @ v
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold))

    return docs.mapInArrow(run, schema)
