"""Language identification by rank-order n-gram profiles.

A profile is a text's most frequent character n-grams (1 to 3, words padded with a blank), most frequent
first. A document goes to the language whose profile has the smallest out-of-place distance: the sum over the
document's n-grams of how far their ranks lie apart, or a fixed maximum where the language lacks the n-gram.
Language profiles are counted over all labelled training documents: each task adds up its documents and only
sums per (language, n-gram) are shuffled.

Null text, or a text without a letter: ``und`` with score 0. Null doc_id: held out like any other id by the
checksum of the empty string. Ties go to the smaller language value. Without training rows all are ``und``. More than
``MAX_LANGUAGES`` learnt values (a column that holds no languages) are an error before any profile is counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caregrid.llm.common import map_batches, text_or_empty

TOP, ORDERS = 300, (1, 2, 3)
FOLDS, HELD_OUT = 4, 2
MAX_LANGUAGES = 1000  # every task holds the profiles of all
FLUSH = 400_000  # n-grams that a task holds per language before it hands its sums on
_BITS = 21  # of a code point


def fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


def letters(known: dict[str, str], text: str) -> str:
    """Lower-cased, each run of other characters than letters one blank, a blank at both ends."""
    low = text.lower()
    for c in set(low):
        if c not in known:
            known[c] = c if c.isalpha() else " "
    return " " + " ".join(low.translate({ord(c): " " for c in set(low) if known[c] == " "}).split()) + " "


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text from ``letters`` as numbers, and their counts; none runs across a blank."""
    a = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    blank = a == 32
    parts = [a[~blank]]
    two = (a[:-1] << _BITS) | a[1:]
    parts.append(two)
    if len(a) > 2:
        parts.append(((two[:-1] << _BITS) | a[2:])[~blank[1:-1]])
    every = np.concatenate(parts)
    every.sort()
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[first], np.diff(np.append(first, len(every)))


def ranked(gram: np.ndarray, count: np.ndarray, top: int = TOP) -> np.ndarray:
    """The ``top`` most frequent n-grams, ties to the smaller number."""
    if len(gram) > top:
        least = np.partition(count, len(count) - top)[len(count) - top]
        near = count >= least
        gram, count = gram[near], count[near]
    return gram[np.lexsort((gram, -count))][:top]


def profiles(docs: DataFrame, top: int = TOP) -> dict[str, np.ndarray]:
    """Per language its ranked n-grams; ``top`` per language reach the driver."""
    if docs.select("lang").where("lang is not null").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: clean the column first")

    def count(batches):
        known: dict[str, str] = {}
        sums: dict[str, list] = {}

        def merged(parts):
            g, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return g, np.bincount(inv, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def out(lang, g, n):
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = letters(known, text)
                if len(t) > 2:
                    sums.setdefault(lang, []).append(grams(t))
                    if len(sums[lang]) >= 256:
                        sums[lang] = [merged(sums[lang])]
                        if len(sums[lang][0][0]) > FLUSH:
                            yield out(lang, *sums.pop(lang)[0])
        for lang, parts in sums.items():
            yield out(lang, *merged(parts))

    n = docs.select(F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text")).where("lang is not null").mapInArrow(
        count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = n.withColumn("place", place).where(F.col("place") <= top).collect()
    out: dict[str, list] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["place"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in out.items()}


def classify(docs: DataFrame, by: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """(doc_id, lang_pred, score): score is the second-best distance's share of the best two."""
    langs = sorted(by)
    every = np.unique(np.concatenate([by[x] for x in langs])) if langs else np.empty(0, np.int64)
    place = np.full((len(langs), len(every) + 1), -1, np.int32)  # the last column: in no profile
    for i, x in enumerate(langs):
        place[i, np.searchsorted(every, by[x])] = np.arange(len(by[x]))

    def make():
        known: dict[str, str] = {}

        def step(c):
            pred, score = [], []
            for text in c["text"]:
                t = letters(known, text)
                if len(t) <= 2 or not langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                own = ranked(*grams(t), top)
                at = np.searchsorted(every, own)
                at[(at == len(every)) | (every[np.minimum(at, len(every) - 1)] != own)] = len(every)
                p = place[:, at]
                d = np.where(p >= 0, np.abs(p - np.arange(len(own))), top).sum(axis=1)
                i = int(d.argmin())
                rest = float(np.delete(d, i).min()) if len(langs) > 1 else float(top * len(own))
                pred.append(langs[i])
                score.append(rest / (rest + float(d[i])) if rest + float(d[i]) else 0.5)
            return {"doc_id": c["doc_id"], "lang_pred": pred, "score": score}

        return step

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_batches(src, make, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Learn from the documents outside the held-out fold and predict all."""
    return classify(docs, profiles(docs.where(fold() != HELD_OUT), top), top)


