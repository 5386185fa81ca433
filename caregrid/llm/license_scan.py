"""Licence scan by exact set-similarity join.

Every text is cut into overlapping blocks of words (each passage of half a block lies whole in one). Templates of
like length share a block length, at least twice their own, so whole licences are looked for beside short notices.
A template meets a block if the share of its distinct words found in the block (containment) reaches the
template's threshold. Words are ranked by how often all documents hold them, rarest first; words of no
template cannot change an overlap and are left out. A template of n words that must share a = ceil(t * n)
needs only its first n - a + 1 words joined, a block of m words its first m - a + 1; a block with fewer than
a words is out (length filter), and a first common word at positions i and j allows at most
1 + min(n - i, m - j) - 1 more (positional filter). What is left is verified on the whole sets.
Phrase templates have threshold 1 and are then looked for word after word.

Words are runs of digits, letters and anything beyond ASCII, A-Z lower-cased. Null text counts as empty
(score 0, no labels). Rows are numbered, so repeated and null doc_ids stay apart. Equal scores need no order.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregrid.llm.common import map_batches, stored, text_or_empty

# Fixed value: the word pattern.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = 0.8
    phrase: bool = False  # all words, one after the other

    @property
    def words(self) -> list[str]:
        return WORD.findall(lower(self.text))


# Phrases and public licence notices.
TEMPLATES = (
    Template("cc-by", "cc by", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
    Template("reserved", "all rights reserved", 1.0, True),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files, to deal in the Software without restriction"),
    Template("mit", "Released under the MIT License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("gpl-notice", "This work is licensed under the GNU General Public License, version 3"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", 1.0),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", 1.0),
    Template("cc0", "dedicated to the public domain under CC0 1.0 Universal"),
    Template("copyright", "Copyright all rights reserved no part may be reproduced without permission"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
             "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
             "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
             "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
             "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
             "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
             "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
             "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
             "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
             "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
             "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
             "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
             "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
)
BLOCK = 64


def lower(text: str) -> str:
    """A-Z lower-cased, nothing else."""
    return text.encode().lower().decode()


def block_length(t: Template) -> int:
    """The shortest length, ``BLOCK`` doubled as often as need be, of which half holds the template."""
    n = BLOCK
    while n < 2 * len(t.words):
        n *= 2
    return n


def blocks_of(docs: DataFrame, vocabulary: Sequence[str], least: int, block: int = BLOCK) -> DataFrame:
    """(row, doc_id, n_words, blocks array<(block, places, tokens)>): where the vocabulary's words stand in each
    block of each text; blocks with fewer than ``least`` different ones are left out."""
    return blocks_by_length(docs, [(vocabulary, least, block)]).withColumnRenamed("blocks0", "blocks")


def blocks_by_length(docs: DataFrame, cuts: Sequence[tuple[Sequence[str], int, int]]) -> DataFrame:
    """``blocks_of`` for several (vocabulary, least, block length) at once, in columns blocks0, blocks1 and so on."""
    indexes = [{w: i for i, w in enumerate(v)} for v, _, _ in cuts]
    known = {w: [(k, own[w]) for k, own in enumerate(indexes) if w in own] for w in {w for own in indexes for w in own}}
    names = [f"blocks{k}" for k in range(len(cuts))]

    def make():
        def step(c):
            out = {n: [] for n in ("row", "doc_id", "n_words", *names)}
            for row, doc, text in zip(c["row"], c["doc_id"], c["text"], strict=True):
                words = WORD.findall(lower(text))
                halves: list[dict[int, tuple[list, list]]] = [{} for _ in cuts]
                for i, w in enumerate(words):
                    for k, token in known.get(w, ()):
                        own = halves[k].setdefault(2 * i // cuts[k][2], ([], []))
                        own[0].append(i)
                        own[1].append(token)
                for name, (_, least, _), own in zip(names, cuts, halves, strict=True):
                    blocks = []
                    for h in sorted({x for y in own for x in (y - 1, y) if x >= 0}):  # block h is halves h and h + 1
                        (p1, t1), (p2, t2) = own.get(h, ([], [])), own.get(h + 1, ([], []))
                        if len({*t1, *t2}) >= least:
                            blocks.append({"block": h, "places": p1 + p2, "tokens": t1 + t2})
                    out[name].append(blocks)
                for n, v in zip(("row", "doc_id", "n_words"), (row, doc, len(words)), strict=True):
                    out[n].append(v)
            return out

        return step

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("row", F.monotonically_increasing_id())
    return map_batches(src, make, "row long, doc_id long, n_words long, "
                       + ", ".join(f"{n} array<struct<block:int,places:array<int>,tokens:array<int>>>" for n in names))


def needed(t: Template) -> int:
    return max(1, math.ceil(t.threshold * len(set(t.words)) - 1e-9))


def matches(table: DataFrame, templates: Sequence[Template], vocabulary: Sequence[str]) -> DataFrame:
    """(row, template, block, containment, places, tokens): the blocks that meet a template's threshold."""
    spark = table.sparkSession
    blocks = table.select("row", F.inline("blocks"))
    freq = {r["token"]: r["n"] for r in blocks.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}  # one row per template word
    rank = {t: i for i, t in enumerate(sorted(range(len(vocabulary)), key=lambda i: (freq.get(i, 0), vocabulary[i])))}
    index = {w: i for i, w in enumerate(vocabulary)}

    prefix, rare = [], set()
    for k, t in enumerate(templates):
        own = sorted({rank[index[w]] for w in t.words})
        first = own[:len(own) - needed(t) + 1]
        prefix += [(k, own, needed(t), i, r) for i, r in enumerate(first)]
        rare.update(first)
    prefix = F.broadcast(spark.createDataFrame(prefix, "template int, wanted array<int>, need int, i int, word int"))  # words of the templates

    ranks = F.array(*[F.lit(rank[i]) for i in range(len(vocabulary))])
    telling = F.array(*[F.lit(i) for i in range(len(vocabulary)) if rank[i] in rare])
    blocks = blocks.where(F.arrays_overlap("tokens", telling))
    blocks = blocks.withColumn("set", F.sort_array(F.array_distinct(F.transform("tokens", lambda t: F.element_at(ranks, t + 1)))))
    pair = blocks.select("*", F.posexplode("set").alias("j", "word")).join(prefix, "word")
    n, m = F.size("wanted"), F.size("set")
    pair = pair.where((m >= F.col("need")) & (F.col("j") <= m - F.col("need")) & (1 + F.least(n - F.col("i") - 1, m - F.col("j") - 1) >= F.col("need")))
    shared = F.size(F.array_intersect("set", "wanted"))
    return pair.where(shared >= F.col("need")).select("row", "block", "template", (shared / n).alias("containment"), "places", "tokens").dropDuplicates(["row", "block", "template"])


def hits_of(table: DataFrame, templates: Sequence[Template], vocabulary: Sequence[str]) -> DataFrame:
    """(row, label, phrase, containment, start): phrases word after word, other templates by the threshold."""
    found = matches(table, templates, vocabulary)
    index = {w: i for i, w in enumerate(vocabulary)}
    label = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.col("template") + 1)
    phrase = F.element_at(F.array(*[F.lit(t.phrase) for t in templates]), F.col("template") + 1)
    wanted = F.element_at(F.array(*[F.array(*[F.lit(index[w]) for w in t.words]) for t in templates]), F.col("template") + 1)
    n = F.size("wanted")
    found = found.select("row", "block", "containment", "places", "tokens", label.alias("label"), phrase.alias("phrase"), wanted.alias("wanted"))
    starts = F.transform(F.filter(F.sequence(F.lit(1), F.size("tokens")), lambda i: (F.slice("tokens", i, n) == F.col("wanted"))
                                  & (F.element_at("places", F.least(i + n - 1, F.size("places"))) == F.element_at("places", i) + n - 1)),
                         lambda i: F.element_at("places", i))
    found = found.withColumn("starts", F.when(F.col("phrase"), starts).otherwise(F.array(F.col("places")[0])))
    return found.where(F.size("starts") > 0).select("row", "label", "phrase", "containment", F.explode("starts").alias("start"))


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, hits array<(label, phrase, start)>, score): one row per input row.

    A phrase hit has the place of its first word; other hits that of their block's first word. Templates may have
    any length, but for one without words, which is an error.
    """
    if not templates or not all(t.words for t in templates):
        raise ValueError("no templates, or one without words")
    by_length: dict[int, list[Template]] = {}
    for t in templates:
        by_length.setdefault(block_length(t), []).append(t)
    cuts = [(sorted({w for t in own for w in t.words}), min(map(needed, own)), n) for n, own in sorted(by_length.items())]
    table = stored(blocks_by_length(docs, cuts), "licence-blocks")
    hits = None
    for k, (vocabulary, _, n) in enumerate(cuts):
        own = hits_of(table.select("row", F.col(f"blocks{k}").alias("blocks")), by_length[n], vocabulary)
        hits = own if hits is None else hits.unionByName(own)
    per = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("label", "phrase", F.col("start").cast("long").alias("start")))).alias("hits"),
                                  F.max("containment").alias("score"))
    none = F.expr("array()").cast("array<struct<label:string,phrase:boolean,start:bigint>>")
    return table.select("row", "doc_id", "n_words").join(per, "row", "left").select(
        "doc_id", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("score", F.lit(0.0)).alias("score"))
