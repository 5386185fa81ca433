"""A table with every awkward case beside ordinary documents; extra columns clash with names used inside."""

import os

import pytest

SF = "/root/testdata/sf0.001"
CLASH = ["row", "size", "key", "spans", "block", "fp", "value", "score", "Lines"]
LICENCE = "This work is licensed under the GNU General Public License, version 3."
SHARED = "a passage that many of the documents hold, word for word, so that it is a repeated line"


def awkward():
    rows = [
        (9001, None, "en", "s1"), (9002, "", "en", "s1"), (9003, "   \n\t ", None, None), (None, "a text without an id", "en", "s2"),
        (None, "another text without an id", None, "s2"), (9004, "x" * 200_000, "en", "s2"), (9005, "word " * 60_000, "en", "s3"),
        (9006, "repeated row, repeated row", "en", "s3"), (9006, "repeated row, repeated row", "en", "s3"),
        (9007, "12345 67890 ... !!!", "de", "S3"), (9008, "İÉÀ ÀÉ \U0001f600 cc by CC BY cc\nby, cc. by", "fr", "é"),
        (9009, f"{LICENCE}\nAll Rights Reserved. all rights RESERVED all rights", "en", ""),
        (9010, "write to a@b.c_d@e.f.g, x..y@h-i.jk. or +1 (555) 123-4567 8 or 4111 1111 1111 1111 from 1.2.3.4.5.6.7.8 and 256.1.1.1", "en", "s1"),
        (9011, "contact joe (at) example (dot) com, tel 555-123-4567 and card 4111-1111-1111-1112", "en", "s1"),
        (9012, "9" * 30_000, "en", "s1"), (9013, "a.b" * 20_000 + "@", "en", "s1"),
    ]
    rows += [(9100 + i, f"opening {i}\n  {SHARED.upper() if i % 2 else SHARED}\t\nshort\n{SHARED}", "en", "s1") for i in range(7)]
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 6
    rows += [(9200 + i, near + ("" if i < 3 else f"end{i}"), "en", "s4") for i in range(6)]
    return rows


@pytest.fixture(scope="session")
def table(spark):
    """(DataFrame, its rows as (doc_id, text, lang, source))."""
    rows = awkward()
    if os.path.isdir(SF):
        rows += [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    cols = ["doc_id long", "text string", "lang string", "source string", "n_chars long", *[f"{c} string" for c in CLASH]]
    data = [(*r, None if r[1] is None else len(r[1]), *["?"] * len(CLASH)) for r in rows]
    return spark.createDataFrame(data, ", ".join(cols)).repartition(3).cache(), rows


@pytest.fixture(scope="session")
def nothing(table):
    return table[0].where("false")
