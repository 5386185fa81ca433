"""S1 for CSV files whose quoted fields hold line breaks, read in parallel.

Spark reads such a file in one task (``multiLine``). Here the text scan splits it at any byte. Whether a block starts
inside a quoted field depends on all blocks before it, so the first pass gives for each block what it turns either
start state into, these functions are composed file by file, and the second pass cuts each block into records from
its real state. Only records that cross a block border are gathered, by the block in which they start; all others stay
in their task. The records are parsed by Spark's own ``from_csv``.

A quote opens a field only as its first character and is doubled inside; other quotes are plain text. Empty lines are
skipped, CR LF ends a record like LF, line breaks inside quotes stay as they are. Records with more or fewer fields than
columns and a record whose quote is never closed go to the reject table whole. A compressed file is one block. The
driver holds one row per block, as Spark's scan does. A block that the first pass has not seen (a file or the split size has
changed since) is an error, never a guess.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = "file string, start long, seq long"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the end of a line is inside quotes, if its start is (``inside``) or is the start of a record."""
    i = 0
    while True:
        if not inside:
            if not line.startswith('"', i):
                i = line.find(",", i) + 1
                if not i:
                    return False
                continue
            i += 1
        quote = line.find('"', i)
        if quote < 0:
            return True
        if line.startswith('"', quote + 1):
            i, inside = quote + 2, True
            continue
        i, inside = line.find(",", quote + 1) + 1, False
        if not i:
            return False


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.col("value").alias("line"))


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str], list[bool]]]:
    """(file, start, lines, which hold a quote) for the rows of one block in each batch, in their order."""
    for b in batches:
        file, start = b.column(0), b.column(1)
        quoted = pc.match_substring(b.column(2), '"')
        at = 0
        while at < b.num_rows:
            f, s = file[at].as_py(), start[at].as_py()
            same = pc.and_(pc.equal(file.slice(at), f), pc.equal(start.slice(at), s))
            end = pc.index(same, False).as_py()
            n = b.num_rows - at if end < 0 else end
            yield f, s, b.column(2).slice(at, n).to_pylist(), quoted.slice(at, n).to_pylist()
            at += n


def _transitions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: dict[tuple[str, int], tuple[bool, bool]] = {}
    for f, s, lines, quoted in _blocks(batches):
        out, ins = rows.get((f, s), (False, True))
        for line, q in zip(lines, quoted, strict=True):
            if q:
                both = ends_inside(line, False), ends_inside(line, True)
                out, ins = both[out], both[ins]
        rows[f, s] = out, ins
    if rows:
        yield pa.RecordBatch.from_pylist([{"file": f, "start": s, "from_outside": a, "from_inside": b} for (f, s), (a, b) in rows.items()])


def block_states(lines: DataFrame) -> tuple[dict[tuple[str, int], int], set[tuple[str, int]]]:
    """Per block that starts inside a record, the block in which that record starts; the starts (file, block) of
    records that a later block continues or that never end."""
    rows = lines.mapInArrow(_transitions, "file string, start long, from_outside boolean, from_inside boolean").collect()  # one row per block
    begun: dict[tuple[str, int], int] = {}
    open_at_end: set[tuple[str, int]] = set()
    file, chain = None, None
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, chain = r["file"], None
        begun[file, r["start"]] = -1 if chain is None else chain
        ends_in = r["from_outside"] if chain is None else r["from_inside"]
        if not ends_in:
            chain = None
        else:
            # a block that starts inside may close that record and open another one; the second pass tells them apart
            open_at_end.add((file, r["start"]))
            chain = r["start"] if chain is None else chain
    return begun, open_at_end


def _records(states, only_pieces: bool, files: set[str] | None = None):
    """Whole records of each block (of ``files``, if given), or its pieces of records that cross its borders."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = states.value
        block, held, inside, seq, leading = None, [], False, 0, False

        def row(text, kind):
            return {"file": block[0], "start": block[1], "seq": seq, "kind": kind, "record": text}

        def rest():
            if not held:
                return []
            return [row("\n".join(held), "through" if leading else "tail")] if only_pieces else []

        for f, s, lines, quoted in _blocks(batches):
            if files is not None and f not in files:
                continue
            out = []
            if (f, s) != block:
                out += rest()
                if (f, s) not in state:
                    raise RuntimeError(f"block {s} of {f} was not seen by the first pass: the files or the split size have changed")
                block, held, seq = (f, s), [], 0
                inside = leading = state[f, s]
            for line, q in zip(lines, quoted, strict=True):
                held.append(line)
                if q:
                    inside = ends_inside(line, inside)
                if not inside:
                    text, held = ("\n".join(held) if len(held) > 1 else line), []
                    if only_pieces == leading:
                        out.append(row(text, "head" if leading else "whole"))
                    leading = False
                    seq += 1
            if out:
                yield pa.RecordBatch.from_pylist(out)
        if block is not None and (out := rest()):
            yield pa.RecordBatch.from_pylist(out)

    return run


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, start, seq, record, closed): the records of CSV files as text, in the order of (start, seq) in each file."""
    lines = _lines(spark, path)
    begun, open_at_end = block_states(lines)
    shape = f"{ORDER}, kind string, record string"
    states = spark.sparkContext.broadcast({k: v >= 0 for k, v in begun.items()})  # one flag per block
    whole = lines.mapInArrow(_records(states, False), shape).select("file", "start", "seq", "record", F.lit(True).alias("closed"))
    if not open_at_end:
        return whole
    # the files are told apart in the task: a filter on them would leave Spark fewer bytes to scan, and so other blocks
    crossing = {f for f, _ in open_at_end}
    pieces = lines.mapInArrow(_records(states, True, crossing), shape)
    # A record's first piece is a tail; the pieces up to the next tail are its own. One row per crossing, not per record.
    in_file = Window.partitionBy("file").orderBy("start", "seq")
    pieces = pieces.withColumn("own", F.sum((F.col("kind") == "tail").cast("long")).over(in_file))
    joined = pieces.groupBy("file", "own").agg(
        F.sort_array(F.collect_list(F.struct("start", "seq", "kind", "record"))).alias("p"))
    crossed = joined.select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["seq"].alias("seq"),
                            F.array_join(F.col("p")["record"], "\n").alias("record"),
                            F.exists("p", lambda x: x["kind"] == "head").alias("closed"))
    return whole.unionByName(crossed)


def read_csv_records(spark: SparkSession, path: str | list[str], columns: list[str], header: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows (``columns`` as text, then ``src_ord``) and the rejected records with their reason.

    ``src_ord`` is (file, block start, place in the block). With ``header`` the first record of each file is left out.
    """
    if len({c.lower() for c in columns}) < len(columns) or any(c.lower() in ("src_ord", "_bad") for c in columns):
        raise ValueError("column names repeat, or are src_ord or _bad")
    ddl = ", ".join("`{}` string".format(c.replace("`", "``")) for c in [*columns, "_bad"])
    rec = read_records(spark, path)
    if header:
        rec = rec.where("not (start = 0 and seq = 0)")
    else:
        rec = rec.withColumn("record", F.when(F.expr("start = 0 and seq = 0"), F.regexp_replace("record", "^﻿", "")).otherwise(F.col("record")))
    text = F.regexp_replace("record", "\r$", "")
    rec = rec.withColumn("record", text).where("record != ''")
    options = {"escape": '"', "multiLine": "true", "columnNameOfCorruptRecord": "_bad", "maxCharsPerColumn": "-1"}
    parsed = rec.withColumn("row", F.from_csv("record", F.lit(ddl), options))
    good = F.col("closed") & F.col("row")["_bad"].isNull()
    src_ord = F.struct("file", "start", "seq").alias("src_ord")
    rows = parsed.where(good).select(*[F.col("row")[c].alias(c) for c in columns], src_ord)
    rejects = parsed.where(~good).select("file", "start", "seq", "record", F.when(F.col("closed"), "number of fields").otherwise("quote not closed").alias("reason"))
    return rows, rejects

