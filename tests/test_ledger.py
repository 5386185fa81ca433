"""The call ledger: equal messages once, a lost task repeats at most one commit's calls, failures are sent again."""

import os

from caregrid.operators import inference as INF
from caregrid.sources import ledger as L
from caregrid.sources.files import read_table


def asked(spark, n, distinct):
    df = spark.range(n).selectExpr("id", f"cast(id % {distinct} as string) t")
    return df.withColumn("m", INF.messages("sys", df.t))


def counting(folder, kill_at=None):
    """A completer that notes every call in a folder; it fails for one text while ``<folder>.broken`` exists."""
    folder = str(folder)

    def call(msgs):
        text = msgs[-1]["content"]
        n = len(os.listdir(folder))
        open(os.path.join(folder, f"{n}-{text}-{os.getpid()}-{os.urandom(4).hex()}"), "w").close()
        if kill_at is not None and n + 1 == kill_at:
            os._exit(1)  # the worker dies in the middle of the task
        if text == "3" and os.path.exists(folder + ".broken"):
            raise RuntimeError("no")
        return {"content": "re " + text, "prompt_tokens": 2, "completion_tokens": 1}

    return call


def calls(folder):
    return [f.split("-")[1] for f in os.listdir(folder)]


def test_equal_messages_once_and_only_missing_ones(spark, tmp_path):
    folder, path = tmp_path / "calls", str(tmp_path / "ledger")
    folder.mkdir()
    (tmp_path / "calls.broken").touch()
    c = counting(folder)
    df = asked(spark, 60, 12)
    out = L.complete_once(df, "m", c, path, partitions=3, commit_rows=2)
    rows = out.collect()
    assert len(rows) == 60 and len(calls(folder)) == 12
    assert all((r["content"], r["call_error"]) == ((None, "RuntimeError: no") if r["t"] == "3" else ("re " + r["t"], None)) for r in rows)
    plain = INF.complete(df, "m", counting(folder))
    assert out.columns == plain.columns and out.schema["input_hash"] == plain.schema["input_hash"]
    assert {r["input_hash"] for r in rows} == {r["input_hash"] for r in plain.collect()}
    for f in os.listdir(folder):
        os.remove(folder / f)
    os.remove(tmp_path / "calls.broken")
    again = L.complete_once(asked(spark, 60, 14), "m", c, path, partitions=3).collect()
    assert sorted(calls(folder)) == ["12", "13", "3"]
    assert all(r["content"] == "re " + r["t"] and r["call_error"] is None for r in again)


def test_a_killed_task_repeats_at_most_one_commit(tmp_path):
    import subprocess
    import sys

    folder, path, repo = tmp_path / "calls", str(tmp_path / "ledger"), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder.mkdir()
    code = (f"import sys; sys.path[:0] = [{repo!r}, {os.path.dirname(os.path.abspath(__file__))!r}]\n"
            "from caregrid.session import build_session\n"
            "from pyspark.cloudpickle import register_pickle_by_value\n"
            "import test_ledger as T; register_pickle_by_value(T)\n"
            "s = build_session(master='local[1,3]', shuffle_partitions=1)\n"  # a task may fail twice
            f"out = T.L.complete_once(T.asked(s, 40, 40), 'm', T.counting({str(folder)!r}, 23), {path!r}, partitions=1, commit_rows=5)\n"
            "print(out.where(\"content = concat('re ', t)\").count())\n")
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert done.stdout.strip().endswith("40"), done.stderr[-1500:]
    sent = calls(folder)
    assert len(set(sent)) == 40 and 40 < len(sent) <= 45  # at most one commit's calls again


def test_extraction_through_a_ledger(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    bronze = spark.createDataFrame([(f"f{i}", f"surgery {i}") for i in range(9)], "facility_id string, composite_text string")
    paths = [str(tmp_path / n) for n in ("silver", "failures", "calls_table")]
    m = INF.run_extract(bronze, INF.OfflineCompleter(), *paths, ledger=str(tmp_path / "ledger")).first()
    assert (m["ok"], m["failed"]) == (9, 0) and read_table(spark, paths[0]).count() == 9
    assert L.replies(spark, str(tmp_path / "ledger")).count() == 9
