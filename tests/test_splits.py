"""Lines of files read in splits, against whole files."""

import pytest

from redraft.operators import edits as ed
from redraft.sources import readers, splits


@pytest.fixture(scope="module")
def small_splits(spark):
    """A session that cuts files into splits of 50 bytes."""
    session = spark.newSession()
    for key, value in (("maxPartitionBytes", "50b"), ("openCostInBytes", "0"), ("minPartitionNum", "3")):
        session.conf.set(f"spark.sql.files.{key}", value)
    return session


TEXTS = {
    "plain": "one\ntwo\n\nthree\n", "open": "one\ntwo", "crlf": "a\r\nb\r\n\r\nc\r\n", "open crlf": "a\r\nb", "bare cr": "a\rb\r\rc\n", "last cr": "a\nb\r", "empty": "", "end": "\n", "ends": "\n\n\r\n",
    "long line": "x" * 700 + "\n" + "y" * 120 + "\nz\n", "many": "".join(f"line {i} é{'w' * (i % 23)}\n" for i in range(900)), "mark": "\ufeffone\ntwo\n" * 9, "open mark": "\ufeffone\r\n" + "two\r\n" * 30 + "three\r", "only mark": "\ufeff",
    "repeated": "same\n" * 400, "mixed": "a\r\nb\nc\r\r\nd",
}


@pytest.mark.parametrize("most", [0, 1000])
def test_lines_of_splits_are_those_of_whole_files(small_splits, tmp_path, most):
    for name, text in TEXTS.items():
        (tmp_path / f"{name.replace(' ', '-')}.txt").write_bytes(text.encode())
    path = str(tmp_path)
    want = sorted(tuple(r) for r in readers.source_lines(readers.files(small_splits, path)).where("file not like '%only-mark%'").collect())
    got = splits.split_lines(small_splits, path, most)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 1300
    starts = splits.line_splits(splits.raw_lines(small_splits, path)).collect()
    assert max(sum(r["file"] == s["file"] for r in starts) for s in starts) > 20  # the longest file is the work of many splits
    ends = {r["file"]: r["ending"] for r in ed.endings(readers.files(small_splits, path)).collect()}
    found = {r["file"]: r["ending"] for r in splits.file_endings(small_splits, path).collect()}
    assert found == {f: e for f, e in ends.items() if any(r[0] == f for r in want)}


def test_splits_of_no_lines(small_splits, tmp_path):
    (tmp_path / "empty.txt").write_bytes(b"")
    assert splits.split_lines(small_splits, str(tmp_path)).collect() == []


def test_text_is_not_shuffled(small_splits, tmp_path):
    (tmp_path / "a.txt").write_text("some text\n" * 50)
    plan = splits.split_lines(small_splits, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
