"""Published runs: all files or none."""

import os

import pytest
from pyspark.sql import functions as F

from redraft.operators import edits as ed
from redraft.sources import readers, writer


def tree(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.startswith("."))


@pytest.fixture
def files(spark):
    texts = [("a/one.txt", "x\ny\n"), ("file:///b/two three+4%.txt", "no end"), ("/c.txt", "a\r\nb\r\n"), ("d/é.txt", ""), ("e.txt", None)]
    return spark.createDataFrame(texts * 1, "file string, text string").repartition(3)


def test_what_is_published_is_read_back(spark, files, tmp_path):
    writer.publish(files, str(tmp_path), "r1")
    got = {r["file"]: r["text"] for r in writer.published(spark, str(tmp_path), "r1").collect()}
    assert got == {"a/one.txt": "x\ny\n", "b/two three+4%.txt": "no end", "c.txt": "a\r\nb\r\n"}  # empty files are there, but have no rows
    assert {x.split("/", 2)[2] for x in tree(tmp_path)} == {"a/one.txt", "b/two three+4%.txt", "c.txt", "d/é.txt", "e.txt"}
    assert sorted(os.listdir(tmp_path)) == ["run=r1"]
    writer.publish(files.where("file like 'a%'"), "file://" + str(tmp_path), "r2")  # runs side by side
    assert writer.published(spark, str(tmp_path), "r2").count() == 1 and len(tree(tmp_path)) == 6


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), F.when(F.col("id") == 37, F.raise_error(F.lit("broken"))).otherwise(F.lit("t")).alias("text")).repartition(4)
    with pytest.raises(Exception, match="broken"):
        writer.publish(rows, str(tmp_path), "r")
    assert tree(tmp_path) == [] and not any(x.startswith("run=") for x in os.listdir(tmp_path))
    bad = spark.createDataFrame([("ok", "1"), ("../out", "2")], "file string, text string").repartition(2)
    with pytest.raises(Exception, match="not a path below"):
        writer.publish(bad, str(tmp_path), "r")
    assert tree(tmp_path) == []


def test_attempts_that_did_not_count_are_not_published(tmp_path):
    """A task that was run twice: only the folder that its message names is published."""
    p = writer.Publisher(str(tmp_path), "r")
    lost, kept, empty = p.write(iter([{"file": "x", "text": "old"}])), p.write(iter([{"file": "x", "text": "new"}])), p.write(iter([]))
    p.commit([kept, None, empty])
    assert tree(tmp_path) == ["run=r/0/x"] and open(tmp_path / "run=r/0/x").read() == "new" and lost.files == 1
    again = writer.Publisher(str(tmp_path), "r")
    told = again.write(iter([{"file": "y", "text": "z"}]))
    with pytest.raises(FileExistsError):
        again.commit([told])
    again.abort([told])
    assert tree(tmp_path) == ["run=r/0/x"]


def test_changed_files_keep_their_endings(spark, tmp_path):
    texts = spark.createDataFrame([("a", "old\nb\n"), ("b", "old"), ("c", "x\r\nold\r\n"), ("d", "same\n")], "file string, text string")
    lines = readers.source_lines(texts)
    edits = lines.where("contains(text, 'old')").select("file", "line", F.lit(1).alias("seq"), F.lit("old").alias("old_text"), F.lit("new").alias("new_text"), F.lit("r").alias("rule_id"), F.lit(False).alias("replace_all"))
    changed = ed.changed_files(edits, lines, ed.endings(texts))
    writer.publish(changed, str(tmp_path), "r")
    assert {r["file"]: r["text"] for r in writer.published(spark, str(tmp_path), "r").collect()} == {"a": "new\nb\n", "b": "new", "c": "x\nnew\r\n"}
