"""Streams driven to their end from files."""

import datetime as dt

from redraft.streaming import incremental


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.sql(f"SELECT * FROM {name}")


def test_edits_of_arriving_files(spark, tmp_path):
    spark.createDataFrame([("a", "old\nolder"), ("b", None), ("c", "x\nold old")], "file string, text string").write.parquet(f"{tmp_path}/in")
    mappings = spark.createDataFrame([("old", "new"), ("older", "newer")], "old_text string, new_text string")
    stream = spark.readStream.schema("file string, text string").parquet(f"{tmp_path}/in")
    got = run(incremental.edits_of_arriving_files(stream, mappings), "arriving_edits", "append")
    assert sorted((r["file"], r["line"], r["old_text"]) for r in got.collect()) == [("a", 1, "old"), ("a", 2, "older"), ("c", 2, "old")]


def test_outcome_counts(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(at(0), "a", 1, "applied"), (at(1), "a", 1, "applied"), (at(2), "a", 2, "failed"), (at(6), "b", 1, "applied")]
    spark.createDataFrame(rows, "ts timestamp, file string, seq long, outcome string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, file string, seq long, outcome string").parquet(f"{tmp_path}/in")
    got = run(incremental.outcome_counts(stream), "outcomes", "update")
    assert sorted((r["window"]["start"].minute, r["outcome"], r["n"]) for r in got.collect()) == [(0, "applied", 1), (0, "failed", 1), (5, "applied", 1)]
