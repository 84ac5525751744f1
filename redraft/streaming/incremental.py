"""The same planning over files and results that keep arriving (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redraft.functions.text import lines_of
from redraft.operators.planning import whole_file_edits


def edits_of_arriving_files(files: DataFrame, mappings: DataFrame) -> DataFrame:
    """Edits of every file (file, text) of a stream as it arrives; no state is kept.  mappings is a static table."""
    lines = files.select("file", F.posexplode(lines_of(F.coalesce("text", F.lit("")))).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")
    return whole_file_edits(lines, mappings)


def outcome_counts(results: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(window, outcome, n) over a stream of results (ts, file, seq, outcome): a result that is sent again within the watermark counts once, one that comes later than `late` no more."""
    once = results.withWatermark("ts", late).dropDuplicatesWithinWatermark(["file", "seq"])
    return once.groupBy(F.window("ts", width), "outcome").agg(F.count("*").alias("n"))
