"""Lines of files that are read in splits: a large file is the work of many tasks and its lines are never gathered.

A task reads a split of a file line by line.  Spark numbers the rows of a task in the order it reads them, so
a line's place in its split is its number less the split's least one.  One aggregation gives a row for each
split: its least number, its lines and bytes.  Prefix sums over the splits of a file in the order of their offsets say how many
lines lie before each, and the lines of a split then get their numbers by a join with that small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redraft.operators.graph import saved

#: Tables of up to so many splits (some 100 bytes each) go to every task; longer ones meet the lines by a shuffle.
MOST_BROADCAST = 1_000_000
#: Endings of files that are not read in splits and whose size says nothing about their lines.
PACKED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, size, at, raw): every line as it stands before its LF, with its split's offset and a number that grows along the split."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))


def line_splits(raw: DataFrame) -> DataFrame:
    """A row for each split that has lines: (file, start, first_at, n_lines, before, total, ended, marked).

    before: lines of the file that lie in earlier splits; total: all of the file; ended: whether an LF ends its last line; marked: whether the file begins with a byte order mark, which reading takes away.
    """
    own = raw.groupBy("file", "start").agg(F.min("at").alias("first_at"), F.count("*").alias("n_lines"), F.sum(F.octet_length("raw") + F.lit(1).cast("long")).alias("n_bytes"), F.min("size").alias("size"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("file")
    # bytes of the file beyond its lines with an LF each: one less without a last LF, three more with a mark
    beyond = F.min("size").over(every) - F.sum("n_bytes").over(every)
    plain = ~F.col("file").rlike(PACKED)
    return own.select(
        "file", "start", "first_at", "n_lines", F.coalesce(F.sum("n_lines").over(earlier), F.lit(0)).alias("before"), F.sum("n_lines").over(every).alias("total"),
        (~(plain & beyond.isin(-1, 2))).alias("ended"), (plain & beyond.isin(2, 3)).alias("marked"),
    )


def split_lines(spark: SparkSession, path: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(file, line, text) of every line of the files at a path, numbered from 1; the rows that source_lines gives for whole files.

    CR LF and LF end a line; a CR that no LF follows stays, and so does a byte order mark.  Empty files, and such as hold a mark alone, have no lines.  Files are read twice, the first time for
    lengths only; both times a split's rows come in one task and in their order, and a line outside its split's range ends the query with an error.
    """
    raw = raw_lines(spark, path)
    splits = saved(line_splits(raw))
    if splits.count() <= most_broadcast:
        splits = F.broadcast(splits)
    rows = raw.join(splits, ["file", "start"])
    place = F.col("at") - F.col("first_at")
    place = F.when((place >= 0) & (place < F.col("n_lines")), place).otherwise(F.raise_error(F.lit("a split's lines were dealt out differently when they were read again")).cast("long"))
    line = (F.col("before") + place + 1).cast("int")
    open_end = ~F.col("ended") & (F.col("before") + place + 1 == F.col("total"))
    text = F.when(open_end, F.col("raw")).otherwise(F.regexp_replace("raw", "\r\\z", ""))
    text = F.when(F.col("marked") & (line == 1), F.concat(F.lit("\ufeff"), text)).otherwise(text)
    return rows.select("file", line.alias("line"), text.alias("text"))


def file_endings(spark: SparkSession, path: str) -> DataFrame:
    """(file, ending): what stands behind the last line of each file that has lines: CR LF, LF or nothing."""
    raw = raw_lines(spark, path)
    splits = line_splits(raw)
    last = raw.groupBy("file").agg(F.max_by(F.right("raw", F.lit(1)), F.struct("start", "at")).alias("end"))
    rows = splits.select("file", "ended").distinct().join(last, "file")
    return rows.select("file", F.when(~F.col("ended"), "").when(F.col("end") == "\r", "\r\n").otherwise("\n").alias("ending"))
