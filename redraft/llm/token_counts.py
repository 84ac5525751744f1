"""Exact histogram of document lengths in tokens, and what it answers (operator 8).

Documents are aggregated by encoded length, so all that follows works on one row
per distinct length.  Suffix sums over the lengths answer, for every context
limit, how many tokens stay when longer documents are cut to it.

Results for odd input: a null or empty text has length 0; rows count one by one,
repeated rows and null ids too; an empty table gives an empty histogram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redraft.llm import bpe
from redraft.llm.components import saved

#: Lengths in one run of the two-level sums; no window holds more rows than this, or than there are runs.
RUN = 64


def lengths(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens): the encoded length of every row."""
    import public_tokenizers

    path, pattern = path or bpe.default_path(), public_tokenizers.PATTERN
    docs = bpe.documents(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in bpe.encode_batches(batches, path, pattern, False):
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "n_tokens": pa.array(np.diff(b["ids"].offsets.to_numpy()).astype(np.int64))})

    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long")


def histogram(counts: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(length, n_docs) for every length that occurs; rows without a length are left out."""
    return counts.groupBy(F.col(length_col).cast("long").alias("length")).agg(F.count("*").alias("n_docs")).where("length is not null")


def summaries(hist: DataFrame) -> DataFrame:
    """One row per length L of a histogram, read as a context limit:

    docs_within and tokens_within count documents of at most L tokens and their tokens; docs_longer those above;
    truncated_tokens is the total of min(length, L); docs_total and tokens_total are the whole; quantile is the share of documents of at most L tokens.
    """
    hist = saved(hist.select("length", "n_docs"))  # a row per length: kept, as it is read three times and its making is the whole cost
    rows = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / RUN).alias("run"))
    by_run = rows.groupBy("run").agg(F.sum("n_docs").alias("run_docs"), F.sum("n_tokens").alias("run_tokens"))
    after = Window.orderBy(F.col("run").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_run = by_run.select(
        "run",
        F.coalesce(F.sum("run_docs").over(after), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("run_tokens").over(after), F.lit(0)).alias("later_tokens"),
        F.sum("run_docs").over(every).alias("docs_total"),
        F.sum("run_tokens").over(every).alias("tokens_total"),
    )
    above = Window.partitionBy("run").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = rows.join(by_run, "run").select(
        "length",
        "n_docs",
        "docs_total",
        "tokens_total",
        (F.col("later_docs") + F.coalesce(F.sum("n_docs").over(above), F.lit(0))).alias("docs_longer"),
        (F.col("later_tokens") + F.coalesce(F.sum("n_tokens").over(above), F.lit(0))).alias("tokens_longer"),
    )
    return longer.select(
        "length",
        "n_docs",
        (F.col("docs_total") - F.col("docs_longer")).alias("docs_within"),
        (F.col("tokens_total") - F.col("tokens_longer")).alias("tokens_within"),
        "docs_longer",
        (F.col("tokens_total") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("truncated_tokens"),
        "docs_total",
        "tokens_total",
        ((F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")).alias("quantile"),
    )


def truncated_totals(hist: DataFrame, limits: DataFrame, limit_col: str = "limit") -> DataFrame:
    """(limit, truncated_tokens, docs_longer) for any context limits, also between the lengths of the histogram."""
    have = summaries(hist).select("length", F.struct("length", "tokens_within", "docs_longer", "docs_total").alias("at"))
    asked = limits.select(F.col(limit_col).cast("long").alias("limit")).where("limit is not null").distinct()
    # one ordered pass over limits and lengths together: the last length at or below each limit, run by run
    both = have.select(F.col("length").alias("x"), "at", F.lit(None).cast("long").alias("limit")).unionByName(asked.select(F.col("limit").alias("x"), F.lit(None).cast("struct<length:bigint,tokens_within:bigint,docs_longer:bigint,docs_total:bigint>").alias("at"), "limit"))
    both = both.withColumn("run", F.floor(F.col("x") / RUN))
    ends = both.groupBy("run").agg(F.max("at").alias("run_at"))
    ends = ends.select("run", F.last("run_at", ignorenulls=True).over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    found = both.join(ends, "run").withColumn("last", F.coalesce(F.last("at", ignorenulls=True).over(Window.partitionBy("run").orderBy("x", F.col("at").isNull()).rowsBetween(Window.unboundedPreceding, 0)), "before"))
    total = hist.agg(F.sum("n_docs").alias("docs"))
    return found.where("limit is not null").crossJoin(F.broadcast(total)).select("limit", (F.coalesce(F.col("last.tokens_within"), F.lit(0)) + F.col("limit") * F.coalesce(F.col("last.docs_longer"), F.col("docs"), F.lit(0))).alias("truncated_tokens"), F.coalesce(F.col("last.docs_longer"), F.col("docs"), F.lit(0)).alias("docs_longer"))
