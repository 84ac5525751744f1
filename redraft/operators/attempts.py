"""Attempts at a model with delayed retries, as a table that says at any time what is due.

Every attempt is a row that is only ever appended; how a file stands follows from the rows of its last chunk, so a run that is
broken off goes on from its table.  An empty answer is asked for once more after two seconds; a timeout, of a file with more than one request, once
more after ten; a failure stops its file.  Delays are times in the table, not sleeping tasks: a round sends what is due of all files, at most `at_once` at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redraft.operators.graph import Store
from redraft.operators.requests import turns

#: Seconds before another attempt after an empty answer and after a timeout (fixed values).
AFTER_EMPTY, AFTER_TIMEOUT = 2, 10
#: Answers of at most so many characters are empty (fixed value).
EMPTY_CHARS = 1
ATTEMPTS = "file string, chunk int, attempt int, outcome string, started timestamp, ended timestamp, answer string, error string"
#: What a prompt ends with when an empty answer is asked for again.
AGAIN = "An earlier answer was empty and may have left changes half done: read the file as it is now, go through all that is asked, and make what is missing."


def standing(chunks: DataFrame, attempts: DataFrame) -> DataFrame:
    """(file, state, chunk, attempt, turns, due, reason): how each file of chunks (file, chunk, n, tests) stands after attempts (of ATTEMPTS, answer and error not needed).

    state: due (chunk is to be sent for the attempt-th time, not before due; null is at once), stopped, or done.  reason: first, next, empty or timeout for
    those due; of the others the last outcome.  Outcomes are ok, empty, failed, timeout and error; what an attempt after a timeout says is taken even if it failed.
    """
    sizes = chunks.groupBy("file").agg(F.sum("n").alias("requests"), F.min("chunk").alias("first_chunk"))
    of = F.struct("attempt", "outcome", "ended")
    each = attempts.groupBy("file", "chunk").agg(F.max(of).alias("last"), F.count("*").alias("tries"), F.count_if(F.col("outcome") == "timeout").alias("timeouts"))
    told = each.groupBy("file").agg(F.max_by(F.struct(F.col("chunk").alias("at"), "last", "tries", "timeouts"), "chunk").alias("t")).select("file", "t.*")
    rows = sizes.join(told, "file", "left")
    outcome, many = F.col("last.outcome"), F.col("requests") > 1
    move = (
        F.when(outcome.isNull(), "first")
        .when((outcome == "empty") & (F.col("tries") == 1), "empty")
        .when((outcome == "timeout") & many & (F.col("timeouts") == 1), "timeout")
        .when(outcome.isin("ok", "empty") | (outcome == "failed") & (F.col("timeouts") > 0), "next")
    )
    rows = rows.withColumn("move", move)
    later = chunks.select("file", F.col("chunk").alias("later")).join(rows.where("move = 'next'").select("file", "at"), "file").where("later > at").groupBy("file").agg(F.min("later").alias("later"))
    rows = rows.join(later, "file", "left")
    state = F.when(F.col("move").isNull(), "stopped").when((F.col("move") == "next") & F.col("later").isNull(), "done").otherwise("due")
    rows = rows.withColumn("state", state).withColumn("chunk", F.when(F.col("move") == "first", F.col("first_chunk")).when(F.col("move") == "next", F.coalesce("later", "at")).otherwise(F.col("at")))
    is_due, again = F.col("state") == "due", F.col("move").isin("empty", "timeout")
    wait = F.when(F.col("move") == "empty", AFTER_EMPTY).when(F.col("move") == "timeout", AFTER_TIMEOUT)
    rows = rows.join(chunks.select("file", "chunk", "n", "tests"), ["file", "chunk"], "left")
    most = turns(F.col("n"), F.col("tests"), F.col("requests") == 1)
    return rows.select(
        "file", "state", "chunk", F.when(is_due, F.when(again, F.col("last.attempt") + 1).otherwise(F.lit(1))).cast("int").alias("attempt"), F.when(is_due, most).cast("int").alias("turns"),
        F.when(is_due, F.timestamp_add("SECOND", F.coalesce(wait, F.lit(0)), F.when(again, F.col("last.ended").cast("timestamp")))).alias("due"), F.when(is_due, F.col("move")).otherwise(outcome).alias("reason"),
    )


def send(due: DataFrame, client: Callable[[str, str, int], str | tuple[bool, str]], clock: Callable[[], float], at_once: int = 3) -> DataFrame:
    """ATTEMPTS of the rows (file, chunk, attempt, turns, prompt): one call of the client (file, prompt, turns) each, which returns a text, or whether it succeeded and a text."""

    def ask(batches):
        for rows in batches:
            out = []
            for file, chunk, attempt, most, prompt in rows[["file", "chunk", "attempt", "turns", "prompt"]].itertuples(index=False):
                began, answer, error = clock(), "", None
                try:
                    found = client(file, prompt, most)
                    good, answer = found if isinstance(found, tuple) else (True, found)
                    outcome = "empty" if len(answer) <= EMPTY_CHARS else "ok" if good else "failed"
                except TimeoutError as e:
                    outcome, error = "timeout", str(e)
                except Exception as e:  # a client of whatever kind: its failure is a row, not the end of the run
                    outcome, error = "error", str(e)
                out.append((file, chunk, attempt, outcome, _moment(began), _moment(clock()), answer, error))
            yield pd.DataFrame(out, columns=["file", "chunk", "attempt", "outcome", "started", "ended", "answer", "error"])

    return due.repartition(at_once, "file").mapInPandas(ask, ATTEMPTS)


def _moment(seconds: float) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=seconds)


def run(chunks: DataFrame, client: Callable[[str, str, int], str | tuple[bool, str]], at_once: int = 3, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep, before: DataFrame | None = None) -> DataFrame:
    """All ATTEMPTS at chunks (file, chunk, n, tests, prompt) until every file is done or stopped; before holds those of an earlier run, which are not made again.

    A prompt tells what the file's earlier chunks answered.  Each round sends what is due, of each file one chunk, and appends a table in the shared folder; the driver sees
    only how much is due and when.  clock and sleep can be others for tests.
    """
    spark = chunks.sparkSession
    store = Store(spark)
    chunks = store.put("chunks", chunks.select("file", "chunk", "n", "tests", "prompt"))
    empty = spark.createDataFrame([], ATTEMPTS)
    made = store.put("made", empty if before is None else before.select(*empty.columns))
    while True:
        stand = store.put("standing", standing(chunks, made).where("state = 'due'"))
        open_, first = stand.agg(F.count("*"), F.min(F.coalesce("due", F.timestamp_seconds(F.lit(0))).cast("double"))).first()
        if not open_:
            return store.last(made)
        if first > clock():
            sleep(first - clock())
        now = stand.where(F.coalesce(F.col("due").cast("double"), F.lit(0.0)) <= clock())
        told = made.where("outcome in ('ok', 'failed')").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("chunk", "attempt", F.trim("answer").alias("answer")))).alias("told"))
        earlier = F.transform(F.filter("told", lambda x: x["chunk"] < F.col("chunk")), lambda x: x["answer"])
        asked = now.join(chunks.select("file", "chunk", "prompt"), ["file", "chunk"]).join(told, "file", "left")
        done = F.when(F.size(earlier) > 0, F.concat(F.lit("\n\nDone before:\n"), F.array_join(earlier, "\n")))
        prompt = F.concat(F.col("prompt"), F.coalesce(done, F.lit("")), F.when(F.col("reason") == "empty", "\n\n" + AGAIN).otherwise(""))
        sent = store.put("sent", send(asked.select("file", "chunk", "attempt", "turns", prompt.alias("prompt")), client, clock, at_once))
        made = store.put("made", made.unionByName(sent))
