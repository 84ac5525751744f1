"""Requests to a model: gather, order, cut into chunks, word, and read the answers.  The client itself is plugged in; the one given here is offline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redraft.functions.text import without_escapes

#: Soft limit of requests in a chunk, and of families.
CHUNK_SIZE, CHUNK_FAMILIES = 8, 2


def merged_by_rule(requests: DataFrame) -> DataFrame:
    """One row per file and rule: lines and snippets in order, message and labels of the first."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "line", _optional(requests, "code_snip", "string").alias("snip"))))
    snippets = F.filter(F.transform(rows, lambda x: x["snip"]), lambda x: x.isNotNull())
    return requests.groupBy("file", "rule_id").agg(F.min("seq").alias("seq"), F.transform(rows, lambda x: x["line"]).alias("lines"), snippets.alias("snippets"), F.min_by("message", "seq").alias("message"), F.min_by("labels", "seq").alias("labels"), F.count("*").alias("n"))


def ordered(requests: DataFrame) -> DataFrame:
    """Adds place: within a file, requests with a family first, by family, priority and order of arrival."""
    order = Window.partitionBy("file").orderBy(F.col("family").isNull(), "family", "priority", "seq")
    return requests.withColumn("place", F.row_number().over(order))


def chunks(requests: DataFrame, size: int = CHUNK_SIZE, families: int = CHUNK_FAMILIES) -> DataFrame:
    """Adds chunk (from 0) to ordered requests.

    A request of the chunk's current family stays with it, whatever the size; a new family starts a chunk when the chunk has `families` families or `size` requests; one without a family when it has `size`.
    """

    def cut(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, held, seen, last = 0, 0, set(), None
        for part in rows:
            part = part.sort_values("place", kind="stable")
            out = []
            for fam in part["family"]:
                fam = None if pd.isna(fam) else fam
                if fam is None:
                    full = held >= size
                else:
                    full = fam not in seen and (len(seen) >= families or held >= size)
                if full and held:
                    chunk, held, seen = chunk + 1, 0, set()
                held += 1
                if fam is not None:
                    seen.add(fam)
                out.append(chunk)
            yield part.assign(chunk=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", chunk int"
    return requests.groupBy("file").applyInPandas(lambda pdf: next(cut(iter([pdf]))), schema)


#: Labels of requests for tests, and labels and texts of requests that tell of types only: one of each makes one (fixed values).
TEST_LABELS = ("change-type=test-fix", "impact=frontend-testing")
NOISE_LABELS, NOISE_TEXTS = ("change-type=signature-changed", "change-type=type-changed"), ("base class changed", "RefAttributes")


def _optional(requests: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in requests.columns else F.lit(None).cast(kind)


def consolidated(requests: DataFrame) -> DataFrame:
    """One row per file and family: least line, distinct messages, snippets and labels in order of arrival, sorted companion tests, number of requests, rule and place of the first.

    Requests that tell of types only go, unless all of a family do; their companion tests and their place in the count stay.  Requests without a family stay as they are.
    """
    own = requests.withColumn("key", F.coalesce(F.concat(F.lit("family:"), F.col("family")), F.concat(F.lit("rule:"), F.col("rule_id"), F.lit(":"), F.col("seq").cast("string"))))
    labels = _optional(requests, "labels", "array<string>")
    typed = F.coalesce(F.arrays_overlap(labels, F.array(*[F.lit(x) for x in NOISE_LABELS])), F.lit(False))
    noise = F.coalesce(typed & (F.contains("message", F.lit(NOISE_TEXTS[0])) | F.contains("message", F.lit(NOISE_TEXTS[1]))), F.lit(False))
    rows = own.select("file", "key", F.struct("seq", "line", "message", "rule_id", noise.alias("noise"), _optional(requests, "code_snip", "string").alias("snip"), labels.alias("labels"), _optional(requests, "companion_tests", "array<string>").alias("tests")).alias("r"))
    every = rows.groupBy("file", "key").agg(F.array_sort(F.collect_list("r")).alias("all"), F.count("*").alias("n"))
    kept = F.filter("all", lambda x: ~x["noise"])
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.col("all"))
    none = F.array().cast("array<string>")
    distinct = lambda of, name: F.array_distinct(F.flatten(F.transform(of, lambda x: F.coalesce(x[name], none))))
    return every.withColumn("kept", kept).select(
        "file", "key", F.array_min(F.transform("kept", lambda x: x["line"])).alias("line"), F.array_join(F.array_distinct(F.transform("kept", lambda x: x["message"])), "\n").alias("message"), "n", F.col("all")[0]["rule_id"].alias("rule_id"), F.col("all")[0]["seq"].alias("seq"),
        F.array_distinct(F.filter(F.transform("kept", lambda x: x["snip"]), lambda x: x.isNotNull())).alias("snippets"), distinct("kept", "labels").alias("labels"), F.array_sort(distinct("all", "tests")).alias("companion_tests"),
    )


def test_requests(requests: DataFrame) -> DataFrame:
    """One request for each companion test file, after the first request that names it, with the labels of such requests."""
    rows = requests.select("rule_id", "seq", F.explode("companion_tests").alias("file"))
    found = rows.groupBy("file").agg(F.min_by(F.concat(F.lit("test-fix:"), F.col("rule_id")), F.struct("seq", "rule_id")).alias("rule_id"), F.lit(1).alias("line"))
    return found.withColumn("labels", F.array(*[F.lit(x) for x in TEST_LABELS]))


def with_test_requests(requests: DataFrame) -> DataFrame:
    """Requests (file, rule_id, line, seq, message, labels, companion_tests, …) and behind them those for the tests of requests that touch tests only."""
    asks = requests.where(F.array_contains("labels", "change-type=test-impact"))
    first = asks.select("seq", F.explode("companion_tests").alias("file")).groupBy("file").agg(F.min("seq").alias("seq"))
    tests = test_requests(asks).join(first, "file").withColumn("message", F.lit("Bring this test in line with the change of the file that it tests."))
    return requests.unionByName(tests, allowMissingColumns=True)


def prompts(chunked: DataFrame) -> DataFrame:
    """(file, chunk, prompt): what a model is asked for each chunk."""
    item = F.concat(F.lit("- line "), F.col("line").cast("string"), F.lit(": ["), F.col("rule_id"), F.lit("] "), F.col("message"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("t")))), lambda x: x["t"])
    return chunked.groupBy("file", "chunk").agg(F.concat(F.lit("Change the file "), F.col("file"), F.lit(" as asked for below. Change nothing else.\n"), F.array_join(items, "\n")).alias("prompt"))


#: Most turns of a request, of one with tests, and of a chunk of n requests: the least of start + n and the most (fixed values).
TURNS, TURNS_WITH_TESTS = (5, 15)
CHUNK_TURNS, CHUNK_TURNS_WITH_TESTS = (22, 40), (30, 50)


def turns(n: Column, tests: Column, single: Column | None = None) -> Column:
    """How many turns a model may take for a chunk of n requests; single says that its file has no other request (by default that n is 1)."""
    single = n == 1 if single is None else single
    of = lambda start, most: F.least(n + start, F.lit(most))
    return F.when(single, F.when(tests, TURNS_WITH_TESTS).otherwise(TURNS)).otherwise(F.when(tests, of(*CHUNK_TURNS_WITH_TESTS)).otherwise(of(*CHUNK_TURNS))).cast("int")


def answers(asked: DataFrame, client: Callable[[str, str], str] | None = None, at_once: int = 3, tries: int = 2) -> DataFrame:
    """(file, chunk, answer, ok, tries, error) from a client (file, prompt) -> text, at most `at_once` files at a time.

    A file's chunks go in order; each prompt tells what the answers before it said; an empty answer or a TimeoutError is tried again, and a chunk that fails
    stops its file: later ones are not sent.  Without a client nothing is sent and nothing is ok.
    """

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, told, stopped = [], [], client is None
        for file, chunk, prompt in pdf.sort_values("chunk")[["file", "chunk", "prompt"]].itertuples(index=False):
            answer, error, n = "", None, 0
            while not stopped and n < tries and not answer.strip():
                n += 1
                try:
                    answer, error = client(file, "\n\n".join([prompt, *(["Done before:\n" + "\n".join(told)] if told else [])])), None
                except TimeoutError as e:
                    error = f"timeout: {e}"
                except Exception as e:  # a client of whatever kind: its failure is a row, not the end of the run
                    error = str(e)
                    break
            ok = bool(answer.strip())
            if not stopped and not ok:
                error, stopped = error or "empty answer", True
            told += [answer.strip()] if ok else []
            rows.append((file, chunk, answer, ok, n, error))
        return pd.DataFrame(rows, columns=["file", "chunk", "answer", "ok", "tries", "error"])

    return asked.repartition(at_once, "file").groupBy("file").applyInPandas(ask, "file string, chunk int, answer string, ok boolean, tries int, error string")


def answer_counts(answered: DataFrame) -> DataFrame:
    """One row: files whose chunks are all ok, files that failed, and those that timed out."""
    by_file = answered.groupBy("file").agg(F.min("ok").alias("ok"), F.coalesce(F.max(F.col("error").startswith("timeout")), F.lit(False)).alias("late"))
    return by_file.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.count_if("late").alias("timed_out"))


def answer_log(answered: DataFrame) -> DataFrame:
    """(file, text): the log of each file as JSON, its chunks in order and their totals; write it partitioned by run."""
    chunk = F.struct("chunk", "ok", "tries", F.length("answer").alias("characters"), "error")
    every = answered.groupBy("file").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"), F.count("*").alias("n_chunks"), F.count_if("ok").alias("n_ok"), F.sum("tries").alias("n_tries"))
    return every.select("file", F.to_json(F.struct("file", "chunks", "n_chunks", "n_ok", "n_tries")).alias("text"))


def last_answer(messages: DataFrame) -> DataFrame:
    """(conv_id, text): of each conversation the last assistant message with a text."""
    own = (F.col("role") == "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    return messages.where(own).groupBy("conv_id").agg(F.max_by("text", F.struct("turn", "text")).alias("text"))


def fix_blocks(lines: DataFrame) -> DataFrame:
    """(file, block, at_line, old_text, new_text) of answers given as lines: within fenced fix blocks LINE, OLD and NEW lines; a NEW line closes an edit and clears its number.

    Windows carry the fence, the number and the old text forward, in place of a state machine.
    """
    text, before = F.col("text"), Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fence = text.rlike(r"^\s*```")
    opened = F.sum(fence.cast("int")).over(before)
    starts = F.last(F.when(fence, F.regexp_extract(text, r"^\s*```\s*(\w*)", 1)), ignorenulls=True).over(before)
    rows = lines.select("*", opened.alias("fences"), starts.alias("tag")).where((F.col("fences") % 2 == 1) & (F.col("tag") == "fix"))
    kind = F.regexp_extract(F.trim(F.col("text")), r"^(LINE|OLD|NEW):", 1)
    value = F.regexp_replace(F.regexp_extract(F.col("text"), r"(?s)^\s*(?:LINE|OLD|NEW): ?(.*)$", 1), r"\s+$", "")
    rows = rows.select("file", "line", "fences", kind.alias("kind"), value.alias("value")).where("kind <> ''")
    own = Window.partitionBy("file", "fences").orderBy("line")
    edit = F.coalesce(F.sum((F.col("kind") == "NEW").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = rows.withColumn("edit", edit).groupBy("file", "fences", "edit").agg(
        F.max_by(F.when(F.col("kind") == "LINE", F.col("value")), F.when(F.col("kind") == "LINE", F.col("line"))).alias("number"),
        F.max_by(F.when(F.col("kind") == "OLD", F.col("value")), F.when(F.col("kind") == "OLD", F.col("line"))).alias("old_text"),
        F.max(F.when(F.col("kind") == "NEW", F.col("value"))).alias("new_text"),
    )
    number = F.try_to_number(F.nullif(F.regexp_extract(F.coalesce("number", F.lit("")), r"^\s*([0-9]{1,9})\s*$", 1), F.lit("")), F.lit("9" * 9)).cast("int")
    return cut.select("file", F.expr("cast((fences + 1) / 2 as int)").alias("block"), number.alias("at_line"), "old_text", "new_text").where("at_line is not null and old_text is not null and new_text is not null")


#: Source and confidence of edits that a model's answer makes (fixed values).
MODEL_SOURCE, MODEL_CONFIDENCE = "llm", "medium"


def line_digests(lines: DataFrame) -> DataFrame:
    """(file, line, digest): what a request remembers of the lines (file, line, text) that it shows to a model."""
    return lines.select("file", "line", F.xxhash64("text").alias("digest"))


def answer_edits(blocks: DataFrame, seen: DataFrame, lines: DataFrame) -> DataFrame:
    """Edits of a model's fix blocks (of fix_blocks, with rule_id), each checked against the line as the model saw it, seen (file, line, digest), and as it is now.

    (file, line, seq, old_text, new_text, rule_id, replace_all, source, confidence, outcome): outcome is planned; stale if the line has changed since; line_out_of_bounds if there is none or the model
    was shown none; text_not_found_on_line if it does not hold the old text.  Of edits that say the same of a line the first is planned, the others are repeated.
    """
    order = Window.partitionBy("file").orderBy("block", "at_line", "old_text", "new_text")
    rows = blocks.select("file", "block", F.col("at_line").alias("line"), "old_text", "new_text", "rule_id", F.row_number().over(order).alias("seq"))
    now = line_digests(lines).select("file", "line", F.col("digest").alias("now"))
    met = rows.join(seen.select("file", "line", "digest"), ["file", "line"], "left").join(now, ["file", "line"], "left").join(lines.select("file", "line", "text"), ["file", "line"], "left")
    again = F.row_number().over(Window.partitionBy("file", "line", "old_text", "new_text").orderBy("seq")) > 1
    outcome = F.when(F.col("now").isNull() | F.col("digest").isNull(), "line_out_of_bounds").when(F.col("now") != F.col("digest"), "stale").when((F.col("old_text") == "") | ~F.contains("text", "old_text"), "text_not_found_on_line").when(again, "repeated").otherwise("planned")
    return met.select("file", "line", "seq", "old_text", "new_text", "rule_id", F.lit(False).alias("replace_all"), F.lit(MODEL_SOURCE).alias("source"), F.lit(MODEL_CONFIDENCE).alias("confidence"), outcome.alias("outcome"))


#: How a package manager words that a peer is missing (fixed values): code, what stands between who lacks it and the peer, and before who asks for it.
PEER_CODE, PEER_LACKS, PEER_ASKED = "YN0002:", " doesn't provide ", "requested by "


def _package(word: Column) -> Column:
    """Name of a package from name@range; a scope keeps its at sign."""
    return F.when(word.startswith("@"), F.concat(F.lit("@"), F.substring_index(F.substring(word, 2, 1 << 20), "@", 1))).otherwise(F.substring_index(word, "@", 1))


def missing_peers(log: DataFrame) -> DataFrame:
    """(peer, requested_by) of a package manager's log given as (file, line, text): first mention of each peer; without a requester it is who lacks the peer."""
    # a step for each text that is used more than once, and no filter before rows meet: it would be moved before all steps, with every use made anew
    said = log.select("file", "line", without_escapes(F.col("text")).alias("text"))
    told = F.when(F.contains("text", F.lit(PEER_CODE)) & F.contains("text", F.lit(PEER_LACKS)), F.expr(f"substring(text, locate('{PEER_CODE}', text) + {len(PEER_CODE)}, {1 << 20})"))
    first_word = lambda c: F.substring_index(F.ltrim(c), " ", 1)
    sides = said.select("file", "line", F.split(told, PEER_LACKS, 2).alias("sides"))
    words = sides.select("file", "line", first_word(F.translate(F.col("sides")[0], "│", " ")).alias("who"), F.get("sides", 1).alias("rest"))
    named = words.select("file", "line", "who", F.substring_index(first_word(F.col("rest")), "(", 1).alias("peer"), F.when(F.contains("rest", F.lit(PEER_ASKED)), F.regexp_replace(first_word(F.substring("rest", F.locate(PEER_ASKED, F.col("rest")) + len(PEER_ASKED), 1 << 20)), r"\.$", "")).alias("by"))
    asked, lacks = _package(F.col("by")), _package(F.col("who"))
    found = named.select("file", "line", "peer", F.coalesce(F.nullif(asked, F.lit("")), F.nullif(lacks, F.lit(""))).alias("requested_by"))
    counts = (F.col("peer") != "") & F.col("requested_by").isNotNull()
    return found.groupBy("peer").agg(F.min_by("requested_by", F.when(counts, F.struct("file", "line"))).alias("requested_by")).where("requested_by is not null")
