"""Exact duplicates by an extendible-hash index on shared files (operator 2).

1. Every text gets a 64-bit key.  Keys that one row alone has are done.
2. The directory grows from the counts of key prefixes: while a bucket holds
   more rows than its capacity it is split by one more bit and the directory
   doubles; a bucket of a single key cannot be split and chains.
3. Entries are texts with the rows that hold them, as their number and largest
   id.  Equal texts of a task are folded first, so a text that a third of all rows
   hold is a few entries of a task.  Those whose key occurs again are written to the
   shared folder, a folder of files for each directory bucket.
4. Owner tasks each read a key range of buckets, chain the entries of a key and
   compare bytes: a place in the chain is a group, so texts that merely share a key
   stay apart.  Rows find their group by key, and by key and text where a chain
   has several places.  SHA-256 is an output only and decides nothing.

Results for odd input: a null text counts as empty, and all empty texts are
equal; rows without an id are left out; every row counts, so of repeated rows with the
largest id each is kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redraft.llm import textblocks as tb
from redraft.llm.components import Tables

#: Rows that a bucket of the directory may hold before it is split.
BUCKET_ENTRIES = 20_000
#: Bits of the key that the directory may use; a bucket that is still overfull then chains.
MOST_BITS = 20
#: Bytes of text that a task folds at a time.
FOLD_BYTES = 64 << 20
#: Groups with more than one of so many of all rows go to every task, as there are no more of them than this; the others are joined by key.
MOST_HOT = 1000


def directory(counts: DataFrame, capacity: int = BUCKET_ENTRIES, most_bits: int = MOST_BITS) -> list[tuple[int, int]]:
    """The (depth, prefix) of every bucket, from rows (prefix of most_bits bits, entries, keys).

    Only overfull buckets are split, so the list is about entries / capacity long.
    Each round asks Spark for the counts of the halves of overfull buckets alone.
    """
    spark, done = counts.sparkSession, []
    overfull = [(0, 0)]
    while overfull:
        depth = overfull[0][0]
        at = spark.createDataFrame([(p,) for _, p in overfull], "at long")
        here = counts.groupBy(F.shiftright("prefix", most_bits - depth).alias("at")).agg(F.sum("entries").alias("entries"), F.sum("keys").alias("keys"))
        sizes = {r["at"]: (r["entries"], r["keys"]) for r in here.join(F.broadcast(at), "at", "left_semi").collect()}
        over = []
        for _, p in overfull:
            entries, keys = sizes.get(p, (0, 0))
            if entries > capacity and keys > 1 and depth < most_bits:
                over += [(depth + 1, 2 * p), (depth + 1, 2 * p + 1)]
            else:
                done.append((depth, p))
        overfull = over
    return done


def slots_of(buckets: list[tuple[int, int]]) -> tuple[int, np.ndarray]:
    """The directory: its global depth, and the number of the bucket in each of its slots."""
    depth = max(d for d, _ in buckets)
    slots = np.zeros(1 << depth, np.int32)
    for number, (d, p) in enumerate(sorted(buckets, key=lambda b: b[1] << (depth - b[0]))):
        slots[p << (depth - d) : (p + 1) << (depth - d)] = number
    return depth, slots


def fold_batches(batches: Iterable[pa.RecordBatch], depth: int, slots: np.ndarray, most: int = FOLD_BYTES) -> Iterator[pa.RecordBatch]:
    """Entries (bucket, key, text, keep_id, n) of rows (doc_id, key, text): equal texts of a task once for every `most` bytes."""
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    seen: dict[tuple[int, str], list[int]] = {}
    size = 0

    def entries() -> pa.RecordBatch:
        keys = np.array([k for k, _ in seen], np.int64)
        bucket = slots[(keys.view(np.uint64) >> np.uint64(64 - depth)).astype(np.int64)] if depth else np.zeros(len(keys), np.int32)
        columns = [bucket, keys, [t for _, t in seen], [v[0] for v in seen.values()], [v[1] for v in seen.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "key", "text", "keep_id", "n"])

    for batch in batches:
        for doc, key, text in zip(batch["doc_id"].to_pylist(), batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
            own = seen.get((key, text))
            if own is None:
                seen[key, text] = [doc, 1]
                size += len(text) + 100
            else:
                own[0], own[1] = max(own[0], doc), own[1] + 1
            if size > most:
                yield entries()
                seen.clear()
                size = 0
    if seen:
        yield entries()


def chain(groups: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries (key, text, keep_id, n) sorted by key, the groups: each place of a key's chain, found by comparing bytes, with the places of the chain, the largest id, the rows, and the text where there are several places."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

    def links(key: int | None, own: list[list]) -> list[tuple]:
        return [(key, len(own), keep, n, text if len(own) > 1 else None) for text, keep, n in own]

    key, own = None, []
    for batch in groups:
        rows = []
        for k, text, keep, n in zip(*(batch[c].to_pylist() for c in ("key", "text", "keep_id", "n")), strict=True):
            if k != key:
                rows += links(key, own)
                key, own = k, []
            for link in own:
                if link[0] == text:
                    link[1], link[2] = max(link[1], keep), link[2] + n
                    break
            else:
                own.append([text, keep, n])
        yield _groups(rows, kinds)
    yield _groups(links(key, own), kinds)


def _groups(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "places", "keep_id", "group_size", "text"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id (largest doc_id with the same text), group_size, kept, text_sha256."""
    spark = docs.sparkSession
    tb.small_batches(spark)
    tables = Tables(spark, "exact-dedup")
    rows = tb.keyed(docs, id_col, text_col).select("doc_id", "text", key_of(F.col("text")).cast("long").alias("key"))
    keys = tables.saved(rows.select("doc_id", "key", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("sha")))
    many = tables.saved(keys.groupBy("key").agg(F.count("*").alias("entries")).where("entries > 1"))
    prefix = F.shiftrightunsigned("key", 64 - MOST_BITS).cast("int")
    counts = tables.saved(many.groupBy(prefix.alias("prefix")).agg(F.sum("entries").alias("entries"), F.count("*").alias("keys")))
    buckets = directory(counts)
    depth, slots = slots_of(buckets)

    # the index: entries whose key occurs again, in a folder for each bucket
    table = spark.sparkContext.broadcast(slots)
    folded = rows.select("doc_id", "key", "text").mapInArrow(lambda it: fold_batches(it, depth, table.value), "bucket int, key long, text string, keep_id long, n long")
    owners = max(len(buckets), int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = f"{tables.folder}/index"
    folded.join(many.select("key"), "key", "left_semi").repartition(owners, "bucket", "key").write.partitionBy("bucket").parquet(folder)
    table.destroy()
    index = spark.read.schema("key long, text string, keep_id long, n long, bucket int").parquet(folder)
    owned = index.repartition(owners, "bucket", "key").sortWithinPartitions("key")
    groups = tables.saved(owned.select("key", "text", "keep_id", "n").mapInArrow(chain, "key long, places int, keep_id long, group_size long, text string"))

    alone, shared = groups.where("places = 1").select("key", "keep_id", "group_size"), groups.where("places > 1")
    hot_size = max(keys.count() // MOST_HOT, 1)
    hot = alone.where(f"group_size > {hot_size}").select("key", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    found = keys.join(F.broadcast(hot), "key", "left")
    # rows that have their group are spread by their id, so that no task gets all rows of a hot text
    is_hot = F.col("hot_id").isNotNull()
    found = found.withColumn("place", F.struct(is_hot.alias("hot"), F.when(is_hot, F.xxhash64("doc_id")).otherwise(F.col("key")).alias("key")))
    found = found.join(alone.select(F.struct(F.lit(False).alias("hot"), "key").alias("place"), "keep_id", "group_size"), "place", "left")
    found = found.select("doc_id", "key", "sha", F.coalesce("hot_id", "keep_id").alias("keep_id"), F.coalesce("hot_size", "group_size").alias("group_size"))
    if not shared.isEmpty():  # keys of several texts: their rows are matched by the text
        told = rows.join(shared, ["key", "text"]).select("doc_id", "key", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("sha"), "keep_id", "group_size")
        found = found.join(shared.select("key").distinct(), "key", "left_anti").unionByName(told)
    keep = F.coalesce("keep_id", "doc_id")
    return tables.last(found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (keep == F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")))
