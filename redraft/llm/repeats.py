"""Repeated passages by prefix-free parsing and suffix order (operator 4).

Removes each byte that a string of `length` bytes covers which also starts in a
document with a smaller id.

1. Parse.  In every window of `length` bytes the leftmost minimal rolling hash of
   TRIGGER bytes is the window's trigger.  Neighbouring windows with equal triggers
   make a *phrase*, the text that they cover; a run of small period, where every window
   has the same trigger at another place, is one phrase too, cut after RUN windows.
   Equal strings have equal triggers, so equal windows meet under one trigger, and a
   long repeat is a repeat of whole phrases, however often it is copied.
2. Dictionary.  Key ranges of triggers get the phrases of the parse as hashes.
   Of equal phrases only the one in the smallest document stays in the
   dictionary; the others are removed whole.  Phrases that alone have their
   trigger are done.
3. Suffixes.  The text of the dictionary phrases that are left goes to the key
   range of the trigger, where the suffixes of the dictionary are sorted; equal
   neighbours in that order, compared byte by byte, give each suffix the
   smallest document of the corpus in which it starts.
4. What is removed returns to the documents, which are joined by id and cut.

Results for odd input: a null text is empty; texts shorter than `length` keep
all bytes; rows without an id are left out; exact repeats of a row each give
its result; rows that share an id but not the text are each cut by what smaller ids hold, and
keep what only they share; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redraft.llm import textblocks as tb
from redraft.llm.components import Tables

TRIGGER = 24
KEY, PHRASE, PLACE = 4, 5, 4
#: Most windows of a phrase; with the bytes behind the last, its size fits 16 bits.
RUN = 4096
#: Marks of phrases: their text is needed, or all of it is removed.
NEEDED, REMOVED = 1, 2

_PARSE = "shard int, done boolean, ids binary, counts binary, places binary, keys binary, phrases binary"
_MARKS = "bucket int, ids binary, counts binary, places binary, marks binary"
_TEXTS = "shard int, ids binary, places binary, sizes binary, texts binary"
_SPANS = "bucket int, ids binary, starts binary, ends binary"


def parse(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The phrases of documents: document, start, end, hash of the trigger, hash of the phrase."""
    n, t = len(data), length - TRIGGER + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = tb.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = tb.mix((sums[TRIGGER:] - sums[:-TRIGGER]) * down[: n - TRIGGER + 1])
    low = (h >> np.uint64(32)).astype(np.uint32)
    at = np.arange(len(low), dtype=np.int32)
    width = 1
    while width < t:  # leftmost minimum of doubling windows
        step = min(width, t - width)
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.where(right, low[step:], low[:-step])
        width += step
    sizes = np.maximum(np.diff(bounds) - length + 1, 0)
    starts = tb.ranges(bounds[:-1], sizes)  # of all windows inside documents
    if not len(starts):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    trigger = h[at[starts]]
    new = np.ones(len(starts), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    if len(first) and np.diff(np.append(first, len(starts))).max() > RUN:  # cut long runs
        place = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
        first = np.flatnonzero(place % RUN == 0)
    last = np.append(first[1:], len(starts)) - 1
    begin, end = starts[first], starts[last] + length
    phrase = (sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.searchsorted(bounds, begin, side="right") - 1, begin, end, trigger[first], tb.mix(phrase)


def parse_batch(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, ...]:
    """Phrases of a batch: row, place in the document's parse, start in the document, end, trigger, phrase."""
    data, bounds = tb.texts_of(batch["text"])
    found = []
    for a, b in tb.pieces(bounds):
        row, begin, end, key, phrase = parse(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], length)
        own = bounds[a + row] - bounds[a]
        found.append((row + a, begin - own, end - own, key, phrase))
    row, begin, end, key, phrase = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    counts = np.bincount(row, minlength=batch.num_rows)
    return row, np.arange(len(row)) - np.repeat(tb.runs(counts)[:-1], counts), begin, end, key, phrase


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(40)) % np.uint64(shards)).astype(np.int32)


def _by(group: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by group, and the bounds of each group in it."""
    order = np.argsort(group, kind="stable")
    return order, np.searchsorted(group[order], np.arange(count + 1))


def _runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive equal values: value and length of each run."""
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[at], np.diff(np.append(at, len(values)))


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def pack_parse(batches: Iterable[pa.RecordBatch], length: int, shards: int, rows_of_id: int = 1) -> Iterator[pa.RecordBatch]:
    """Phrases to the key range of their trigger, each distinct phrase of a batch once; its other occurrences are `done`, to be removed."""
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 5]
    for batch in batches:
        ids = batch["doc_id"].to_numpy()
        row, place, _, _, key, phrase = parse_batch(batch, length)
        doc = ids[row]
        order = np.lexsort((doc, phrase, key))
        same = np.zeros(len(order), bool)
        same[1:] = (key[order][1:] == key[order][:-1]) & (phrase[order][1:] == phrase[order][:-1])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        done = np.zeros(len(order), bool)
        done[order] = same & (doc[order] // rows_of_id > doc[order][first] // rows_of_id)
        rows = []
        for kind in (False, True):
            pick = np.flatnonzero(done == kind)
            shard = _shard(key[pick], shards) if not kind else ((tb.mix(doc[pick].astype(np.uint64)) + place[pick].astype(np.uint64)) % np.uint64(shards)).astype(np.int32)
            order, cuts = _by(shard, shards)
            for s in range(shards):
                own = pick[order[cuts[s] : cuts[s + 1]]]
                if len(own):
                    each, counts = _runs_of(row[own])
                    rows.append((s, kind, ids[each].tobytes(), counts.astype("<i4").tobytes(), tb.low_bytes(place[own], PLACE), b"" if kind else tb.low_bytes(key[own], KEY), b"" if kind else tb.low_bytes(phrase[own], PHRASE)))
        yield _rows(rows, ["shard", "done", "ids", "counts", "places", "keys", "phrases"], kinds)


def _column(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def _low(table: pa.Table, name: str, size: int) -> np.ndarray:
    return tb.from_low_bytes(b"".join(table[name].to_pylist()), size)


def mark_phrases(table: pa.Table, buckets: int, rows_of_id: int = 1) -> pa.Table:
    """One key range: repeats of a phrase in larger documents are removed; of triggers with several phrases the text is needed."""
    done = table.filter(table["done"])
    table = table.filter(pa.compute.invert(table["done"]))
    doc = np.repeat(_column(table, "ids", "<i8"), _column(table, "counts", "<i4"))
    place, key, phrase = _low(table, "places", PLACE), _low(table, "keys", KEY), _low(table, "phrases", PHRASE)
    order = np.lexsort((doc, phrase, key))
    doc, place, key, phrase = doc[order], place[order], key[order], phrase[order]
    n = len(doc)
    new_key, new_phrase = np.ones(n, bool), np.ones(n, bool)
    new_key[1:] = key[1:] != key[:-1]
    new_phrase[1:] = new_key[1:] | (phrase[1:] != phrase[:-1])
    leader = np.maximum.accumulate(np.where(new_phrase, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    own = doc // rows_of_id
    removed = own > own[leader]
    group = np.cumsum(new_key) - 1
    starts = np.flatnonzero(new_key)
    if n:
        least, most = np.minimum.reduceat(own[leader], starts), np.maximum.reduceat(own[leader], starts)
        several = np.add.reduceat(new_phrase.astype(np.int64), starts) > 1
        needed = ~removed & (several & (least < most))[group]
    else:
        needed = removed
    mark = np.where(removed, REMOVED, np.where(needed, NEEDED, 0)).astype(np.uint8)
    told = mark > 0
    doc = np.concatenate((doc[told], np.repeat(_column(done, "ids", "<i8"), _column(done, "counts", "<i4"))))
    place = np.concatenate((place[told], _low(done, "places", PLACE)))
    mark = np.concatenate((mark[told], np.full(len(doc) - int(told.sum()), REMOVED, np.uint8)))
    order = np.lexsort((place, doc))
    doc, place, mark = doc[order], place[order], mark[order]
    order, cuts = _by(_bucket(doc, buckets), buckets)
    rows = []
    for b in range(buckets):
        own = order[cuts[b] : cuts[b + 1]]
        if len(own):
            each, counts = _runs_of(doc[own])
            rows.append((b, each.tobytes(), counts.astype("<i4").tobytes(), tb.low_bytes(place[own].astype(np.uint64), PLACE), mark[own].tobytes()))
    return pa.Table.from_batches([_rows(rows, ["bucket", "ids", "counts", "places", "marks"], [pa.int32(), *[pa.binary()] * 4])])


def _bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (tb.mix(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _grouped(doc: np.ndarray, columns: dict[str, tuple[np.ndarray, str]]) -> pa.Table:
    """One row for each document with its values of every column, in order."""
    order = np.argsort(doc, kind="stable")
    each, counts = _runs_of(doc[order])
    cuts = tb.runs(counts)
    out = {"doc_id": pa.array(each.astype(np.int64))}
    for name, (values, kind) in columns.items():
        raw, size = values[order].astype(kind).tobytes(), np.dtype(kind).itemsize
        out[name] = pa.array([raw[a * size : b * size] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())
    return pa.table(out)


def marks_of_documents(table: pa.Table) -> pa.Table:
    doc = np.repeat(_column(table, "ids", "<i8"), _column(table, "counts", "<i4"))
    return _grouped(doc, {"places": (_low(table, "places", PLACE), "<u4"), "marks": (_column(table, "marks", "u1"), "u1")})


def _marked(batch: pa.RecordBatch, length: int, mark: int) -> tuple[np.ndarray, ...]:
    """Row, start, end and trigger of the phrases with a mark, from batches (doc_id, text, places, marks)."""
    counts = np.array([len(x or b"") for x in batch["marks"].to_pylist()], np.int64)
    place = np.frombuffer(b"".join(x or b"" for x in batch["places"].to_pylist()), "<u4").astype(np.int64)
    marks = np.frombuffer(b"".join(x or b"" for x in batch["marks"].to_pylist()), "u1")
    some = np.flatnonzero(counts > 0)
    part = batch.take(pa.array(some))
    row, _, begin, end, key, _ = parse_batch(part, length)
    before = np.searchsorted(row, np.arange(len(some) + 1))
    owner = np.repeat(np.arange(len(some)), counts[some])
    pick = before[owner] + place
    pick = np.unique(pick[(marks == mark) & (pick < before[owner + 1])])
    return some[row[pick]], begin[pick], end[pick], key[pick]


def pack_texts(batches: Iterable[pa.RecordBatch], length: int, shards: int) -> Iterator[pa.RecordBatch]:
    """The text of dictionary phrases whose trigger has others too, to the key range of the trigger."""
    for batch in batches:
        ids = batch["doc_id"].to_numpy()
        row, begin, end, key = _marked(batch, length, NEEDED)
        data, bounds = tb.texts_of(batch["text"])
        order, cuts = _by(_shard(key, shards), shards)
        rows = []
        for s in range(shards):
            own = order[cuts[s] : cuts[s + 1]]
            own = own[np.argsort(key[own], kind="stable")]  # like phrases side by side compress well
            if len(own):
                size = end[own] - begin[own]
                text = data[tb.ranges(bounds[row[own]] + begin[own], size)]
                rows.append((s, ids[row[own]].tobytes(), begin[own].astype("<i4").tobytes(), size.astype("<u2").tobytes(), text.tobytes()))
        yield _rows(rows, ["shard", "ids", "places", "sizes", "texts"], [pa.int32(), *[pa.binary()] * 4])


def sort_suffixes(table: pa.Table, length: int, buckets: int, rows_of_id: int = 1) -> pa.Table:
    """One key range: the suffixes of its dictionary in order, and the spans of those that start in a smaller document too."""
    doc, place = _column(table, "ids", "<i8"), _column(table, "places", "<i4").astype(np.int64)
    size, text = _column(table, "sizes", "<u2").astype(np.int64), _column(table, "texts", "u1")
    # equal phrases of the dictionary are sorted once
    at = tb.runs(size)
    windows = size - length + 1
    start = tb.ranges(at[:-1], windows)
    phrase = np.repeat(np.arange(len(size)), windows)
    h = _windows_hash(text, start, length)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    head = np.zeros(len(start), np.uint64)
    for i in range(8):
        head = (head << np.uint64(8)) | padded[start + i].astype(np.uint64)
    order = np.lexsort((doc[phrase], h, head))  # the suffix array, by first bytes and then by the hash of all
    start, phrase, h, head = start[order], phrase[order], h[order], head[order]
    same = np.zeros(len(order), bool)
    same[1:] = (h[1:] == h[:-1]) & (head[1:] == head[:-1])
    for part in np.array_split(np.flatnonzero(same), int(same.sum()) // 200_000 + 1):
        x, y = start[part][:, None] + np.arange(length), start[part - 1][:, None] + np.arange(length)
        same[part] = (text[x] == text[y]).all(axis=1)
    leader = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else np.zeros(0, np.int64)
    gone = doc[phrase] // rows_of_id > doc[phrase[leader]] // rows_of_id
    start, phrase = start[gone], phrase[gone]
    order = np.argsort(start)
    start, phrase = start[order], phrase[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + 1) | (phrase[1:] != phrase[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    own = phrase[first]
    begin, end = place[own] + start[first] - at[own], place[own] + start[last] - at[own] + length
    order, cuts = _by(_bucket(doc[own], buckets), buckets)
    rows = []
    for b in range(buckets):
        pick = order[cuts[b] : cuts[b + 1]]
        if len(pick):
            rows.append((b, doc[own[pick]].tobytes(), begin[pick].astype("<i4").tobytes(), end[pick].astype("<i4").tobytes()))
    return pa.Table.from_batches([_rows(rows, ["bucket", "ids", "starts", "ends"], [pa.int32(), *[pa.binary()] * 3])])


def _windows_hash(text: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(start), np.uint64)
    step = 1 << 20
    for a in range(0, len(start), step):
        s = start[a : a + step]
        lo, hi = int(s[0]), int(s[-1]) + length
        out[a : a + step] = tb.kgram_hashes(text[lo:hi], length)[s - lo]
    return out


def spans_of_documents(table: pa.Table) -> pa.Table:
    return _grouped(_column(table, "ids", "<i8"), {"starts": (_column(table, "starts", "<i4"), "<i4"), "ends": (_column(table, "ends", "<i4"), "<i4")})


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans that cover the same places; touching spans become one."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return begin[first], reach[np.append(first[1:], len(begin)) - 1]


def cut_rows(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The spans to remove and the bytes that stay, from batches (doc_id, text, places, marks, starts, ends)."""
    for batch in batches:
        row, begin, end, _ = _marked(batch, length, REMOVED)
        more = np.array([len(x or b"") // 4 for x in batch["starts"].to_pylist()], np.int64)
        row = np.concatenate((row, np.repeat(np.arange(len(more)), more)))
        begin = np.concatenate((begin, *(np.frombuffer(x or b"", "<i4") for x in batch["starts"].to_pylist()))).astype(np.int64)
        end = np.concatenate((end, *(np.frombuffer(x or b"", "<i4") for x in batch["ends"].to_pylist()))).astype(np.int64)
        order, cuts = _by(row, batch.num_rows)
        data, bounds = tb.texts_of(batch["text"])
        starts, ends, kept = [], [], []
        for d in range(batch.num_rows):
            own = order[cuts[d] : cuts[d + 1]]
            s, e = merged(begin[own], end[own])
            text = data[bounds[d] : bounds[d + 1]].tobytes()
            ks, ke = [0, *e.tolist()], [*s.tolist(), len(text)]
            starts.append(s.tolist())
            ends.append(e.tolist())
            kept.append(b"".join([text[a:b] for a, b in zip(ks, ke, strict=True)]))
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_bytes": pa.array(np.diff(bounds)), "starts": pa.array(starts, pa.list_(pa.int64())), "ends": pa.array(ends, pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary())})


def digest_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        starts, ends = b["starts"].to_pylist(), b["ends"].to_pylist()
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": b["doc_id"],
                "n_bytes": b["n_bytes"],
                "n_removed": pa.array([sum(e) - sum(s) for s, e in zip(starts, ends, strict=True)], pa.int64()),
                "n_spans": pa.array([len(s) for s in starts], pa.int64()),
                "kept_sha256": pa.array([sha256(x).hexdigest() for x in b["kept"].to_pylist()], pa.string()),
            }
        )


def _with_rows(texts: DataFrame, tables: Tables) -> tuple[DataFrame, int, DataFrame | None]:
    """Rows told apart: where ids repeat with other texts, ids times the most texts of an id, plus the text's number; and that most.  Ids too large to be multiplied are first replaced by their places in order, (doc_id, place)."""
    sizes = texts.groupBy("doc_id").agg(F.count_distinct(F.xxhash64("text")).alias("n")).agg(F.max("n").alias("n"), F.max("doc_id").alias("high"), F.min("doc_id").alias("low")).first()
    most, ids = sizes["n"] or 1, None
    if most > 1:
        if max(sizes["high"], -sizes["low"]) >= (1 << 62) // most:
            # numbered along ranges of ids, so places stand in the order of ids; saved, as numbers are only the same while partitions are
            ordered = texts.select("doc_id").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id")
            ids = tables.saved(ordered.select("doc_id", F.monotonically_increasing_id().alias("place")))
            texts = texts.join(ids, "doc_id").select(F.col("place").alias("doc_id"), "text")
        order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
        texts = texts.withColumn("number", F.dense_rank().over(order) - 1).select((F.col("doc_id") * most + F.col("number")).alias("doc_id"), "text")
    return texts, most, ids


def _cut_input(docs: DataFrame, id_col: str, text_col: str, length: int, tables: Tables) -> tuple[DataFrame, int, DataFrame | None]:
    """Documents with the marks of their phrases and the spans that the sorted suffixes give; the most texts of an id, and what places of ids stand for."""
    spark = docs.sparkSession
    tb.small_batches(spark, 1000)
    shards = tb.shards(spark, 32)
    texts, n, ids = _with_rows(tb.keyed(docs, id_col, text_col), tables)
    packed = texts.mapInArrow(lambda it: pack_parse(it, length, shards, n), _PARSE)
    marks = packed.groupBy("shard").applyInArrow(lambda t: mark_phrases(t, shards, n), _MARKS)
    marks = tables.saved(marks.groupBy("bucket").applyInArrow(marks_of_documents, "doc_id long, places binary, marks binary"))
    marked = texts.join(marks, "doc_id", "left")
    phrases = marked.where("marks is not null").mapInArrow(lambda it: pack_texts(it, length, shards), _TEXTS)
    spans = phrases.groupBy("shard").applyInArrow(lambda t: sort_suffixes(t, length, shards, n), _SPANS)
    spans = spans.groupBy("bucket").applyInArrow(spans_of_documents, "doc_id long, starts binary, ends binary")
    return marked.join(spans, "doc_id", "left").select("doc_id", "text", "places", "marks", "starts", "ends"), n, ids


def _own_ids(df: DataFrame, rows_of_id: int, ids: DataFrame | None) -> DataFrame:
    if rows_of_id > 1:
        df = df.withColumn("doc_id", F.expr(f"(doc_id - pmod(doc_id, {rows_of_id})) div {rows_of_id}"))
    return df if ids is None else df.withColumnRenamed("doc_id", "place").join(ids, "place").select(*df.columns)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept): the maximal removed runs of bytes and the bytes that stay, joined."""
    rows, n, ids = _cut_input(docs, id_col, text_col, length, Tables(docs.sparkSession, "repeats"))
    return _own_ids(rows.mapInArrow(lambda it: cut_rows(it, length), "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"), n, ids)


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of cut_repeats; the bytes that stay are digested in the task that cuts."""
    tables = Tables(docs.sparkSession, "repeats")
    rows, n, ids = _cut_input(docs, id_col, text_col, length, tables)
    return tables.last(_own_ids(rows.mapInArrow(lambda it: digest_rows(cut_rows(it, length)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), n, ids))
