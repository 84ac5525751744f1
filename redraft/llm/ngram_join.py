"""N-gram Jaccard self-join by rare-first prefix filtering (operator 3).

1. Every text becomes its set of word n-grams, as 64-bit hashes.  The sets go,
   packed, to key ranges, which count the documents of each n-gram; n-grams of
   one document only cannot be shared and stay behind, the others return to
   their documents with the frequency.
2. In a set ordered rare-first, the n-grams of one document lead.  A set whose
   shared n-grams are too few for the threshold is out; of the others the
   shared part of the prefix is kept.
3. Equal sets become one representative.  Prefix n-grams join representatives:
   first each with the hub of its n-gram (the set with the fewest unshared
   n-grams), then, for n-grams whose sets are still in several components, the
   sets outside the largest component with the others.  That second join runs on
   n-gram, band of lengths and part: sets that link are in the same band or in
   neighbouring ones, and the sets of an n-gram that many hold are dealt over
   parts.  Length and positional filters come before a pair is made, the suffix
   filter (recursive halving) and the exact count after; each pair is verified
   once.  Sets that are already connected need no link between them, so no group
   is expanded into all its pairs.

Results for odd input: null and empty texts have no n-grams and stay alone;
rows without an id are left out; rows that repeat an id count as one document,
and exact repeats change nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redraft.llm import textblocks as tb
from redraft.llm.components import Tables, components

KEY_BYTES = 7
#: Parts that documents of one set are dealt over, and sets of an n-gram and a band in each part of the second join.
SALTS, PART_SETS = 32, 2000
#: Halvings of the suffix filter.
HALVINGS = 4
_PACKED = "shard int, ids binary, sizes binary, counts binary, keys binary"
_BACK = "bucket int, shard int, ids binary, sizes binary, counts binary, keys binary, rarity binary"
_SETS = "doc_id long, n_shingles long, n_shared long, signature binary, keys binary, prefix int"


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n with any set that it links with."""
    return -((-n * percent) // 100)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each document, sorted, and their bounds; a text of fewer words is one n-gram."""
    starts, ends, first = tb.words(data, bounds)
    h = tb.word_hashes(data, starts, ends)
    grams = tb.window_hashes(h, range(words))
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            sets.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            short = np.zeros(words + 1, np.uint64)
            short[: b - a] = h[a:b]
            short[words] = b - a
            sets.append(tb.window_hashes(short, range(words + 1)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), tb.runs(np.array([len(s) for s in sets], np.int64))


def pack_sets(batches: Iterable[pa.RecordBatch], words: int, shards: int) -> Iterator[pa.RecordBatch]:
    """For each batch and key range a row of document ids, set sizes (in the range of a set's first key only), keys per document, and keys."""
    for batch in batches:
        data, bounds = tb.texts_of(batch["text"])
        ids = batch["doc_id"].to_numpy()
        keys, sizes = [], []
        for a, b in tb.pieces(bounds):
            found, at = shingle_sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], words)
            keys.append(found)
            sizes.append(np.diff(at))
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(ids)), sizes)
        shard = ((keys >> np.uint64(48)) % np.uint64(shards)).astype(np.int32)
        home = np.zeros(len(ids), np.int32)
        filled = sizes > 0
        home[filled] = shard[tb.runs(sizes)[:-1][filled]]
        order = np.argsort(shard, kind="stable")
        keys, doc = keys[order], doc[order]
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = []
        for s in range(shards):
            k, d = keys[cuts[s] : cuts[s + 1]], doc[cuts[s] : cuts[s + 1]]
            have = np.union1d(d, np.flatnonzero(home == s))
            if len(have):
                count = np.bincount(np.searchsorted(have, d), minlength=len(have))
                size = np.where(home[have] == s, sizes[have], 0)
                rows.append((s, ids[have].tobytes(), size.astype("<i4").tobytes(), count.astype("<i4").tobytes(), tb.low_bytes(k, KEY_BYTES)))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)] if rows else [pa.array([], t) for t in (pa.int32(), *[pa.binary()] * 4)], ["shard", "ids", "sizes", "counts", "keys"])


def _column(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def count_documents(table: pa.Table, buckets: int) -> pa.Table:
    """One key range: n-grams of two documents or more go back, with the frequency on a logarithmic scale, to the buckets of their documents."""
    ids, sizes, counts = (_column(table, n, t) for n, t in (("ids", "<i8"), ("sizes", "<i4"), ("counts", "<i4")))
    keys = tb.from_low_bytes(b"".join(table["keys"].to_pylist()), KEY_BYTES)
    row = np.repeat(np.arange(len(ids)), counts)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    often = np.diff(np.append(np.flatnonzero(new), len(k)))
    frequency = np.zeros(len(k), np.int64)
    frequency[order] = np.repeat(often, often)
    shared = frequency > 1
    keys, row = keys[shared], row[shared]
    rarity = np.minimum(255, 8 * np.log2(frequency[shared])).astype(np.uint8)
    count = np.bincount(row, minlength=len(ids))
    bucket = (tb.mix(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    tell = (count > 0) | (sizes > 0) | (counts == 0)
    order = np.argsort(bucket, kind="stable")
    order = order[tell[order]]
    at = tb.runs(count)
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    shard = table["shard"][0].as_py()
    out = []
    for b in np.unique(bucket[order]).tolist():
        rows = order[cuts[b] : cuts[b + 1]]
        pick = tb.ranges(at[rows], count[rows])
        out.append((b, shard, ids[rows].tobytes(), sizes[rows].tobytes(), count[rows].astype("<i4").tobytes(), tb.low_bytes(keys[pick], KEY_BYTES), rarity[pick].tobytes()))
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
    return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["bucket", "shard", "ids", "sizes", "counts", "keys", "rarity"])


def order_sets(table: pa.Table, percent: int) -> pa.Table:
    """One bucket of documents: the shared n-grams of each, rare-first, and how many of them lie in its prefix; keys only where enough are shared."""
    ids, sizes, counts = (_column(table, n, t) for n, t in (("ids", "<i8"), ("sizes", "<i4"), ("counts", "<i4")))
    keys = tb.from_low_bytes(b"".join(table["keys"].to_pylist()), KEY_BYTES)
    each = np.array([len(x) // KEY_BYTES for x in table["keys"].to_pylist()], np.int64)
    keys = keys ^ (np.repeat(table["shard"].to_numpy().astype(np.uint64), each) << np.uint64(56))
    rarity = _column(table, "rarity", "u1")
    docs, inverse = np.unique(ids, return_inverse=True)
    doc = np.repeat(inverse, counts)
    n = np.zeros(len(docs), np.int64)
    np.maximum.at(n, inverse, sizes)
    order = np.lexsort((keys, rarity, doc))
    doc, keys = doc[order], keys[order]
    new = np.ones(len(doc), bool)  # rows that repeat an id bring their keys again
    new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
    doc, keys = doc[new], keys[new]
    shared = np.bincount(doc, minlength=len(docs))
    at = tb.runs(shared)
    least = needed(n, percent)
    live = (n > 0) & (shared >= least)
    prefix = np.where(live, np.maximum(0, n - least + 1 - (n - shared)), 0)
    out_keys, signature = [], []
    for d in range(len(docs)):
        k = keys[at[d] : at[d + 1]] if live[d] else keys[:0]
        out_keys.append(k.astype("<u8").tobytes())
        whole = live[d] and shared[d] == n[d]
        signature.append(np.array([k.sum(), tb.mix(k.copy()).sum(), n[d]], "<u8").tobytes() if whole else None)
    return pa.Table.from_arrays(
        [pa.array(docs), pa.array(n), pa.array(shared), pa.array(signature, pa.binary()), pa.array(out_keys, pa.binary()), pa.array(prefix.astype(np.int32))],
        ["doc_id", "n_shingles", "n_shared", "signature", "keys", "prefix"],
    )


def prefix_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shared n-gram in a prefix: token, doc_id, n, unshared n-grams, and position in the whole ordered set."""
    for b in batches:
        n, shared, prefix = (b[x].to_numpy().astype(np.int64) for x in ("n_shingles", "n_shared", "prefix"))
        keys = np.frombuffer(b"".join(b["keys"].to_pylist()), "<i8")
        pick = tb.ranges(tb.runs(shared)[:-1], prefix)
        row = np.repeat(np.arange(len(n)), prefix)
        place = tb.ranges(n - shared, prefix)
        yield pa.RecordBatch.from_pydict({"token": keys[pick], "doc_id": b["doc_id"].to_numpy()[row], "n": n[row], "unshared": (n - shared)[row], "place": place})


def at_most(x: np.ndarray, y: np.ndarray, halvings: int = HALVINGS) -> int:
    """A bound of the common keys of two sorted sets: both are halved at the middle key of the second, again and again, and no part shares more than its smaller side."""
    if not halvings or not len(x) or not len(y):
        return min(len(x), len(y))
    middle = len(y) // 2
    at = int(np.searchsorted(x, y[middle]))
    same = int(at < len(x) and x[at] == y[middle])
    return at_most(x[:at], y[:middle], halvings - 1) + same + at_most(x[at + same :], y[middle + 1 :], halvings - 1)


def overlap(x: np.ndarray, y: np.ndarray, least: int) -> int:
    """Common keys of two sets; 0 as soon as the suffix filter shows that they have fewer than `least`."""
    x, y = np.sort(x), np.sort(y)
    if at_most(x, y) < least:
        return 0
    both = np.sort(np.concatenate((x, y)), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def verify_pairs(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, n_a, keys_a, b, n_b, keys_b) those whose sets reach the threshold."""
    for batch in batches:
        keep = []
        for na, ka, nb, kb in zip(*(batch[c].to_pylist() for c in ("n_a", "keys_a", "n_b", "keys_b")), strict=True):
            least = -((-percent * (na + nb)) // (100 + percent))
            common = overlap(np.frombuffer(ka, "<u8"), np.frombuffer(kb, "<u8"), least)
            keep.append(100 * common >= percent * (na + nb - common))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_pydict({"a": batch["a"], "b": batch["b"]}).filter(mask)


def _filters(x: str, y: str, percent: int) -> str:
    """Length filter, and positional filter at a common n-gram: what is left behind it must suffice for the overlap."""
    return (
        f"100 * {x}.n >= {percent} * {y}.n AND 100 * {y}.n >= {percent} * {x}.n AND "
        f"least({x}.n - {x}.place, {y}.n - {y}.place) * {100 + percent} >= {percent} * ({x}.n + {y}.n)"
    )


def links_of(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links; b is the hub or the common side."""
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("keys").alias(f"keys_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "n_a", "keys_a", "b", "n_b", "keys_b")
    return both.mapInArrow(lambda it: verify_pairs(it, percent), "a long, b long")


def ngram_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """One row per document with its set's size and, where it can link at all, its shared n-grams rare-first."""
    spark = docs.sparkSession
    tb.small_batches(spark)
    shards = tb.shards(spark)
    packed = tb.keyed(docs, id_col, text_col).mapInArrow(lambda it: pack_sets(it, words, shards), _PACKED)
    back = packed.groupBy("shard").applyInArrow(lambda t: count_documents(t, shards), _BACK)
    return back.groupBy("bucket").applyInArrow(lambda t: order_sets(t, percent), _SETS)


def _band(n: str, percent: int):
    """Band of a length: sets whose lengths pass the length filter are in one band or in neighbouring ones."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int") if percent < 100 else F.col(n).cast("int")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document: components of the links with Jaccard similarity of at least percent / 100."""
    tables = Tables(docs.sparkSession, "ngram-join")
    sets = tables.saved(ngram_sets(docs, id_col, text_col, words, percent))
    live = sets.where("prefix > 0")
    same = tables.saved(live.where("signature is not null").groupBy("signature").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"))
    # a set that a third of all documents have would meet in one task: its documents are dealt over SALTS, its one row to each of them
    salted = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    whole = live.where("signature is not null").select("doc_id", "signature", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    copies = tables.saved(whole.join(salted, ["signature", "salt"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    reps = tables.saved(live.join(copies.where("a <> b").select(F.col("a").alias("doc_id")), "doc_id", "left_anti").select("doc_id", "n_shingles", "n_shared", "prefix", "keys"))
    entries = tables.saved(reps.mapInArrow(prefix_rows, "token long, doc_id long, n long, unshared long, place long"))

    hubs = entries.groupBy("token").agg(F.min(F.struct("unshared", "doc_id", "n", "place")).alias("h"), F.count("*").alias("sets")).where("sets > 1").select("token", F.col("h.doc_id").alias("hub"), F.col("h.n").alias("n"), F.col("h.place").alias("place"))
    stars = entries.alias("x").join(hubs.alias("h"), F.expr(f"x.token = h.token AND x.doc_id <> h.hub AND {_filters('x', 'h', percent)}")).select(F.least("x.doc_id", "h.hub").alias("a"), F.greatest("x.doc_id", "h.hub").alias("b")).distinct()
    tried = tables.saved(stars)
    linked = tables.saved(links_of(tried, reps, percent))
    label = components(linked)

    placed = entries.join(label, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    placed = tables.saved(placed.withColumn("band", _band("n", percent)))
    by_part = placed.groupBy("token", "component_id").agg(F.count("*").alias("sets"))
    open_tokens = by_part.groupBy("token").agg(F.max(F.struct("sets", "component_id")).alias("most"), F.count("*").alias("parts"), F.sum("sets").alias("sets")).where("parts > 1").select("token", F.col("most.component_id").alias("major"), F.ceil(F.col("sets") / PART_SETS).cast("int").alias("deals"))
    placed = tables.saved(placed.join(open_tokens, "token"))
    rest = placed.where("component_id <> major").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("deals").cast("long")).cast("int"))
    every = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    pairs = rest.alias("x").join(every.alias("y"), F.expr(f"x.token = y.token AND x.band = y.band AND x.part = y.part AND x.component_id <> y.component_id AND (y.component_id = y.major OR x.doc_id < y.doc_id) AND {_filters('x', 'y', percent)}"))
    cross = tables.saved(pairs.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    found = links_of(cross, reps, percent)
    final = components(linked.unionByName(found).unionByName(copies))
    return tables.last(sets.select("doc_id", "n_shingles").join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
