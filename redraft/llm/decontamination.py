"""Benchmark decontamination by spaced-seed hashing (operator 1).

Fixed masks slide over the words of test items and documents (runs of letters and
digits, A-Z in lower case); a seed hashes the words under a mask's ones, so a word
under a zero may differ.  Items of fewer than LONG words, where the masks are too
wide for the substitutions that are allowed, are sought by runs of two or three
words too, those of fewer than SHORT by all their words.  A Bloom filter of the test
seeds, SLOTS bits for each, drops nearly all windows of the documents where they
are made; what is left joins the test seeds by hash.  Each hit gives a diagonal
(where the item would begin in the document), and on it item and document are
compared word for word: an item leaks into a document when at least 80 of 100 of its
words are found there, diagonals within `spread` of each other counting together,
so that dropped and added words cost only themselves.

Results for odd input: null and empty texts and items have no words and never
match; rows without an id are left out; documents and items whose ids repeat are
told apart by their words, and what any row of an id holds counts for all of them;
an empty table gives clean documents, or no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redraft.llm import textblocks as tb
from redraft.llm.components import Tables

#: Words that count (1) and that may differ (0).
MASKS = ("11111", "1110111", "11011011", "1010101011")
#: Masks for items of fewer than LONG words; those of fewer than SHORT have one of all their words.
CLOSE_MASKS = ("11", "111")
SHORT, LONG = 5, 11
#: Bits of the filter for each seed, and the least and most bits (as powers of two) that it has in all.
SLOTS, LEAST_BITS, MOST_BITS = 32, 20, 30
PROBES = (0, 8, 16, 24, 32, 40)
#: Documents' seeds of one hash are dealt over so many parts.
SALTS = 16


def spread(n: int) -> int:
    """How far apart the diagonals of one occurrence of an item of n words may lie."""
    return max(2, n // 5)


def _places(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def seeds(h: np.ndarray, close: bool) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of a run of word hashes and the word at which each begins; `close` adds the masks for items of few words."""
    made, at = [], []
    for number, mask in enumerate([*MASKS, *([*CLOSE_MASKS, *("1" * n for n in range(1, SHORT))] if close else [])]):
        w = tb.window_hashes(h, _places(mask))
        w ^= np.uint64((number + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        made.append(w)
        at.append(np.arange(len(w)))
    return np.concatenate(made), np.concatenate(at)


def item_seeds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds by which an item is sought."""
    if not len(h) or len(h) >= LONG:
        return seeds(h, False)
    s, at = seeds(h, True)
    cuts = tb.runs(np.array([max(0, len(h) - len(m) + 1) for m in (*MASKS, *CLOSE_MASKS, *("1" * n for n in range(1, SHORT)))]))
    # all its words; or a pair of neighbours for five words, else three in a row, which any substitutions that are allowed leave somewhere
    mask = len(MASKS) + (len(CLOSE_MASKS) + len(h) - 1 if len(h) < SHORT else 0 if len(h) == SHORT else 1)
    own = slice(cuts[mask], cuts[mask + 1])
    return s[own], at[own]


def row_key(words: bytes) -> int:
    """Tells rows of one id apart."""
    return int.from_bytes(blake2b(words, digest_size=8).digest(), "little", signed=True)


def item_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, row, words binary, seeds, places) of each item."""
    for batch in batches:
        data, bounds = tb.texts_of(batch["text"])
        starts, ends, first = tb.words(data, bounds, tb.PLAIN)
        h = tb.word_hashes(data, starts, ends)
        words, made, at = [], [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            s, p = item_seeds(h[a:b])
            words.append(h[a:b].tobytes())
            made.append(s.astype(np.int64))
            at.append(p.astype(np.int64))
        yield pa.RecordBatch.from_pydict({"item": batch["doc_id"], "row": pa.array([row_key(w) for w in words], pa.int64()), "words": pa.array(words, pa.binary()), "seeds": pa.array(made, pa.list_(pa.int64())), "places": pa.array(at, pa.list_(pa.int64()))})


def filter_bits(n: int) -> int:
    """Bits, as a power of two, of the filter of n seeds."""
    return min(max((SLOTS * max(n, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)


def filter_words(items: DataFrame) -> np.ndarray:
    """The Bloom filter of all test seeds, as bytes.  Tasks set the bits; parts of 8 kB reach the driver, 128 MB in all at most."""
    seed = items.select(F.explode("seeds").alias("seed"))
    bits = filter_bits(seed.count())
    slots = F.array(*[F.shiftrightunsigned("seed", p).bitwiseAND((1 << bits) - 1) for p in PROBES])

    def pack(table: pa.Table) -> pa.Table:
        own = np.zeros(1 << 16, np.uint8)
        own[table["slot"].to_numpy() & 0xFFFF] = 1
        return pa.table({"part": table["part"][:1], "bytes": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    each = seed.select(F.explode(slots).alias("slot")).distinct().select("slot", F.shiftright("slot", 16).alias("part"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in each.groupBy("part").applyInArrow(pack, "part long, bytes binary").collect():
        out[r["part"] << 13 : (r["part"] + 1) << 13] = np.frombuffer(r["bytes"], np.uint8)
    return out


def passes(seed: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    """Places of the seeds that may be test seeds."""
    low, left = np.uint64(8 * len(bloom) - 1), np.arange(len(seed))
    for p in PROBES:
        slot = (seed[left] >> np.uint64(p)) & low
        left = left[(bloom[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    return left


def hit_rows(batches: Iterable[pa.RecordBatch], bloom: np.ndarray, close: bool) -> Iterator[pa.RecordBatch]:
    """A row for each document with windows that pass the filter: its word hashes, seeds and their places."""
    for batch in batches:
        data, bounds = tb.texts_of(batch["text"])
        ids = batch["doc_id"].to_numpy()
        rows: dict[str, list] = {"doc_id": [], "row": [], "words": [], "seeds": [], "places": []}
        for a, b in tb.pieces(bounds):
            part = data[bounds[a] : bounds[b]]
            starts, ends, first = tb.words(part, bounds[a : b + 1] - bounds[a], tb.PLAIN)
            h = tb.word_hashes(part, starts, ends)
            made, at = seeds(h, close)
            ok = passes(made, bloom)
            made, at = made[ok], at[ok]
            doc = np.searchsorted(first, at, side="right") - 1
            order = np.argsort(doc, kind="stable")
            made, at, doc = made[order], at[order], doc[order]
            hit, cut = np.unique(doc, return_index=True)
            cut = np.append(cut, len(doc)).tolist()
            for d, c, e in zip(hit.tolist(), cut[:-1], cut[1:], strict=True):
                words = h[first[d] : first[d + 1]].tobytes()
                rows["doc_id"].append(int(ids[a + d]))
                rows["row"].append(row_key(words))
                rows["words"].append(words)
                rows["seeds"].append(made[c:e].astype(np.int64))
                rows["places"].append((at[c:e] - first[d]).astype(np.int64))
        kinds = {"doc_id": pa.int64(), "row": pa.int64(), "words": pa.binary(), "seeds": pa.list_(pa.int64()), "places": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_pydict({k: pa.array(rows[k], t) for k, t in kinds.items()})


def found_words(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> tuple[int, int]:
    """Most words of the item that diagonals within `spread` of each other find in the document, and where that occurrence begins."""
    best, start = 0, 0
    diagonals = np.unique(diagonals)
    reach = np.searchsorted(diagonals, diagonals + spread(len(item)), side="right")
    matched: dict[int, np.ndarray] = {}
    for i, (d, end) in enumerate(zip(diagonals.tolist(), reach.tolist(), strict=True)):
        if i and end == reach[i - 1]:
            continue  # the diagonals from the one before hold these
        for k in [k for k in matched if k < d]:
            del matched[k]
        seen = np.zeros(len(item), bool)
        for k in diagonals[i:end].tolist():
            if k not in matched:
                a, b = max(0, -k), min(len(item), len(doc) - k)
                matched[k] = np.zeros(len(item), bool)
                if b > a:
                    matched[k][a:b] = doc[a + k : b + k] == item[a:b]
            seen |= matched[k]
        if int(seen.sum()) > best:
            best, start = int(seen.sum()), max(0, d)
    return best, start


def verify_rows(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep: dict[str, list] = {"doc_id": [], "item_id": [], "found": [], "words": [], "start": []}
        for doc, item, text, target, diagonals in zip(*(batch[c].to_pylist() for c in ("doc_id", "item", "words", "item_words", "diagonals")), strict=True):
            target = np.frombuffer(target, "<u8")
            found, start = found_words(np.frombuffer(text, "<u8"), target, np.array(diagonals))
            if 100 * found >= percent * len(target):
                for k, v in zip(keep, (doc, item, found, len(target), start), strict=True):
                    keep[k].append(v)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in keep.items()})


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 80) -> DataFrame:
    """(doc_id, item_id, found, words, start): every item of which at least `percent` of 100 words stand in a document, and the word of the document where that begins."""
    spark = docs.sparkSession
    tb.small_batches(spark, 1000)
    tables = Tables(spark, "decontamination")
    items = tables.saved(tb.keyed(benchmark, item_col, item_text_col).mapInArrow(item_rows, "item long, row long, words binary, seeds array<long>, places array<long>").dropDuplicates(["item", "row"]))
    close = items.where(f"length(words) < {8 * LONG} and length(words) > 0").limit(1).count() > 0
    bloom = spark.sparkContext.broadcast(filter_words(items))
    made = tb.keyed(docs, id_col, text_col).mapInArrow(lambda it: hit_rows(it, bloom.value, close), "doc_id long, row long, words binary, seeds array<long>, places array<long>")
    hits = tables.saved(made)
    bloom.destroy()
    each = lambda df, *keys: df.select(*keys, F.explode(F.arrays_zip("seeds", "places")).alias("z")).select(*keys, F.col("z.seeds").alias("seed"), F.col("z.places").alias("place"))
    # a seed that very many documents hold is dealt over parts, each of which gets the items' side
    of_docs = each(hits, "doc_id", "row").withColumn("salt", F.pmod(F.xxhash64("doc_id", "row"), F.lit(SALTS)))
    of_items = each(items.withColumnRenamed("row", "item_row"), "item", "item_row").select("item", "item_row", "seed", F.col("place").alias("from"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    keys = ["doc_id", "row", "item", "item_row"]
    met = of_docs.join(of_items, ["seed", "salt"]).select(*keys, (F.col("place") - F.col("from")).alias("diagonal")).distinct()
    pairs = met.groupBy(*keys).agg(F.collect_list("diagonal").alias("diagonals"))  # no more than the words of both
    rows = pairs.join(hits.select("doc_id", "row", "words").dropDuplicates(["doc_id", "row"]), ["doc_id", "row"]).join(items.select("item", F.col("row").alias("item_row"), F.col("words").alias("item_words")), ["item", "item_row"])
    found = rows.select("doc_id", "item", "words", "item_words", "diagonals").mapInArrow(lambda it: verify_rows(it, percent), "doc_id long, item_id long, found long, words long, start long")
    return tables.last(found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_ids (sorted), overlap (largest share of an item's words that was found)."""
    found = leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, percent)
    by_doc = found.groupBy("doc_id").agg(F.count_distinct("item_id").alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max(F.col("found") / F.col("words")).alias("overlap"))
    every = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null")
    return every.join(by_doc, "doc_id", "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("overlap", F.lit(0.0)).alias("overlap")
    )
