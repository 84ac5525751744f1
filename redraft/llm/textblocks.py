"""Arrow and numpy helpers that the operators share inside tasks.

Texts are handled as whole Arrow buffers: words, their hashes and k-gram hashes
of a batch come from a few vectorised passes over its bytes.  Rows that tasks
exchange are *packed*: one row for each shard and batch with numpy arrays as
binary columns, so a shuffle moves a few bytes a key instead of a row a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy passes take at a time; their arrays are about 40 times as large.
PIECE_BYTES = 1 << 20

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)
_U32 = np.uint64(32)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Gaps where punctuation doesn't count: all ASCII but letters and digits.
PLAIN = np.ones(256, dtype=bool)
PLAIN[48:58] = PLAIN[65:91] = PLAIN[97:123] = PLAIN[128:] = False

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, PIECE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of the 64-bit values over all bits, in place."""
    for _ in range(2):
        h ^= h >> _U32
        h *= _MIX
    h ^= h >> _U32
    return h


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document bounds of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, b"")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(bounds: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about `most` bytes; a longer one is alone."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(data: np.ndarray, bounds: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of every word, its end, and words before each document: maximal runs of bytes that are no gaps (by default space and 09-0D)."""
    gap = gaps[data]
    inner = ~gap
    start = inner.copy()
    start[1:] &= gap[:-1]
    end = inner.copy()
    end[:-1] &= gap[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    start[cuts] |= inner[cuts]
    end[cuts - 1] |= inner[cuts - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z in lower case."""
    n = len(data)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h += (ends - starts).astype(np.uint64) * _MUL
    return mix(h)


def kgram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Rolling 64-bit hash of the k bytes from every position on."""
    n = len(data)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


_PLACES = np.array([pow(0xA24BAED4963EE407, i + 1, 1 << 64) for i in range(64)], dtype=np.uint64)


def window_hashes(h: np.ndarray, places: tuple[int, ...] | range) -> np.ndarray:
    """Hash of h[i + p] for p in places, in their order, for every i that has all of them."""
    n = len(h) - max(places)
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for p in places:
        out += h[p : p + n] * _PLACES[p]
    return mix(out)


def runs(lengths: np.ndarray) -> np.ndarray:
    """Bounds of consecutive runs of the given lengths."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    lead = np.repeat(starts - runs(lengths)[:-1], lengths)
    return lead + np.arange(total)


def low_bytes(h: np.ndarray, n: int) -> bytes:
    """The n low bytes of each value, little-endian."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def from_low_bytes(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(b) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(b, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


def shards(spark: SparkSession, least: int = 64) -> int:
    """Number of key ranges: follows the session's shuffle partitions, which are set by the size of the data."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def even_keys(spark: SparkSession, count: int, partitions: int) -> list[int]:
    """Numbers for `count` key ranges that Spark's hash partitioning deals evenly: the i-th goes to partition i modulo `partitions`."""
    each = -(-count // partitions)
    number = F.col("id").cast("int")
    found = spark.range(0, 64 * partitions * each, 1, 4).groupBy(F.pmod(F.hash(number), F.lit(partitions)).alias("p")).agg(F.slice(F.sort_array(F.collect_list(number)), 1, each).alias("own"))
    own = {r["p"]: r["own"] for r in found.collect()}
    return [own[i % partitions][i // partitions] for i in range(count)]


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the rows of an Arrow batch, so that batches of long texts stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id long, text string) of the rows that have an id; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
