"""Vector code compression by product codebooks, trained with norm-of-sum bounds (operator 13).

A vector's components become integers and are cut into equal parts; each part has a codebook, and a part's
code is the number of its nearest entry.  Assignment passes over all vectors alternate with new entries, which are means.

Every part of a vector keeps, from pass to pass, an upper bound of the distance to its entry
and a lower bound of that to any other entry, each with a stamp: the round whose codebook it was measured
against.  All codebooks are retained, a few kilobytes each.  In a later round an upper bound grows by how far the entry
now lies from where it lay at the stamp, a lower one shrinks by the largest such way of the other entries.
This is the norm of the sum of an entry's moves, never more than the sum of their norms that drifts accumulate.
Where the upper bound stays below the lower one the entry is the nearest one still; else the own distance is
measured, which tightens the upper bound; and only where that does not decide are all entries scanned again.
Bounds are rounded outwards, distances are exact integers, and ties are never decided by a bound.

Vectors with codes and bounds are a table in the shared folder for each round (the one before goes), so a lost executor repeats its part of a
round only.  Tasks send sums and counts of each entry, at most parts x entries rows a task.

Results for odd input: rows whose vector is null, or has null or non-finite components or such beyond LARGEST, are dropped, as are those without
an id, and those whose length is not that of the kept vector with the smallest id among lengths that parts divide.  Repeated ids
and rows count each; seeds with the same id come by their components.  With fewer kept vectors than entries there is an entry for each.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redraft.llm.components import Tables

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components beyond this are dropped with their vector, as squares and sums then no longer fit a long.
LARGEST = 1e5
#: Labels with more than one of so many of all rows go to every task, as there are no more of them than this.
MOST_HOT = 1000
#: Vectors that a task compares with all entries at a time.
BLOCK = 2048

STATE = "vec_id long, ints array<int>, code binary, upper binary, upper_at binary, lower binary, lower_at binary, rescans int"


def kept_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, ints) of the vectors that can be coded."""
    v = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine & (F.size("v") > 0) & (F.size("v") % parts == 0))
    least = v.agg(F.min(F.struct("vec_id", F.size("v").alias("n"))).alias("m")).first()["m"]
    return v.where(F.size("v") == (least["n"] if least else 0)).select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("ints"))


def ways(history: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every stamp the way of each entry from its codebook to the last one, and of each entry the longest way of the others; both rounded up."""
    out = []
    for then in history:
        moved = np.sqrt(((history[-1] - then) ** 2).sum(axis=2).astype(np.float64)) * (1 + 1e-12)
        order = np.argsort(moved, axis=1)
        p = np.arange(len(moved))
        others = np.repeat(moved[p, order[:, -1]][:, None], moved.shape[1], axis=1)
        others[p, order[:, -1]] = moved[p, order[:, -2]] if moved.shape[1] > 1 else 0
        out.append((moved, others))
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the nearest entry (of equal ones the first), its squared distance and the least of the others."""
    code, best, second = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    for at in range(0, len(x), BLOCK):
        part = slice(at, at + BLOCK)
        d = np.zeros((len(x[part]), len(entries)), np.int64)
        for i in range(x.shape[1]):
            d += (x[part, i, None] - entries[None, :, i]) ** 2
        own = d.argmin(axis=1)
        rows = np.arange(len(d))
        code[part], best[part] = own, d[rows, own]
        if len(entries) > 1:
            d[rows, own] = np.iinfo(np.int64).max
            second[part] = d.min(axis=1)
    return code, best, second


class Bounds:
    """Codes of a batch with their bounds and stamps, one row for each vector and one column for each part."""

    def __init__(self, rows: int, parts: int):
        self.code = np.zeros((rows, parts), np.uint8)
        self.upper, self.lower = np.full((rows, parts), np.inf), np.zeros((rows, parts))
        self.upper_at, self.lower_at = np.zeros((rows, parts), np.uint8), np.zeros((rows, parts), np.uint8)
        self.rescans = np.zeros(rows, np.int32)

    @classmethod
    def read(cls, batch: pa.RecordBatch, parts: int) -> Bounds:
        out = cls(0, parts)
        column = lambda name, kind: np.frombuffer(b"".join(batch[name].to_pylist()), kind).reshape(-1, parts)
        out.code, out.upper_at, out.lower_at = (column(n, np.uint8).copy() for n in ("code", "upper_at", "lower_at"))
        out.upper, out.lower = (column(n, "<f4").astype(np.float64) for n in ("upper", "lower"))
        out.rescans = np.zeros(batch.num_rows, np.int32)
        return out

    def columns(self) -> list[pa.Array]:
        """As stored: bounds in four bytes, rounded outwards."""
        upper = np.nextafter(self.upper.astype("<f4"), np.float32(np.inf))
        lower = np.nextafter(self.lower.astype("<f4"), np.float32(-np.inf))
        packed = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
        return [packed(self.code), packed(upper), packed(self.upper_at), packed(lower), packed(self.lower_at), pa.array(self.rescans)]

    def renew(self, x: np.ndarray, history: list[np.ndarray]) -> None:
        """Nearest entries of the last codebook for vectors x (rows, parts, width)."""
        moves, now = ways(history), len(history) - 1
        for p in range(x.shape[1]):
            entries, code = history[-1][p], self.code[:, p]
            own_way = np.stack([m[0][p] for m in moves])
            other_way = np.stack([m[1][p] for m in moves])
            upper = self.upper[:, p] + own_way[self.upper_at[:, p], code]
            lower = self.lower[:, p] - other_way[self.lower_at[:, p], code]
            open_ = np.flatnonzero(~(upper * (1 + 1e-12) < lower * (1 - 1e-12)))
            own = ((x[open_, p] - entries[code[open_]]) ** 2).sum(axis=1)
            self.upper[open_, p], self.upper_at[open_, p] = np.sqrt(own.astype(np.float64)) * (1 + 1e-12), now
            scan = open_[~(self.upper[open_, p] < lower[open_] * (1 - 1e-12))]
            found, best, second = nearest(x[scan, p], entries)
            self.code[scan, p] = found
            self.upper[scan, p] = np.sqrt(best.astype(np.float64)) * (1 + 1e-12)
            self.lower[scan, p] = np.sqrt(second.astype(np.float64)) * (1 - 1e-12)
            self.lower_at[scan, p] = now
            self.rescans[scan] += 1


def vectors_of(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    flat = batch["ints"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, parts, -1)


def assign_batches(batches: Iterable[pa.RecordBatch], history: list[np.ndarray], fresh: bool) -> Iterator[pa.RecordBatch]:
    """State of the next round: codes and bounds against the last codebook.  A fresh start has no bounds yet."""
    parts = len(history[-1])
    for batch in batches:
        if not batch.num_rows:
            continue
        bounds = Bounds(batch.num_rows, parts) if fresh else Bounds.read(batch, parts)
        bounds.renew(vectors_of(batch, parts), history)
        kept = [batch["vec_id"], batch["label"], batch["ints"]]
        yield pa.RecordBatch.from_arrays([*kept, *bounds.columns()], ["vec_id", "label", "ints", "code", "upper", "upper_at", "lower", "lower_at", "rescans"])


def sum_batches(batches: Iterable[pa.RecordBatch], parts: int, entries: int) -> Iterator[pa.RecordBatch]:
    """(part, entry, n, sums) of a task."""
    counts, sums = np.zeros((parts, entries), np.int64), None
    for batch in batches:
        if batch.num_rows:
            x = vectors_of(batch, parts)
            code = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(-1, parts)
            sums = np.zeros((parts, entries, x.shape[2]), np.int64) if sums is None else sums
            for p in range(parts):
                counts[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(sums[p], code[:, p], x[:, p])
    if sums is not None:
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])


def moved(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebook of the next round: floors of the means; unused entries stay."""
    parts, entries, width = book.shape
    own = state.select("ints", "code").mapInArrow(lambda it: sum_batches(it, parts, entries), "part int, entry int, n long, sums array<long>")
    total = own.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
    out = book.copy()
    for r in total.collect():  # at most parts x entries rows
        out[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return out


def error_batches(batches: Iterable[pa.RecordBatch], book: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, code, error, rescans): exact squared distances, summed over parts."""
    parts = len(book)
    for batch in batches:
        x = vectors_of(batch, parts)
        code = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(-1, parts)
        error = np.zeros(batch.num_rows, np.int64)
        for p in range(parts):
            error += ((x[:, p] - book[p][code[:, p]]) ** 2).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["code"], pa.array(error), batch["rescans"]], ["vec_id", "label", "code", "error", "rescans"])


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors, and the codebooks of all rounds (parts, entries, width); the last one is what the codes refer to.

    The codes are (vec_id, label, code binary: a byte for each part, error long, rescans int: parts whose bounds did not decide in the last pass).
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries is 1 to 256: a code is a byte")
    tables = Tables(rows.sparkSession, "codebooks")
    kept = kept_vectors(rows, id_col, vector_col, label_col, parts, scale)
    label = kept.schema["label"].dataType.simpleString()
    seeds = [r["ints"] for r in kept.select("vec_id", "ints").orderBy("vec_id", "ints").limit(entries).collect()]
    if not seeds:
        return tables.last(kept.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).alias("rescans"))), []
    history = [np.array(seeds, np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2)]
    schema = STATE.replace("ints", f"label {label}, ints", 1)
    state = kept
    for number in range(rounds + 1):
        books, fresh = list(history), number == 0
        state = tables.saved(state.mapInArrow(lambda it, b=books, f=fresh: assign_batches(it, b, f), schema), "state")
        if number < rounds:
            history.append(moved(state, history[-1]))
    last = history[-1]
    coded = state.mapInArrow(lambda it: error_batches(it, last), f"vec_id long, label {label}, code binary, error long, rescans int")
    return tables.last(coded), history


def decompress(coded: DataFrame, book: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector array<double>): the vectors that codes stand for."""
    parts = len(book)

    def run(batches):
        for batch in batches:
            code = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(-1, parts)
            ints = book[np.arange(parts)[None, :], code].reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(list(ints / scale), pa.list_(pa.float64()))], ["vec_id", "vector"])

    return coded.select("vec_id", "code").mapInArrow(run, "vec_id long, vector array<double>")


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of error over the rows of a label (those without one together).

    Labels with a thousandth of all rows or more are sent to every task, the others meet their rows by a shuffle, so no task gets all rows of a hot label.
    """
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    least = max(coded.count() // MOST_HOT, 1)
    hot, cold = sums.where(f"n > {least}"), sums.where(f"n <= {least}")
    found = coded.join(F.broadcast(hot.select(F.col("label").alias("hot"), F.col("label_error").alias("hot_error"))), F.col("label").eqNullSafe(F.col("hot")), "left")
    rest = found.where("hot_error is null").drop("hot", "hot_error").join(cold.select(F.col("label").alias("own"), "label_error"), F.col("label").eqNullSafe(F.col("own"))).drop("own")
    return found.where("hot_error is not null").withColumnRenamed("hot_error", "label_error").select(*rest.columns).unionByName(rest)


def code_digests(rows: DataFrame) -> DataFrame:
    """compress and label_errors with codes as hex digits and the digest of all entries."""
    coded, history = compress(rows)
    digest = sha256(",".join(map(str, history[-1].ravel().tolist() if history else [])).encode()).hexdigest()
    return label_errors(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
