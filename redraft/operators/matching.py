"""Many patterns at once: which of a table of texts each line contains, in one pass over the lines whatever their number.

Patterns stand in the shared folder, from which every task reads them; nothing of them passes through the driver.  A task takes some lines at a time, cuts them at blanks
where no pattern holds one, and seeks patterns in what is distinct of that: by rolling hashes of the bytes, a pass for each length of a pattern, each hit compared byte by byte.
Its time grows with the text and the matches, not with the patterns.  Tables beyond the size of a block are read block by block by the same task, so hits of a line are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redraft.operators.graph import checkpoint_folder

#: Characters of patterns, with the columns that come with them, which a task holds at a time.
BLOCK_CHARS = 64_000_000
#: Bytes of lines that are searched at a time.
READ_CHARS = 8 << 20
#: Bytes that are compared at a time.
COMPARED = 1 << 24

_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _last_of_each(keys: np.ndarray) -> np.ndarray:
    """Which of sorted keys are the last of their value."""
    return np.append(keys[1:] != keys[:-1], np.ones(min(len(keys), 1), bool))


class Hashed:
    """Bytes of a list of strings, and hashes of any piece of them that do not depend on where it stands."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        self.bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(data, np.uint8)[self.bounds[0] : self.bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        self.bounds = self.bounds - self.bounds[0]
        self.sizes = np.diff(self.bounds)
        self.sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_VALUES[self.data] * _powers(_BASE, len(self.data))[:-1], out=self.sums[1:])
        self.back = _powers(pow(_BASE, -1, 1 << 64), len(self.data))

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """Of the pieces of n bytes from the places on."""
        h = (self.sums[at + n] - self.sums[at]) * self.back[at]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


class Marks:
    """A bitmap of hashes: tells for most others that they are not among them."""

    def __init__(self, hashes: np.ndarray):
        bits = max(10, int(8 * max(len(hashes), 1)).bit_length())
        self.shift, self.map = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.map[hashes >> self.shift] = True

    def have(self, hashes: np.ndarray) -> np.ndarray:
        return self.map[hashes >> self.shift]


class Patterns:
    """Finds patterns, which are distinct and not empty, in texts."""

    def __init__(self, patterns: pa.Array):
        self.text = Hashed(patterns)
        sizes, starts = self.text.sizes, self.text.bounds[:-1]
        self.of_length = {}
        for n in np.flatnonzero(np.bincount(sizes)):
            own = np.flatnonzero(sizes == n)
            h = self.text.hashes(starts[own], n)
            order = np.argsort(h, kind="stable")
            h = h[order]
            self.of_length[int(n)] = (own[order], h, Marks(h), int(np.diff(np.flatnonzero(_last_of_each(h)), prepend=-1).max()))
        self.heads = {}  # of the shortest length, twice that, and so on: how longer patterns begin
        n = int(sizes.min()) if len(sizes) else 0
        while n and (sizes >= n).any():
            self.heads[n] = Marks(self.text.hashes(starts[sizes >= n], n))
            n *= 2

    def found(self, texts: Hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, pattern) of every place at which a pattern lies within one of the texts."""
        left = np.repeat(texts.bounds[1:], texts.sizes) - np.arange(len(texts.data))
        starts, sizes, patterns = [], [], []
        at = np.arange(len(texts.data))
        for n in sorted({*self.of_length, *self.heads}):
            at = at[left[at] >= n]
            h = texts.hashes(at, n)
            if n in self.heads:
                known = self.heads[n].have(h)
                at, h = at[known], h[known]
            if n not in self.of_length:
                continue
            own, hashes, marks, most = self.of_length[n]
            maybe = marks.have(h)
            place, h = at[maybe], h[maybe]
            first = np.searchsorted(hashes, h)
            for k in range(most):  # patterns of one hash stand side by side
                i = np.minimum(first + k, len(hashes) - 1)
                same = hashes[i] == h
                where, which = place[same], own[i[same]]
                if k:
                    where, which = where[first[same] + k < len(hashes)], which[first[same] + k < len(hashes)]
                equal = self._equal(texts.data, where, which, n)
                starts.append(where[equal])
                sizes.append(np.full(int(equal.sum()), n))
                patterns.append(which[equal])
        if not starts:
            return (np.zeros(0, np.int64),) * 3
        start = np.concatenate(starts)
        return start, start + np.concatenate(sizes), np.concatenate(patterns)

    def _equal(self, data: np.ndarray, where: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
        out, step, begin = np.zeros(len(where), bool), max(COMPARED // n, 1), self.text.bounds[which]
        piece = np.arange(n)
        for a in range(0, len(where), step):
            out[a : a + step] = (data[where[a : a + step, None] + piece] == self.text.data[begin[a : a + step, None] + piece]).all(1)
        return out


def inner(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of distinct stretches lie within another one."""
    order = np.lexsort((-end, start))
    reach = np.maximum.accumulate(end[order])
    out = np.zeros(len(start), bool)
    out[order[1:]] = reach[:-1] >= end[order[1:]]
    return out


def _any_mark(keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and whether any of their places has a mark."""
    both = np.sort(keys * 2 + marks)  # np.unique hashes, which takes many times as long for such keys
    both = both[_last_of_each(both >> 1)]
    return both >> 1, (both & 1).astype(bool)


def _spread(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of runs of the sizes, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


Block = tuple[Patterns, np.ndarray, pa.Table]


def block_of(rows: pa.Table) -> Block:
    """Distinct patterns of rows (old_text, …), where the rows of each begin, and the rows in the order of the patterns."""
    rows = rows.take(pc.sort_indices(rows["old_text"])).combine_chunks()
    texts = rows["old_text"].combine_chunks()
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    new = np.ones(len(texts), bool)
    if len(texts) > 1:
        new[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    return Patterns(texts.take(pa.array(first))), np.append(first, len(texts)), rows


def searched(lines: pa.Array, blocks: Iterable[Block], longest: bool, blanks: bool) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Numbers of lines, and the rows of the patterns that each contains."""
    if blanks:
        line, parts = np.arange(len(lines)), lines.dictionary_encode()
    else:
        cut = pc.split_pattern(lines, " ")
        line, parts = pc.list_parent_indices(cut).to_numpy(), cut.flatten().dictionary_encode()
    part, texts = parts.indices.to_numpy(), Hashed(parts.dictionary)
    found, rows, bounds, n = [], [], [], 0
    for patterns, first, table in blocks:
        start, end, pattern = patterns.found(texts)
        own = np.sort(pattern)
        own = own[_last_of_each(own)]
        pattern = np.searchsorted(own, pattern)
        found.append((start, end, pattern + n))
        sizes = first[own + 1] - first[own]
        rows.append(table.take(pa.array(_spread(sizes, first[own]))))  # only what was found of a block is kept
        bounds.append(sizes)
        n += len(own)
    if not n:
        return
    start, end, pattern = (np.concatenate(x) for x in zip(*found, strict=True))
    holder = np.searchsorted(texts.bounds, start, side="right") - 1
    within = inner(start, end) if longest else np.zeros(len(start), bool)
    keys, marked = _any_mark(holder * n + pattern, within)  # of a part each pattern once
    holder, pattern = np.divmod(keys, n)
    begins = np.searchsorted(holder, np.arange(len(texts.sizes) + 1))
    sizes = begins[part + 1] - begins[part]
    at = _spread(sizes, begins[part])
    keys, marked = _any_mark(np.repeat(line, sizes) * n + pattern[at], marked[at])
    line, pattern = np.divmod(keys[~marked], n)  # a pattern that lies in another one anywhere on a line goes from it
    sizes = np.concatenate(bounds)
    first = np.cumsum(sizes) - sizes
    yield np.repeat(line, sizes[pattern]), pa.concat_tables(rows).take(pa.array(_spread(sizes[pattern], first[pattern])))


def hit_batches(batches: Iterable[pa.RecordBatch], blocks: Callable[[], Iterable[Block]], longest: bool, blanks: bool, names: list[str], columns: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The columns of each line (its last one is text) with those of the patterns in place of text, a row for each pattern found."""

    def rows(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
        texts = pc.fill_null(chunk["text"], "").combine_chunks()
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        for line, found in searched(texts, blocks(), longest, blanks):
            own = chunk.select(names).take(pa.array(line))
            for c in columns.names:
                own = own.append_column(c, found[c].cast(columns.field(c).type))
            yield from own.combine_chunks().to_batches()

    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(lengths):
            fit = int(np.searchsorted(np.cumsum(lengths[at:]), READ_CHARS - size, side="right"))
            to = at + max(fit, 0 if held else 1)
            held, size = [*held, batch.slice(at, to - at)], size + int(lengths[at:to].sum())
            if to < len(lengths):
                yield from rows(pa.Table.from_batches(held))
                held, size = [], 0
            at = to
    if held:
        yield from rows(pa.Table.from_batches(held))


def match_batches(batches: Iterable[pa.RecordBatch], patterns: list[str], longest: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """hit_batches of a list of distinct patterns."""
    table = pa.table({"old_text": pa.array(patterns, pa.string())})
    block = [block_of(table)]
    return hit_batches(batches, lambda: block, longest, any(" " in p for p in patterns), names, table.schema)


def pattern_hits(lines: DataFrame, patterns: DataFrame, longest: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The columns of lines (…, text) but for text, and old_text: a row for each pattern (old_text) that a line contains.

    longest leaves out patterns that lie in another one that the same line contains.  Null and empty patterns, and such with a line end, are in no line; repeated
    patterns count once, repeated lines each.  Patterns are read in blocks of bounded size; lines are never shuffled.
    """
    return mapping_hits(lines, patterns.select("old_text").distinct(), longest, block_chars)


def mapping_hits(lines: DataFrame, mappings: DataFrame, longest: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """pattern_hits with the other columns of mappings (old_text, …): a row for each mapping of a pattern that a line contains."""
    from pyarrow import fs, parquet
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [c for c in lines.columns if c != "text"]
    rest = [c for c in mappings.columns if c != "old_text"]
    mappings = mappings.select("old_text", *[f"`{c}`" for c in rest]).where("old_text <> '' and not contains(old_text, '\n')")
    size = F.coalesce(F.sum(F.length(F.to_json(F.struct("*"))) if rest else F.length("old_text")), F.lit(0))
    chars, blanks = mappings.agg(size, F.coalesce(F.max(F.contains("old_text", F.lit(" "))), F.lit(False))).first()
    count = -(-chars // block_chars) or 1
    folder = f"{checkpoint_folder(lines.sparkSession)}/patterns-{uuid.uuid4().hex}"
    mappings.withColumn("_block", F.pmod(F.xxhash64("old_text"), F.lit(count))).repartition("_block").write.partitionBy("_block").parquet(folder)
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for df, own in ((lines, names), (mappings, mappings.columns)) for c in own])
    columns = to_arrow_schema(mappings.schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else "file://" + folder.removeprefix("file:"))

        def blocks() -> Iterator[Block]:
            for at in store.get_file_info(fs.FileSelector(base)):
                if at.base_name.startswith("_block="):
                    files = [f.path for f in store.get_file_info(fs.FileSelector(at.path)) if f.base_name.endswith(".parquet")]
                    yield block_of(pa.concat_tables([parquet.read_table(store.open_input_file(f)) for f in files]))

        one = list(blocks()) if count == 1 else None
        yield from hit_batches(batches, (lambda: one) if count == 1 else blocks, longest, blanks, names, columns)

    return lines.select(*[f"`{c}`" for c in names], "text").mapInArrow(read, schema)
