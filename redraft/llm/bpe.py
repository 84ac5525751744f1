"""Byte-level BPE encoding and decoding (operator 10).

The tokenizers library does the merges.  A rank file says that two neighbours
merge when their joined bytes are a token, the lowest rank first; the model
therefore gets *every* split of a token into two tokens as a merge, in rank
order, shorter left parts first.  A batch is cut into the matches of the
pattern, only matches not met before go to the library, and a document's ids
are the joined ids of its matches.

Results for odd input: a null or empty text has no ids, no offsets and decodes
to no bytes; rows with a null id, repeated rows and repeated ids are encoded
row by row; an empty table gives an empty table.  Other columns are left out.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redraft.llm.textblocks import runs, small_batches

#: Matches kept with their ids in a task; beyond that they are encoded anew.
CACHE_PIECES = 400_000
RANKS = "byte_bpe_multi_50k.tiktoken"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


class Codec:
    """Encoder and decoder of one rank file, for use in one task."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        chars = byte_characters()
        shown = {t: "".join([chars[b] for b in t]) for t in ranks}
        merges = [(shown[t[:i]], shown[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.model = Tokenizer(models.BPE(vocab={s: ranks[t] for t, s in shown.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.size_of = np.zeros(max(self.bytes_of, default=0) + 1, np.int64)
        for i, t in self.bytes_of.items():
            self.size_of[i] = len(t)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian 32-bit integers."""
        out: list[bytes] = []
        for text in texts:
            parts = self.split(text)
            new = list(set(parts).difference(self.known))
            if new:
                if len(self.known) + len(new) > CACHE_PIECES:
                    self.known.clear()
                    new = list(set(parts))
                for part, found in zip(new, self.model.encode_batch_fast(new, add_special_tokens=False), strict=True):
                    self.known[part] = np.array(found.ids, "<u4").tobytes()
            out.append(b"".join(map(self.known.__getitem__, parts)))
        return out

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end (exclusive) of every token; tokens that share a split character all cover it."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        at = runs(self.size_of[ids])
        return char[at[:-1]], char[at[1:] - 1] + 1

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens; ids that are not in the vocabulary have none."""
        return b"".join([self.bytes_of.get(i, b"") for i in ids.tolist()])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(runs(np.array([len(x) for x in parts], np.int64)), pa.int32()), pa.array(flat, kind))


def encode_batches(batches: Iterable[pa.RecordBatch], path: str, pattern: str, offsets: bool) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text) to batches of (doc_id, ids[, starts, ends])."""
    c = codec(path, pattern)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [t or "" for t in part["text"].to_pylist()]
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in c.ids(texts)]
            columns = {"doc_id": part["doc_id"], "ids": _lists(ids, pa.int32())}
            if offsets:
                spans = [c.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
                columns |= {"starts": _lists([s for s, _ in spans], pa.int32()), "ends": _lists([e for _, e in spans], pa.int32())}
            yield pa.RecordBatch.from_pydict(columns)


def decode_batches(batches: Iterable[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Adds column decoded (binary) to batches that have a list column ids; null lists count as empty."""
    c = codec(path, pattern)
    for batch in batches:
        lists = batch["ids"]
        values = lists.values.to_numpy(zero_copy_only=False)
        ends = lists.offsets.to_numpy()
        decoded = [c.decode(values[a:b]) if ok else b"" for a, b, ok in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    small_batches(df.sparkSession, 1000)
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, starts array<int>, ends array<int>): token ids and the characters that each token covers."""
    import public_tokenizers

    path, pattern = path or default_path(), pattern or public_tokenizers.PATTERN
    docs = documents(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lambda it: encode_batches(it, path, pattern, True), f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, errors: str = "replace") -> DataFrame:
    """(doc_id, decoded binary, text string): the bytes of the tokens, and their text.  A character of which only some bytes are there becomes U+FFFD (errors="replace") or goes (errors="ignore")."""
    import public_tokenizers

    path, pattern = path or default_path(), public_tokenizers.PATTERN
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in decode_batches(batches, path, pattern):
            text = [x.decode("utf-8", errors) for x in b["decoded"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "decoded": b["decoded"], "text": pa.array(text, pa.string())})

    return rows.mapInArrow(run, f"doc_id {kind}, decoded binary, text string")


def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, ids, decoded) to the digests of ids and bytes."""
    from hashlib import sha256

    for batch in batches:
        lists = batch["ids"]
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        ends = lists.offsets.to_numpy()
        ids = [sha256(values[a:b].tobytes()).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        text = [sha256(x).hexdigest() for x in batch["decoded"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_tokens": pa.array(np.diff(ends).astype(np.int64)), "ids_sha256": ids, "decoded_sha256": text})


def round_trip_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of df: n_tokens and the digests of its ids and of the bytes decoded from them.  Encoding, decoding and digests of a batch follow one another in one task, so ids never leave it."""
    import public_tokenizers

    path, pattern = path or default_path(), public_tokenizers.PATTERN
    docs = documents(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lambda it: digests(decode_batches(encode_batches(it, path, pattern, False), path, pattern)), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of df with the tokens themselves: doc_id, ids, n_tokens, ids_sha256, decoded_sha256 (of the bytes that the ids decode to)."""
    import public_tokenizers

    path, pattern = path or default_path(), public_tokenizers.PATTERN
    docs = documents(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in decode_batches(encode_batches(batches, path, pattern, False), path, pattern):
            for told in digests([batch]):
                yield pa.RecordBatch.from_arrays([told["doc_id"], batch["ids"], *told.columns[1:]], ["doc_id", "ids", *told.schema.names[1:]])

    return docs.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
