"""Fill-in-the-middle transformation (operator 12).

A text is cut into units, runs of ASCII letters or single other characters, by one fullmatch of (unit)*:
the regex library keeps every repetition of the group, so the ends of its captures say how many units
there are and where each ends.  Two hashes of the document's id choose two ends; prefix, middle and suffix lie
before, between and behind them.  A third hash leaves some documents plain, a fourth chooses the order:
psm is `<P>`prefix`<S>`suffix`<M>`middle, spm is `<S>`suffix`<P>`prefix`<M>`middle.

Marks do not occur in a text that is cut, and no mark overlaps another, so the first occurrence of each gives the parts back.

Results for odd input: a null text counts as empty and stays plain; rows without an id are left out;
repeated rows are transformed row by row, in the same way, as only id and text decide; texts that hold a mark stay plain;
an empty table gives no rows.  A text is matched whole in one task; its ends take some 50 bytes a unit meanwhile.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redraft.llm.textblocks import keyed

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Of a hundred documents so many stay plain, and of a hundred others so many are spm.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@lru_cache(maxsize=4)
def repeated(unit: str):
    """The pattern that matches a text as repetitions of a unit, each of which stays as a capture; possessive, as no unit is ever given back."""
    import regex

    return regex.compile(f"({unit})*+").fullmatch


def hashes(doc_id: int, seed: int = 1) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 that an id stands for."""
    digits = sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(digits[i : i + 8], 16) for i in range(0, 32, 8))


def cut(text: str, doc_id: int, unit: str = UNIT, seed: int = 1, plain: int = PLAIN_PERCENT, spm: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    ends = repeated(unit)(text).ends(1)
    n, (h1, h2, h3, h4) = len(ends), hashes(doc_id, seed)
    if not n or h3 % 100 >= 100 - plain or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[a - 1] if a else 0, ends[b - 1] if b else 0
    before, middle, after = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{middle}"


def cut_batches(batches: Iterable[pa.RecordBatch], **options) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            ids, texts = (batch[c].slice(at, 256).to_pylist() for c in ("doc_id", "text"))
            made = [(i, *cut(t, i, **options)) for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = UNIT, seed: int = 1, plain: int = PLAIN_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """One row per row of docs that has an id: doc_id, n (units), form, prefix_chars and middle_chars (null if plain), output."""
    options = {"unit": unit, "seed": seed, "plain": plain, "spm": spm}
    return keyed(docs, id_col, text_col).mapInArrow(lambda it: cut_batches(it, **options), SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of."""
    between = lambda start, end: F.substring(output, start, end - start)
    p, s, m = (F.locate(mark, output) for mark in (PREFIX, SUFFIX, MIDDLE))
    size = len(PREFIX)
    middle = F.substring(output, m + size, F.length(output))
    psm = F.concat(between(p + size, s), middle, between(s + size, m))
    spm = F.concat(between(p + size, m), middle, between(s + size, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def infill_digests(docs: DataFrame) -> DataFrame:
    """fill_in_middle with digests in place of the output: of itself and of the text restored from it."""
    made = fill_in_middle(docs)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
