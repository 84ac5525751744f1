"""Document quality by a linear-chain conditional random field over lines (operator 6).

Every line is labelled good or bad.  A line's evidence is linear in its own
features and those of the lines before and after it; neighbouring labels are
tied by transition weights.  Forward-backward gives each line's probability of
being good; a document's quality is their mean, weighted by length in bytes and
mapped by a two-parameter logistic curve fitted on the training documents.

The field is fitted on at most TRAIN_DOCUMENTS labelled documents, those with the
smallest hash of their id, of which those that bring the lines beyond TRAIN_LINES, or
more than TRAIN_LINES / 20 lines of their own, are left out.  Their lines all take
the document's label.  A task fits the field on these bounded rows, so that only its
weights reach the driver.  Only texts are looked at for a score.

Results for odd input: a null or empty text is one empty line; rows without an id
are left out; repeated rows are scored row by row; labels that are null are not
learned from, of an id labelled twice the larger label counts; without any labels
every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redraft.llm import textblocks as tb

#: Bounds of the training sample, in documents and in lines.
TRAIN_DOCUMENTS = 4000
TRAIN_LINES = 200_000
THRESHOLD = 0.3
_STEPS, _RATE, _PENALTY = 200, 0.05, 1e-3

_CLASSES = {
    "upper": [(65, 91)],
    "lower": [(97, 123)],
    "digit": [(48, 58)],
    "symbol": [(35, 39), (42, 43), (60, 63), (64, 65), (94, 95), (126, 127)],
    "bar": [(124, 125)],
    "bang": [(33, 34)],
    "stop": [(44, 45), (46, 47), (58, 60), (63, 64)],
    "high": [(128, 256)],
    "lead": [(192, 256)],
}


def _table(spans: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, np.int64)
    for a, b in spans:
        out[a:b] = 1
    return out


_TABLES = {k: _table(v) for k, v in _CLASSES.items()}
N_BASE = 15
N_FEATURES = 3 * N_BASE + 3


def lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line (line feeds left out), and lines before each document; an empty text is one empty line."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((bounds[:-1], feeds + 1)), kind="stable")
    ends = np.sort(np.concatenate((bounds[1:], feeds)), kind="stable")
    doc = np.concatenate((np.arange(len(bounds) - 1), np.searchsorted(bounds, feeds, side="right") - 1))
    return starts, ends, tb.runs(np.bincount(doc, minlength=len(bounds) - 1))


def line_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base features of every line, its length in bytes, and lines before each document."""
    starts, ends, first = lines(data, bounds)
    n = (ends - starts).astype(np.float64)

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=sums[1:], dtype=np.int32)
        return (sums[ends] - sums[starts]).astype(np.float64)

    c = {k: count(t) for k, t in _TABLES.items()}
    ws, we, _ = tb.words(data, bounds)
    h = tb.word_hashes(data, ws, we)
    line = np.searchsorted(starts, ws, side="right") - 1
    # several empty lines may start where a word does: the last of them holds it
    words = np.bincount(line, minlength=len(starts)).astype(np.float64)
    per = lambda flags: np.bincount(line, weights=flags, minlength=len(starts)) / np.maximum(words, 1)
    again, second = np.zeros(len(h)), np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    second[2:] = (h[2:] == h[:-2]) & (line[2:] == line[:-2])
    letters = c["upper"] + c["lower"] + c["lead"]
    last = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(len(ends), np.uint8)
    whole = np.bincount(line, weights=(h >> np.uint64(40)).astype(np.float64), minlength=len(starts))
    repeated = np.zeros(len(starts))
    repeated[1:] = (whole[1:] == whole[:-1]) & (words[1:] == words[:-1]) & (words[1:] > 0)
    w, b = np.maximum(words, 1), np.maximum(n, 1)
    x = np.stack(
        [
            np.log1p(n) / 8,
            c["upper"] / np.maximum(letters, 1),
            c["digit"] / b,
            np.minimum(c["symbol"] / w, 3) / 3,
            np.minimum(c["bar"] / w, 1),
            np.minimum(c["stop"] / w, 2) / 2,
            c["high"] / b,
            (n - c["upper"] - c["lower"] - c["digit"] - c["high"]) / b,
            np.minimum((n - words) / w, 20) / 20,
            per(again),
            per(second),
            per((we - ws <= 3).astype(np.float64)),
            repeated,
            np.isin(last, [33, 46, 63]) & (n > 0),
            np.minimum(c["bang"] / w, 2) / 2,
        ],
        axis=1,
    )
    return x.astype(np.float32), n, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of each line, of the lines before and after it in its document (zero beyond), whether it is first or last, and one."""
    out = np.zeros((len(x), N_FEATURES), np.float32)
    out[:, :N_BASE] = x
    begins, ends = np.zeros(len(x), bool), np.zeros(len(x), bool)
    begins[first[:-1]] = True
    ends[first[1:] - 1] = True
    out[1:, N_BASE : 2 * N_BASE] = x[:-1]
    out[begins, N_BASE : 2 * N_BASE] = 0
    out[:-1, 2 * N_BASE : 3 * N_BASE] = x[1:]
    out[ends, 2 * N_BASE : 3 * N_BASE] = 0
    out[:, 3 * N_BASE], out[:, 3 * N_BASE + 1], out[:, 3 * N_BASE + 2] = begins, ends, 1
    return out


@dataclass
class Field:
    """Weights of the evidence for good, transition weights from bad and good to bad and good, and the curve of document scores."""

    weights: np.ndarray
    transitions: np.ndarray
    slope: float = 1.0
    shift: float = 0.0


def marginals(evidence: np.ndarray, first: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all documents at once: probability of good for each line, and expected transitions if asked for."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    at, size = first[:-1][order], n[order]
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(steps), side="left")  # documents with more lines than step
    local = np.stack([np.zeros_like(evidence), evidence], axis=1)
    local = np.exp(local - local.max(axis=1, keepdims=True))
    move = np.exp(transitions - transitions.max())
    alpha = np.zeros_like(local)
    beta = np.ones_like(local)
    for s in range(steps):
        i = at[: live[s]] + s
        a = local[i] if s == 0 else (alpha[i - 1] @ move) * local[i]
        alpha[i] = a / a.sum(axis=1, keepdims=True)
    for s in range(steps - 2, -1, -1):
        i = at[: live[s + 1]] + s
        b = (beta[i + 1] * local[i + 1]) @ move.T
        beta[i] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    expected = np.zeros((2, 2))
    if pairs and len(evidence):
        inner = np.ones(len(evidence), bool)
        inner[first[1:] - 1] = False
        i = np.flatnonzero(inner)
        joint = alpha[i][:, :, None] * move[None] * (local[i + 1] * beta[i + 1])[:, None, :]
        expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return p[:, 1], expected


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def document_means(p: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    weight = length + 1e-3  # so that empty lines decide where there is nothing else
    return np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]) if len(first) > 1 else np.zeros(0)


def fit(x: np.ndarray, length: np.ndarray, first: np.ndarray, label: np.ndarray) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam on all lines."""
    model = Field(np.zeros(N_FEATURES), np.zeros((2, 2)))
    if not len(label) or label.min() == label.max():
        return model
    x = with_neighbours(x, first)  # stays in single precision: it is the largest array here
    n = np.diff(first)
    y = np.repeat(label, n).astype(np.float64)
    seen = np.zeros((2, 2))
    seen[0, 0], seen[1, 1] = (n - 1)[label == 0].sum(), (n - 1)[label == 1].sum()
    theta = np.zeros(N_FEATURES + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, _STEPS + 1):
        p, expected = marginals((x @ theta[:N_FEATURES].astype(np.float32)).astype(np.float64), first, theta[N_FEATURES:].reshape(2, 2), True)
        grad = np.concatenate(((y - p).astype(np.float32) @ x, (seen - expected).ravel())) / len(y) - _PENALTY * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta += _RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    model.weights, model.transitions = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
    p, _ = marginals(x @ model.weights, first, model.transitions)
    z, a, b = _logit(document_means(p, length, first)), 1.0, 0.0
    for _ in range(100):  # Newton steps for the curve
        q = 1 / (1 + np.exp(-(a * z + b)))
        r = q * (1 - q) + 1e-9
        hessian = np.array([[(r * z * z).sum() + 1, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-3]])
        step = np.linalg.solve(hessian, [(z * (label - q)).sum() - (a - 1), (label - q).sum()])
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.shift = max(float(a), 1e-3), float(b)
    return model


def sample_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = tb.texts_of(batch["text"])
        x, n, first = line_features(data, bounds)
        rows = [(x[a:b].tobytes(), n[a:b].astype("<f4").tobytes(), b - a) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "x": pa.array([r[0] for r in rows], pa.binary()), "n": pa.array([r[1] for r in rows], pa.binary()), "lines": pa.array([r[2] for r in rows], pa.int64())})


def fit_rows(table: pa.Table) -> pa.Table:
    """The field of the rows (x, n, label, at) of the training sample, in the order of at."""
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    n = [np.frombuffer(r["n"], "<f4") for r in rows]
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, N_BASE) for r in rows])
    f = fit(x, np.concatenate(n).astype(np.float64), tb.runs(np.array([len(v) for v in n])), np.array([r["label"] for r in rows]))
    return pa.table({"weights": [f.weights.tolist()], "transitions": [f.transitions.ravel().tolist()], "slope": [float(f.slope)], "shift": [float(f.shift)]})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, most: int = TRAIN_DOCUMENTS, most_lines: int = TRAIN_LINES) -> Field:
    """The field fitted on at most `most` labelled documents of `most_lines` lines in all, with crc32(id) mod folds other than 0."""
    key = F.col("doc_id")
    usable = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    usable = usable.where(F.crc32(key.cast("string").cast("binary")) % folds != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # the bound makes it safe to broadcast
    texts = tb.keyed(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    found = texts.select("doc_id", "text").mapInArrow(sample_rows, "doc_id long, x binary, n binary, lines long").where(f"lines <= {most_lines // 20}")
    one = found.groupBy("doc_id").agg(F.min(F.struct("lines", "n", "x")).alias("r")).select("doc_id", "r.*", F.xxhash64("doc_id").alias("at"))
    so_far = Window.partitionBy(F.lit(0)).orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # at most `most` rows
    bounded = one.withColumn("so_far", F.sum("lines").over(so_far)).where(f"so_far <= {most_lines}").join(F.broadcast(chosen), "doc_id")
    fitted = bounded.select(F.lit(0).alias("sample"), "x", "n", "label", "at").groupBy("sample").applyInArrow(fit_rows, "weights array<double>, transitions array<double>, slope double, shift double").first()
    if fitted is None:
        return Field(np.zeros(N_FEATURES), np.zeros((2, 2)))
    return Field(np.array(fitted["weights"]), np.array(fitted["transitions"]).reshape(2, 2), fitted["slope"], fitted["shift"])


def score_texts(data: np.ndarray, bounds: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of each text, probability of good for each of its lines, and lines before each text."""
    parts = [line_features(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]) for a, b in tb.pieces(bounds)]
    if not parts:
        return np.zeros(0), np.zeros(0), np.zeros(1, np.int64)
    x, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    first = tb.runs(np.concatenate([np.diff(p[2]) for p in parts]))
    p, _ = marginals(with_neighbours(x, first) @ field.weights, first, field.transitions)
    return 1 / (1 + np.exp(-(field.slope * _logit(document_means(p, n, first)) + field.shift))), p, first


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    field = train(docs, labels, id_col, text_col, label_col, folds)
    tb.small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            score, _, _ = score_texts(*tb.texts_of(batch["text"]), field)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": pa.array(score)})

    scored = tb.keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def line_labels(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, good): for every row the probability of each of its lines of being good."""

    def run(batches):
        for batch in batches:
            _, p, first = score_texts(*tb.texts_of(batch["text"]), field)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "good": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(p))})

    return tb.keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, good array<double>")
