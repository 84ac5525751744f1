"""Personal data by patterns and a semi-Markov conditional random field (operator 7).

The base finds, per kind, the leftmost non-overlapping matches of a pattern and
drops those that fail the kind's check.  The field then looks at every stretch
of text around digits and at signs.  A stretch is cut into tokens; candidate
segments are runs of at most MOST_TOKENS tokens that could be of a kind, scored for every kind by
features of the whole segment (shape, digits, checksum, separators, what stands
next to it).  Dynamic programming over segments of bounded length picks
boundaries and kinds together, so it finds what a greedy pattern spoils: a card
after another number, a phone number that runs into one.  Spans of the field
that touch no base span are added; base spans stay.

It is fitted on the stretches of all documents, whose labels are the base spans.
A stretch falls into blocks where no segment crosses, and the likelihood into
theirs; Spark counts equal blocks (places, features and label of each segment,
no text) over the whole corpus, and the fit takes the TRAIN_BLOCKS most frequent
ones, of at most MOST_SEGMENTS segments each, so that what is collected is bounded.
Weights have a normal prior about PRIOR: decimals, dates, bare digit runs and numbers without a plus that are not grouped
like a phone number are rare beside personal data in some corpora, so what they count against a
phone number is said beforehand, and the documents may prove it wrong.

Results for odd input: null and empty texts have no spans; rows with a null id
and repeated rows are handled row by row; overlapping kinds are all reported; an
empty table gives no rows, and without training text nothing is added.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redraft.llm import textblocks as tb
from redraft.llm.bpe import documents

KINDS = ("email", "ip", "card", "phone")
#: Distinct blocks that the field is fitted on, the most frequent first, and segments of the largest of them.
TRAIN_BLOCKS, MOST_SEGMENTS = 20_000, 400
MOST_TOKENS = 14
#: Characters before and after a digit or at sign that belong to its stretch, up to a blank.
AROUND = 24
_STEPS, _RATE, _PENALTY = 120, 0.2, 2e-4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\W\d_]+|\s+|.", re.DOTALL)
_DIGITS = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")  # before int, which refuses thousands of digits
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part and domain, found from their at signs, so that long words without one cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Base matches of all kinds by start, then kind."""
    if not _MARK.search(text):
        return []
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_at_most_255(p) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found)


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Parts of the text around digits and at signs; parts that meet are one."""
    start = end = -1
    for m in _MARK.finditer(text):
        a, b = m.start(), m.end()
        if b <= end - AROUND:
            continue
        near = max(0, a - AROUND)
        left = max(text.rfind(" ", near, a), text.rfind("\n", near, a), a - AROUND) + 1
        right = min([x for x in (text.find(" ", b, b + AROUND), text.find("\n", b, b + AROUND)) if x >= 0] + [b + AROUND, len(text)])
        left, right = max(0, min(left, a) - 1), min(len(text), right + 1)
        if left <= end:
            end = max(end, right)
        else:
            if end >= 0:
                yield start, end
            start, end = left, right
    if end >= 0:
        yield start, end


def tokens(part: str) -> list[int]:
    """Bounds of the tokens of a stretch."""
    return [0, *(m.end() for m in _TOKEN.finditer(part))]


_CARD_SHAPE = re.compile(r"[0-9]([\x20-]?[0-9])*\Z")
_EVEN_CARD = re.compile(r"[0-9]{12,19}\Z|([0-9]{4}[\x20-]){3}[0-9]{1,7}\Z|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}\Z")
_PHONE_SHAPE = re.compile(r"\+?[0-9(][\x20().0-9-]+[0-9]\Z")
_GROUPED_PHONE = re.compile(r"(\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}\Z")
_EMAIL_SHAPE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+\Z")
_IP_SHAPE = re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}\Z")
_DECIMAL = re.compile(r"[0-9]+\.[0-9]+\Z")
_DATE = re.compile(r"([0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4})(?![0-9])")
_BARE = re.compile(r"[0-9]+\Z")
N_FEATURES = 28
#: Means of the weights before any text is seen: nothing is a span, and least so what the last features tell, for phone numbers.
PRIOR = np.zeros((len(KINDS), N_FEATURES))
PRIOR[:, 0] = -2
PRIOR[3, 24:28] = -10
#: What a segment must have to be of a kind at all: an address shape, four parts up to 255, a valid checksum, nine to 15 digits.
REQUIRED = (3, 4, 7, 12)


_SHAPE = str.maketrans("123456789", "000000000")


def _kind_of(c: str) -> str:
    """What counts about a character next to a segment."""
    return "0" if c in "0123456789" else "a" if c.isalpha() else c


def features(s: str, before: str, after: str, n_tokens: int) -> list[int]:
    """Features of a whole segment and of the characters next to it, as the numbers of those that hold.  Digits count by their shape, but for checksum and size of parts, so equal shapes are looked up."""
    shape = s.translate(_SHAPE)
    check = 12 <= shape.count("0") <= 19 and luhn(_digits(s))
    small = shape.count(".") == 3 and bool(_IP_SHAPE.match(s)) and all(_at_most_255(p) for p in s.split("."))
    return shape_features(shape, check, small, _kind_of(before), _kind_of(after), n_tokens == 1)


@lru_cache(maxsize=100_000)
def shape_features(s: str, check: bool, small: bool, before: str, after: str, single: bool) -> list[int]:
    out = [0]
    n = s.count("0")
    if "@" in s:
        out.append(1 if s.count("@") == 1 else 2)
        if _EMAIL_SHAPE.match(s):
            out.append(3)
    if _IP_SHAPE.match(s):
        out.append(4 if small else 5)
    if n and _CARD_SHAPE.match(s):
        out.append(6)
        if 12 <= n <= 19:
            out.append(7 if check else 8)
            if _EVEN_CARD.match(s):
                out.append(9)
    if n and _PHONE_SHAPE.match(s):
        out.append(10)
        if s[0] == "+":
            out.append(11)
        if 9 <= n <= 15:
            out.append(12)
        if _GROUPED_PHONE.match(s):
            out.append(13)
        if s[0] != "+" and not _GROUPED_PHONE.match(s):
            out.append(27)
    if n < 7:
        out.append(14)
    if s[0].isspace() or s[-1].isspace():
        out.append(15)
    if before == "0":
        out.append(16)
    if after == "0":
        out.append(17)
    if before.isalpha() or before in "_%+-@":
        out.append(18)
    if after.isalpha() or after in "_@":
        out.append(19)
    if n == 0 and "@" not in s:
        out.append(20)
    if single:
        out.append(21)
    if before in ".-":
        out.append(22)
    if after in ".-":
        out.append(23)
    if _DECIMAL.match(s):
        out.append(24)
    if _DATE.match(s):
        out.append(25)
    if _BARE.match(s):
        out.append(26)
    return out


def candidates(part: str, before: str = " ", after: str = " ") -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """Token bounds of a stretch, and its segments (first token, end token, features): those that start at a letter, a digit or one of + and (, end at a letter or digit, and could be of a kind: with an at sign, or without letters and with nine to 19 digits or four parts between three dots."""
    at = tokens(part)
    n = len(at) - 1
    digits, letters, signs, dots = [0], [0], [0], [0]
    solid, opens = [], []
    for i in range(n):
        c, size = part[at[i]], at[i + 1] - at[i]
        digit = c in "0123456789"
        digits.append(digits[-1] + size * digit)
        letters.append(letters[-1] + (c.isalnum() and not digit))
        signs.append(signs[-1] + (c == "@"))
        dots.append(dots[-1] + (c == "."))
        solid.append(c.isalnum())
        opens.append(solid[i] or c in "+(")
    out = []
    for i in range(n):
        if not opens[i]:
            continue
        for j in range(i + 1, min(n, i + MOST_TOKENS) + 1):
            if solid[j - 1] and (signs[j] > signs[i] or letters[j] == letters[i] and (9 <= digits[j] - digits[i] <= 19 or j - i == 7 and dots[j] - dots[i] == 3)):
                s = part[at[i] : at[j]]
                left = part[at[i] - 1] if i else before
                right = part[at[j]] if j < n else after
                out.append((i, j, features(s, left or " ", right or " ", j - i)))
    return at, out


def decode(part: str, weights: np.ndarray, before: str = " ", after: str = " ") -> list[Span]:
    """Best cut of a stretch into segments of a kind and tokens outside (score 0), as spans in the stretch."""
    at, segments = candidates(part, before, after)
    if not segments:
        return []
    n = len(at) - 1
    best, how = [0.0] * (n + 1), [None] * (n + 1)
    by_end: dict[int, list] = {}
    known: dict[tuple[int, ...], tuple[float, int]] = {}  # the best kind of segments with the same features
    for i, j, f in segments:
        key = tuple(f)
        if key not in known:
            score = weights[:, f].sum(axis=1)
            known[key] = max(((float(score[k]), -k) for k, must in enumerate(REQUIRED) if must in f), default=(0.0, 0))
        score, k = known[key]
        if score > 0:
            by_end.setdefault(j, []).append((i, -k, score))
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, k, score in by_end.get(j, ()):
            if best[i] + score > best[j]:
                best[j], how[j] = best[i] + score, (i, k)
    out, j = [], n
    while j > 0:
        if how[j] is None:
            j -= 1
        else:
            i, k = how[j]
            out.append((at[i], k, at[j]))
            j = i
    return out[::-1]


def find_spans(text: str, weights: np.ndarray | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that the field adds."""
    base = base_spans(text)
    if weights is None or not _MARK.search(text):
        return base, []
    added, taken = [], sorted((a, b) for a, _, b in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for a, b in stretches(text):
        for s, k, e in decode(text[a:b], weights, text[a - 1 : a] or " ", text[b : b + 1] or " "):
            s, e = s + a, e + a
            before = bisect_left(starts, e)  # base spans that start before the end of this one
            if not before or reach[before - 1] <= s:
                added.append((s, k, e))
    return base, added


def blocks(part: str, spans: list[Span]) -> Iterator[bytes]:
    """Blocks of segments of a stretch that no segment links: rows of first place, end place, bits of features and kind (-1 for none), with places numbered within the block."""
    at, segments = candidates(part)
    of = {b: i for i, b in enumerate(at)}
    wanted = {(of[a], of[b]): k for a, k, b in spans if a in of and b in of}
    own, end = [], 0

    def block() -> bytes:
        place = {x: n for n, x in enumerate(sorted({x for i, j, _ in own for x in (i, j)}))}
        return np.array([(place[i], place[j], sum(1 << x for x in f), wanted.get((i, j), -1)) for i, j, f in own], "<i4").tobytes()

    for segment in segments:  # by their first places
        if own and segment[0] >= end:
            yield block()
            own = []
        own.append(segment)
        end = max(end, segment[1])
    if own:
        yield block()


class _Batch:
    """Blocks side by side: for each end and length of a segment, who has it and with which features."""

    def __init__(self, patterns: list[np.ndarray], counts: list[int]):
        every = np.concatenate(patterns)
        self.row = np.repeat(np.arange(len(patterns)), [len(x) for x in patterns])
        self.i, self.j, bits, self.gold = every.T.astype(np.int64)
        self.x = ((bits[:, None] >> np.arange(N_FEATURES)) & 1).astype(np.float64)
        self.sizes = np.array([x[:, 1].max() for x in patterns], np.int64)
        self.counts = np.array(counts, np.float64)

    def expectations(self, weights: np.ndarray) -> np.ndarray:
        """Posterior probability of every segment under every kind, by forward and backward sums over segments."""
        score = self.x @ weights.T
        width = int(self.sizes.max()) + 1
        forward = np.full((len(self.sizes), width), -np.inf)
        forward[:, 0] = 0
        whole = np.logaddexp.reduce(score, axis=1)
        for j in range(1, width):
            forward[:, j] = forward[:, j - 1]
            pick = self.by_end[j]
            np.logaddexp.at(forward[:, j], self.row[pick], forward[self.row[pick], self.i[pick]] + whole[pick])
        backward = np.full((len(self.sizes), width), -np.inf)
        for i in range(width - 1, -1, -1):
            if i + 1 < width:
                backward[:, i] = backward[:, i + 1]
            backward[self.sizes == i, i] = 0
            pick = self.by_start[i]
            np.logaddexp.at(backward[:, i], self.row[pick], backward[self.row[pick], self.j[pick]] + whole[pick])
        total = forward[np.arange(len(self.sizes)), self.sizes]
        log = (forward[self.row, self.i] + backward[self.row, self.j] - total[self.row])[:, None] + score
        return np.exp(np.minimum(log, 0))

    def index(self) -> _Batch:
        width = int(self.sizes.max()) + 1
        self.by_end = [np.flatnonzero(self.j == j) for j in range(width)]
        self.by_start = [np.flatnonzero(self.i == i) for i in range(width)]
        return self


def fit(patterns: list[tuple[bytes, int]]) -> np.ndarray | None:
    """Weights (kind x feature) from blocks and how often each occurs."""
    rows = [np.frombuffer(p, "<i4").reshape(-1, 4) for p, _ in patterns]
    if not any((x[:, 3] >= 0).any() for x in rows):
        return None
    batch = _Batch(rows, [n for _, n in patterns]).index()
    share = (batch.counts / batch.counts.sum())[batch.row][:, None]
    gold = np.zeros((len(batch.gold), len(KINDS)))
    gold[np.arange(len(gold))[batch.gold >= 0], batch.gold[batch.gold >= 0]] = 1
    weights = PRIOR.copy()
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, _STEPS + 1):
        grad = ((gold - batch.expectations(weights)) * share).T @ batch.x - _PENALTY * (weights - PRIOR)
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        weights = weights + _RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return weights


def count_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = Counter()
        for text in batch["text"].to_pylist():
            spans = base_spans(text or "")
            starts = [s for s, _, _ in spans]
            for a, b in stretches(text or ""):
                own = blocks(text[a:b], [(s - a, k, e - a) for s, k, e in spans[bisect_left(starts, a) : bisect_left(starts, b)] if e <= b])
                found.update(x for x in own if len(x) <= 16 * MOST_SEGMENTS)
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray | None:
    texts = documents(docs, id_col, text_col).where(F.col("text").rlike("[0-9@]"))
    counts = texts.select("text").mapInArrow(count_blocks, "block binary, n long").groupBy("block").agg(F.sum("n").alias("n"))
    most = counts.orderBy(F.desc("n"), "block").limit(TRAIN_BLOCKS)
    return fit(sorted((bytes(r["block"]), r["n"]) for r in most.collect()))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): array of (kind, start, end, base) by start and kind, in code points with the end exclusive; base tells the pattern's spans from the field's."""
    weights = train(docs, id_col, text_col)
    rows = documents(docs, id_col, text_col)
    kind_of_id = rows.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches):
        for batch in batches:
            out = []
            for text in batch["text"].to_pylist():
                base, added = find_spans(text or "", weights)
                out.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in sorted([*((*s, True) for s in base), *((*s, False) for s in added)])])
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "spans": pa.array(out, pa.list_(span))})

    return rows.mapInArrow(run, f"doc_id {kind_of_id}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def span_digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans of personal_data, and all spans as text."""
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
