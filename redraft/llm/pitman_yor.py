"""Hierarchical Pitman-Yor language model of order three (operator 9).

A text's tokens are its words, A-Z in lower case, and one end.  The customers of a
pair restaurant (v, u) are the training tokens that follow the words v u; its parent
is the word restaurant (u), which all pairs ending in u share, and the parent of all
word restaurants is the root of single words, whose tables draw from a uniform base
of the vocabulary and one unknown word.  Every table is a customer of the parent.
Words are known by 48 bits of their hash; every context has a restaurant of its own.

Tokens go, packed, to key ranges of u (one shuffle, read twice), so that pair and word
restaurants have all their dishes in one task.  Words u that are more than an even key
range are dealt out by v; their word restaurants, and the root, are kept by owners of
words, at most OWNERS tasks, to whom the key ranges send numbers:
  1. count: customers of every restaurant and word; what the sampler needs of a key
     range, its dishes of two customers or more, is sent to itself once and read by
     every sweep;
  2. sample: Gibbs sweeps over the Chinese-restaurant seatings.  A dish's customers get up
     and sit down again together: their number of tables is drawn from its law given the
     tables of all other dishes.  The other dishes enter by a gamma variable of the
     restaurant, given which its dishes are independent, so all of them are drawn
     side by side; the parent enters by the chances that it gives one new customer
     after another.  First pairs, then words, then the root; numbers go from key ranges
     to owners and back between sweeps, and those of the last exchange hold within one;
  3. score: the kept samples give the predictive probability of every token; their mean is the model's.

Results for odd input: a null or empty text is one end; rows without an id are
left out; rows that repeat an id are added up as one text; an empty table gives
no rows; a table with no training text scores all tokens by the uniform base.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from redraft.llm import textblocks as tb

_LOW48 = np.uint64((1 << 48) - 1)
#: The word before the first of a text, and the one behind the last.
START = np.uint64(0xDCBA_9876_5432)
END = np.uint64(0x89AB_CDEF_0123)
#: Most tasks that keep the root and the restaurants of words that are dealt out.
OWNERS = 64
#: Bytes of text whose tokens are packed together, and how many frequent words lead those of a row.
PACK_BYTES, FEW = 36 << 20, 255
#: Customers up to which numbers of tables have their law from the recursion; beyond it, from the law that it approaches.
EXACT = 1024

_TOKENS = "shard int, ids binary, held binary, counts binary, words binary, places binary"
#: What key ranges and owners send each other.
_MAIL = "to int, kind int, shard int, data binary"
FIXED, ASK, TELL, SEATS, OWN, PLACES, HELD = range(7)
_BACK = "bucket int, train_tokens long, first long, numbers binary, sums binary"


@dataclass(frozen=True)
class Model:
    """Discounts and strengths of root, word and pair restaurants, sweeps before the first sample, samples, and the held-out remainder."""

    discounts: tuple[float, float, float] = (0.75, 0.75, 0.75)
    strengths: tuple[float, float, float] = (1.0, 1.0, 1.0)
    burn_in: int = 3
    samples: int = 3
    modulus: int = 7
    held_out: int = 2
    seed: int = 1


def held(doc_id: int, m: Model) -> bool:
    return zlib.crc32(str(doc_id).encode()) % m.modulus == m.held_out


# packing


_zip, _unzip = ZstdCompressor(level=1), ZstdDecompressor()


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on, in the least width each, all low bytes first."""
    out = []
    for a in map(np.asarray, arrays):
        kind = np.min_scalar_type(int(a.max()) if a.size else 0)
        flat = np.ascontiguousarray(a.astype(kind, copy=False).ravel())
        out.append((a.shape, kind.str, flat.view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()))
    return _zip.compress(pickle.dumps(out, 5))


def unpacked(b: bytes, wide: bool = True) -> list[np.ndarray]:
    def array(shape: tuple, kind: str, x: bytes) -> np.ndarray:
        a = np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(shape)
        return a.astype(np.int64) if wide else a

    return [array(*x) for x in pickle.loads(_unzip.decompress(b))]


def steps(a: np.ndarray) -> np.ndarray:
    """Rising numbers as differences, which pack well; np.cumsum gives them back."""
    return np.diff(a, prepend=0)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


# tokens


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and word hash of every token of a batch, and at which token each row begins."""
    data, bounds = tb.texts_of(batch["text"])
    rows, words = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a, b in tb.pieces(bounds):
        part, own = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        starts, ends, first = tb.words(part, own)
        n = np.diff(first)
        w = np.full(len(starts) + b - a, END, np.uint64)
        w[tb.ranges(tb.runs(n + 1)[:-1], n)] = tb.word_hashes(part, starts, ends) & _LOW48
        rows.append(np.repeat(np.arange(a, b), n + 1))
        words.append(w)
    row = np.concatenate(rows)
    return row, np.concatenate(words), np.searchsorted(row, np.arange(batch.num_rows))


def before(word: np.ndarray, begin: np.ndarray, start: int) -> np.ndarray:
    """The word before each token."""
    out = np.roll(word, 1)
    out[begin] = start
    return out


def heavy_rows(batches: Iterable[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """(word, n) of words before more than `share` of a batch's tokens, and the tokens of the batch as word null."""
    for batch in batches:
        _, w, begin = tokens(batch)
        u = before(w, begin, START)
        low = (u & np.uint64(0xFFFF)).astype(np.int64)
        word, n = np.unique(u[(np.bincount(low, minlength=1 << 16) > share * len(w))[low]], return_counts=True)
        often = n > share * len(w)
        yield pa.RecordBatch.from_pydict({"word": pa.array([*word[often].astype(np.int64).tolist(), None], pa.int64()), "n": pa.array([*n[often].tolist(), len(w)], pa.int64())})


def heavy_words(texts: DataFrame, shards: int) -> np.ndarray:
    """Words before more tokens than half an even key range holds: fewer than twice as many as ranges.  They steer only where tokens go."""
    share = 1 / (4 * shards)
    counts = texts.mapInArrow(lambda it: heavy_rows(it, share), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.where("word is null").select(F.col("n").alias("all"))
    rows = counts.where("word is not null").crossJoin(F.broadcast(total)).where(f"n * {2 * shards} > all").select("word").collect()
    return np.sort(np.array([r["word"] for r in rows], np.int64))


def gathered(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about `most` bytes of text: the more tokens are packed together, the less their words weigh."""
    held_back, size = [], 0
    for batch in batches:
        if held_back and size + batch.nbytes > most:
            yield pa.Table.from_batches(held_back).combine_chunks().to_batches()[0]
            held_back, size = [], 0
        if batch.num_rows:
            held_back.append(batch)
            size += batch.nbytes
    if held_back:
        yield pa.Table.from_batches(held_back).combine_chunks().to_batches()[0]


def pack_tokens(batches: Iterable[pa.RecordBatch], heavy: np.ndarray, keys: list[int], m: Model) -> Iterator[pa.RecordBatch]:
    """Tokens to key ranges: documents with their number of tokens, the distinct words of the row, the FEW most frequent first and the others in order, and the three words of each token as places among them.  keys are the numbers of the key ranges."""
    shards = len(keys)
    for batch in gathered(batches, PACK_BYTES):
        ids = batch["doc_id"].to_numpy()
        out = np.array([held(i, m) for i in ids.tolist()], bool)
        row, hashes, begin = tokens(batch)
        row = row.astype(np.int32)
        known, w = np.unique(np.append(hashes, START), return_inverse=True)
        start, w = int(w[-1]), w[:-1].astype(np.int32)
        del hashes
        u = before(w, begin, start)
        v = before(u, begin, start)
        shard = (tb.mix(known.copy()) % np.uint64(shards)).astype(np.int32)[u]
        spread = np.isin(known.astype(np.int64), heavy)[u]
        shard[spread] = (tb.mix(known[u[spread]] + known[v[spread]] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard.astype(np.int16) if shards < 1 << 15 else shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        often = np.zeros(len(known), bool)
        often[np.argsort(-np.bincount(w, minlength=len(known)), kind="stable")[:FEW]] = True
        seen, place = np.zeros(len(known), bool), np.zeros(len(known), np.int32)
        rows = []
        for s in range(shards):
            own = order[cuts[s] : cuts[s + 1]]
            if len(own):
                r = row[own]
                at = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                three = np.concatenate((u[own], v[own], w[own]))
                seen[three] = True
                used = np.flatnonzero(seen)
                seen[used] = False
                few, rest = used[often[used]], used[~often[used]]
                place[few], place[rest] = np.arange(len(few)), len(few) + np.arange(len(rest))
                words = packed(known[few].astype(np.int64), steps(known[rest].astype(np.int64)))
                rows.append((keys[s], _zip.compress(ids[r[at]].tobytes()), out[r[at]].tobytes(), packed(np.diff(np.append(at, len(r)))), words, packed(*np.split(place[three], 3))))
        yield _batch(rows, ["shard", "ids", "held", "counts", "words", "places"], [pa.int32(), *[pa.binary()] * 5])


class Seats:
    """The restaurants of one key range.

    Leaves are distinct (v, u, w), dishes of pair restaurants; mids are distinct (u, w), dishes of word restaurants; both in
    order of (u, w, v).  Open ones have two training customers or more, so their tables are not given.
    """

    def __init__(self, table: pa.Table, heavy: np.ndarray):
        self.ids = np.concatenate([np.frombuffer(_unzip.decompress(x), "<i8") for x in table["ids"].to_pylist()])
        self.counts = np.concatenate([unpacked(x)[0] for x in table["counts"].to_pylist()])
        trained = np.repeat(np.frombuffer(b"".join(table["held"].to_pylist()), "u1") == 0, self.counts)
        own = [np.concatenate((few, np.cumsum(rest))) for few, rest in map(unpacked, table["words"].to_pylist())]
        self.words = np.unique(np.concatenate(own))
        n = len(self.words)
        parts: list[list] = [[], [], []]
        for k, x in zip(own, table["places"].to_pylist(), strict=True):
            at = np.searchsorted(self.words, k).astype(np.int32)
            for part, i in zip(parts, unpacked(x, wide=False), strict=True):
                part.append(at[i])
        u, v, w = (np.concatenate(x) for x in parts)
        del parts
        used = np.zeros(n, bool)
        used[u] = True
        at = np.cumsum(used) - 1
        key = (at[u] * n + w) * n + v if int(at[-1] + 1) * n * n < 1 << 62 else None
        if key is None:  # too many words for one number
            _, mid = np.unique(u.astype(np.int64) * n + w, return_inverse=True)
            key = mid * n + v
        order = np.argsort(key)
        key = key[order]
        new = np.diff(key, prepend=-1) != 0
        self.leaf = np.empty(len(key), np.int32)  # of each token
        self.leaf[order] = np.cumsum(new) - 1
        first = order[new]
        self.c = np.bincount(self.leaf, weights=trained, minlength=len(first)).astype(np.int32)
        leaf_u, leaf_v, leaf_w = (x[first] for x in (u, v, w))
        del key, order, new, u, v, w, trained
        new = (np.diff(leaf_u, prepend=-1) != 0) | (np.diff(leaf_w, prepend=-1) != 0)
        self.mid = (np.cumsum(new) - 1).astype(np.int32)  # of each leaf
        self.u, self.w = leaf_u[new].astype(np.int64), leaf_w[new].astype(np.int64)  # of each mid
        self.pair = np.unique(leaf_u.astype(np.int64) * n + leaf_v, return_inverse=True)[1].astype(np.int32)  # restaurant of each leaf
        place = np.minimum(np.searchsorted(heavy, self.words), max(len(heavy) - 1, 0))
        self.dealt = (np.where(heavy[place] == self.words, place + 1, 0) if len(heavy) else np.zeros(n, np.int64))[self.u]  # 0, or the number of a word restaurant that owners keep, of each mid
        self.customers = self.per_mid(self.c)
        self.open = np.flatnonzero(self.c > 1)
        self.open_mid = np.flatnonzero((self.customers > 1) & (self.dealt == 0))
        # what owners are asked for: each word, and each dish of a word restaurant that they keep
        h = len(heavy) + 1
        keys = np.unique(np.concatenate((self.w * h, (self.w * h + self.dealt)[self.dealt > 0])))
        self.key_word, self.key_dealt = np.divmod(keys, h)
        self.root_key, self.mid_key = (np.searchsorted(keys, self.w * h + x).astype(np.int32) for x in (0, self.dealt))

    def per_mid(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.mid, weights=x, minlength=len(self.u)).astype(np.int64)

    def per_key(self, key: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bincount(key, weights=x, minlength=len(self.key_word)).astype(np.int64)


# numbers of tables


@lru_cache(maxsize=4)
def _recursion(d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: ways (weighted by discount d) to seat c customers at t tables, at [c, t - 1]."""
    out = np.full((EXACT + 1, EXACT), -np.inf)
    out[1, 0] = 0
    t = np.arange(1, EXACT + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, EXACT):
            stay = np.log(np.maximum(c - d * t, 0)) + out[c]
            stay[c:] = -np.inf
            out[c + 1, 1:] = np.logaddexp(stay[1:], out[c, :-1])
            out[c + 1, 0] = stay[0]
    return out


def log_ways(c: int, most: int, d: float) -> np.ndarray:
    """Logarithms, but for a constant, of the ways to seat c customers at 1, 2 … most tables.

    Tables' sizes are as independent heavy-tailed variables whose sum is c, so beyond EXACT customers the law has the shape
    of the one at EXACT with the number of tables scaled by the power d of the customers (it has approached a stable law).
    """
    ways = _recursion(d)
    if c <= EXACT:
        return ways[c, :most]
    t = np.arange(1, most + 1)
    size = np.cumsum(np.log(np.arange(1, max(most, EXACT) + 1)))  # logarithms of the factorials
    line = np.arange(1, EXACT + 1)
    law = ways[EXACT] + size[:EXACT] + line * np.log(d)
    at = t * (EXACT / c) ** d
    found = np.where(at >= 1, np.interp(at, line, law, right=-np.inf), law[0] + np.log(at))
    return found - size[:most] - t * np.log(d)


def draw(c: np.ndarray, log_new: np.ndarray, parent: tuple[np.ndarray, ...], d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish with c customers: t with the weight ways(c, t) · new^t · the chances that its parent serves the dish t times in a row.

    parent: customers and tables of the dish there without its own, mass of new tables that serve it, customers in all without its
    own plus strength, and the discount; each more customer of the parent counts for the next.
    """
    out = np.minimum(c, 1).astype(np.int64)
    order = np.argsort(c, kind="stable")
    order = order[np.searchsorted(c[order], 2) :]
    cuts = np.append(np.flatnonzero(np.diff(c[order], prepend=0) > 0), len(order)).tolist()
    a, tau, mass, total, dp = parent
    for first, end in pairwise(cuts):
        n = int(c[order[first]])
        todo = [(order[k : min(k + max(1, 500_000 // min(n, 64)), end)], min(n, 64)) for k in range(first, end, max(1, 500_000 // min(n, 64)))]
        while todo:
            own, most = todo.pop()
            j = np.arange(most)
            chance = (np.maximum(a[own, None] + j - dp * np.maximum(tau[own, None], j > 0), 0) + mass[own, None]) / (total[own, None] + j)
            log = log_ways(n, most, d) + (j + 1) * log_new[own, None] + np.cumsum(np.log(chance), axis=1)
            top = log.max(axis=1, keepdims=True)
            if most < n and (short := log[:, -1] > top[:, 0] - 35).any():  # the law goes on beyond `most`
                wide = min(n, 4 * most)
                late, own, log, top = own[short], own[~short], log[~short], top[~short]
                todo += [(late[k : k + max(1, 500_000 // wide)], wide) for k in range(0, len(late), max(1, 500_000 // wide))]
            p = np.cumsum(np.exp(log - top), axis=1)
            if len(own):
                out[own] = 1 + (p < rng.random(len(own))[:, None] * p[:, -1:]).sum(axis=1)
    return out


def log_mass(tables: np.ndarray, strength: float, d: float, rng: np.random.Generator) -> np.ndarray:
    """Logarithm of the weight of a new table in restaurants with so many tables, given the gamma variable that makes their dishes independent."""
    if not d:
        return np.full(len(tables), np.log(strength))
    return np.log(d * np.maximum(rng.standard_gamma(strength / d + tables), 1e-300))


def fixed_chance(p: float, n: int) -> tuple[np.ndarray, ...]:
    """The parent of the root: it serves any word with chance p, whatever it has served."""
    return np.zeros(n), np.zeros(n), np.full(n, p * 1e18), np.full(n, 1e18), 0.0


# totals: root customers and tables, vocabulary, training tokens, then customers and tables of the word restaurants that owners keep


class Root:
    """Chances of words at the root, and of dishes at word restaurants, given their numbers and the totals."""

    def __init__(self, totals: np.ndarray, m: Model):
        self.customers, self.tables, self.vocabulary, self.tokens = totals[:4]
        self.dealt_customers, self.dealt_tables = np.split(totals[4:], 2)
        self.base = 1 / (self.vocabulary + 1)
        self.d, self.strength = m.discounts[0], m.strengths[0]
        self.mass, self.total = (self.strength + self.d * self.tables) * self.base, self.strength + self.customers

    def chance(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (np.maximum(c - self.d * t, 0) + self.mass) / self.total

    def without(self, c: np.ndarray, t: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
        """As the parent of dishes whose `own` tables are its customers."""
        rest = np.maximum(c - own, 0)
        return rest, np.minimum(t, rest), np.full(len(c), self.mass), np.maximum(self.total - own, self.strength), self.d


# mail


def mail(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, ["to", "kind", "shard", "data"], [pa.int32()] * 3 + [pa.binary()])])


def letters(table: pa.Table, kind: int) -> list[dict]:
    return sorted((r for r in table.to_pylist() if r["kind"] == kind), key=lambda r: r["shard"])


def passed_on(table: pa.Table, *kinds: int) -> list[tuple]:
    return [(r["to"], r["kind"], r["shard"], r["data"]) for r in table.to_pylist() if r["kind"] in kinds]


def owner_cuts(words: np.ndarray, owners: int) -> np.ndarray:
    """Bounds of the keys of each owner, by the high bits of the words, which are in order."""
    return np.searchsorted((words >> 16) * owners >> 32, np.arange(owners + 1))


class Sampler:
    """What the sweeps need of a key range: its open dishes and their restaurants, by places among those that have open dishes."""

    def __init__(self, data: bytes):
        c, mid, pair, self.pair_fixed, closed, u, self.u_fixed, self.dealt, self.root_key, self.mid_key, self.n_keys = unpacked(data)
        self.c, self.mid, self.pair = c + 2, np.cumsum(mid), pair
        self.closed, self.u = closed, np.cumsum(u)
        self.light = np.flatnonzero(self.dealt == 0)

    @staticmethod
    def pack(s: Seats) -> tuple[bytes, np.ndarray]:
        """The packed sampler of a key range, and which keys it asks for in every sweep."""
        kept = np.unique(np.concatenate((s.open_mid, s.mid[s.open])))
        pairs, pair = np.unique(s.pair[s.open], return_inverse=True)
        us, u = np.unique(s.u[kept], return_inverse=True)
        closed_leaf = s.c == 1
        pair_fixed = np.bincount(s.pair[closed_leaf], minlength=int(s.pair.max()) + 1)[pairs]
        u_fixed = np.bincount(s.u[(s.customers == 1) & (s.dealt == 0)], minlength=len(s.words))[us]
        asked = np.zeros(len(s.key_word), bool)
        asked[s.root_key[kept]] = asked[s.mid_key[kept]] = True
        place = np.cumsum(asked) - 1
        data = packed(s.c[s.open] - 2, steps(np.searchsorted(kept, s.mid[s.open])), pair, pair_fixed, s.per_mid(closed_leaf)[kept], steps(u), u_fixed, s.dealt[kept], place[s.root_key[kept]], place[s.mid_key[kept]], np.int64(asked.sum()))
        return data, asked

    def sweep(self, t_leaf: np.ndarray, t_mid: np.ndarray, key_c: np.ndarray, key_t: np.ndarray, root: Root, m: Model, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair and word restaurants anew: tables of open leaves, of light mids, and what each asked key gets from them."""
        add = lambda at, x, n: np.bincount(at, weights=x, minlength=n).astype(np.int64)
        (_, d1, d2), (_, a1, a2) = m.discounts, m.strengths
        n_mid, light, dealt = len(self.closed), self.light, np.flatnonzero(self.dealt)
        c1, t1 = self.closed + add(self.mid, t_leaf, n_mid), np.zeros(n_mid, np.int64)
        t1[light] = t_mid
        c1[dealt], t1[dealt] = key_c[self.mid_key[dealt]], key_t[self.mid_key[dealt]]
        c0, t0 = key_c[self.root_key], key_t[self.root_key]

        def restaurant() -> tuple[np.ndarray, np.ndarray]:
            customers, tables = (self.u_fixed + add(self.u[light], x[light], len(self.u_fixed)) for x in (c1, t1))
            customers, tables = customers[self.u], tables[self.u]
            customers[dealt], tables[dealt] = root.dealt_customers[self.dealt[dealt] - 1], root.dealt_tables[self.dealt[dealt] - 1]
            return customers, tables

        customers, tables = restaurant()
        mass = (a1 + d1 * tables) * root.chance(c0, t0)
        rest = np.maximum(c1[self.mid] - t_leaf, 0)
        parent = (rest, np.minimum(t1[self.mid], rest), mass[self.mid], np.maximum(a1 + customers[self.mid] - t_leaf, a1), d1)
        in_pair = self.pair_fixed + add(self.pair, t_leaf, len(self.pair_fixed))
        t_leaf = draw(self.c, log_mass(in_pair, a2, d2, rng)[self.pair], parent, d2, rng)
        c1[light] = (self.closed + add(self.mid, t_leaf, n_mid))[light]
        t1[light] = np.minimum(t1[light], c1[light])
        _, tables = restaurant()
        # one gamma variable for each restaurant
        _, first, of = np.unique(self.u, return_index=True, return_inverse=True)
        new = log_mass(tables[first], a1, d1, rng)[of] if n_mid else np.zeros(0)
        t_mid = draw(c1[light], new[light], root.without(c0[light], t0[light], t1[light]), d1, rng)
        n = int(self.n_keys)
        return t_leaf, t_mid, add(self.root_key[light], t_mid, n) + add(self.mid_key[self.mid], np.where(self.dealt[self.mid] > 0, t_leaf, 0), n)


def count_mail(table: pa.Table, heavy: np.ndarray, owners: list[int]) -> pa.Table:
    """A key range's sampler, to itself, and its words and dealt-out dishes, to their owners: token customers, tables that are given, those to begin with, and whether it will ask for them."""
    s, shard = Seats(table, heavy), table["shard"][0].as_py()
    data, asked = Sampler.pack(s)
    light = s.dealt == 0
    customers = s.per_key(s.root_key, s.customers)
    fixed = s.per_key(s.root_key, light & (s.customers == 1)) + s.per_key(s.mid_key, np.where(light, 0, s.per_mid(s.c == 1)))
    start = s.per_key(s.root_key, light & (s.customers > 1)) + s.per_key(s.mid_key, np.where(light, 0, s.per_mid(s.c > 1)))
    word = s.words[s.key_word]
    cuts = owner_cuts(word, len(owners))
    rows = [(shard, FIXED, shard, data)]
    for o, a, b in zip(owners, cuts[:-1], cuts[1:], strict=True):
        rows.append((o, ASK, shard, packed(steps(word[a:b]), *[x[a:b] for x in (s.key_dealt, customers, fixed, start, asked)])))
    return mail(rows)


class Owner:
    """Numbers of the words of one owner and of the dealt-out dishes of these words, from what the key ranges counted."""

    def __init__(self, asks: list[dict], n_heavy: int):
        self.n_heavy, self.shards = n_heavy, [r["shard"] for r in asks]
        got = [unpacked(r["data"]) for r in asks]
        codes = [np.cumsum(g[0]) * (n_heavy + 1) + g[1] for g in got]
        keys, at = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int64), return_inverse=True)
        add = lambda i: np.bincount(at, weights=np.concatenate([g[i] for g in got]), minlength=len(keys)).astype(np.int64) if got else np.zeros(0, np.int64)
        self.customers, self.fixed, self.start = add(2), add(3), add(4)
        word, self.dealt = np.divmod(keys, n_heavy + 1)
        self.word = np.cumsum(np.diff(word, prepend=-1) != 0) - 1  # of each key; the key of the word itself comes first
        self.places = np.split(at, np.cumsum([len(c) for c in codes])[:-1]) if codes else []
        self.asked = [own[g[5] > 0] for own, g in zip(self.places, got, strict=True)]

    def pack(self) -> bytes:
        return packed(self.fixed, self.dealt, steps(self.word))

    def counted(self) -> np.ndarray:
        """Vocabulary and training tokens."""
        return np.array([(self.customers[self.dealt == 0] > 0).sum(), self.customers.sum()])


def totals_of(c: np.ndarray, t: np.ndarray, dealt: np.ndarray, counted: np.ndarray, n_heavy: int) -> np.ndarray:
    root = dealt == 0
    per = lambda x: np.bincount(dealt[~root] - 1, weights=x[~root], minlength=n_heavy).astype(np.int64)
    return np.concatenate(([c[root].sum(), t[root].sum()], counted, per(c), per(t)))


def customers_of(given: np.ndarray, t: np.ndarray, dealt: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Customers of each key: for a word those given and the tables of its dealt-out dishes."""
    n = int(word[-1]) + 1 if len(word) else 0
    more = np.bincount(word, weights=np.where(dealt > 0, t, 0), minlength=n).astype(np.int64)
    return np.where(dealt == 0, given + more[word], given)


def own_mail(table: pa.Table, n_heavy: int) -> pa.Table:
    """An owner's first numbers: one table for each dish and word."""
    own, to = Owner(letters(table, ASK), n_heavy), table["to"][0].as_py()
    if not own.shards:
        return mail([])
    given = own.fixed + own.start
    t = np.minimum(given, 1)
    c = customers_of(given, t, own.dealt, own.word)
    t = np.where(own.dealt == 0, np.minimum(c, 1), t)
    totals = totals_of(c, t, own.dealt, own.counted(), n_heavy)
    rows = [(to, OWN, to, own.pack()), (to, HELD, to, packed(t, own.counted()))]
    rows += [(to, PLACES, s, packed(steps(p))) for s, p in zip(own.shards, own.asked, strict=True)]
    return mail(rows + [(s, TELL, to, packed(totals, c[p], t[p])) for s, p in zip(own.shards, own.asked, strict=True)])


def told(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Totals of the whole, and the numbers of the keys of a key range in their order."""
    got = [unpacked(r["data"]) for r in letters(table, TELL)]
    return np.sum([g[0] for g in got], axis=0), [np.concatenate(x) for x in zip(*[g[1:] for g in got], strict=True)]


def sweep_mail(fixed: pa.Table, news: pa.Table, m: Model, number: int) -> pa.Table:
    """One sweep of a key range."""
    rows, mine = passed_on(news, HELD), letters(fixed, FIXED)
    if not mine:  # a key range without tokens
        return mail(rows)
    shard, s = mine[0]["shard"], Sampler(mine[0]["data"])
    totals, (key_c, key_t) = told(news)
    state = letters(news, SEATS)
    t_leaf, t_mid, *samples = unpacked(state[0]["data"]) if state else (np.ones(len(s.c), np.int64), np.ones(len(s.light), np.int64))
    t_leaf, t_mid, given = s.sweep(t_leaf, t_mid, key_c, key_t, Root(totals, m), m, np.random.default_rng([m.seed, shard, number]))
    if number >= m.burn_in:
        samples += [t_leaf, t_mid]
    rows.append((shard, SEATS, shard, packed(t_leaf, t_mid, *samples)))
    sizes = tb.runs(np.array([len(unpacked(r["data"])[1]) for r in letters(news, TELL)]))
    for o, a, b in zip([r["shard"] for r in letters(news, TELL)], sizes[:-1], sizes[1:], strict=True):
        rows.append((o, ASK, shard, packed(totals, given[a:b])))
    return mail(rows)


def owner_mail(first: pa.Table, news: pa.Table, m: Model, number: int) -> pa.Table:
    """One sweep of an owner: the dealt-out dishes of its words, then the root."""
    rows, mine = passed_on(news, SEATS), letters(first, OWN)
    if not mine:
        return mail(rows)
    to, (fixed, dealt, word) = mine[0]["to"], unpacked(mine[0]["data"])
    word = np.cumsum(word)
    places = {r["shard"]: np.cumsum(unpacked(r["data"])[0]) for r in letters(first, PLACES)}
    t, counted, *samples = unpacked(letters(news, HELD)[0]["data"])
    asks = {r["shard"]: unpacked(r["data"]) for r in letters(news, ASK)}
    root = Root(next(iter(asks.values()))[0], m)
    given = fixed.copy()
    for s, (_, x) in asks.items():
        given += np.bincount(places[s], weights=x, minlength=len(fixed)).astype(np.int64)
    rng = np.random.default_rng([m.seed, 1 << 20, to, number])
    kept = np.flatnonzero(dealt)
    c = customers_of(given, t, dealt, word)
    if len(kept):
        top = np.searchsorted(word, word[kept])  # the key of the word itself
        mass = log_mass(root.dealt_tables, m.strengths[1], m.discounts[1], np.random.default_rng([m.seed, 1 << 21, number]))  # the same for all owners
        t[kept] = draw(c[kept], mass[dealt[kept] - 1], root.without(c[top], t[top], t[kept]), m.discounts[1], rng)
        c = customers_of(given, t, dealt, word)
    words = np.flatnonzero(dealt == 0)
    mass = log_mass(root.tables[None], root.strength, root.d, np.random.default_rng([m.seed, 1 << 22, number]))
    t[words] = draw(c[words], np.repeat(mass, len(words)), fixed_chance(root.base, len(words)), root.d, rng)
    if number >= m.burn_in:
        samples += [c, t.copy()]
    totals = totals_of(c, t, dealt, counted, len(root.dealt_tables))
    rows.append((to, HELD, to, packed(t, counted, *samples)))
    return mail(rows + [(s, TELL, to, packed(totals, c[places[s]], t[places[s]])) for s in asks])


def total_mail(counted: pa.Table, news: pa.Table, n_heavy: int, m: Model) -> pa.Table:
    """An owner's numbers of all keys, for all key ranges that have them: token customers, and customers and tables under each sample."""
    rows, kept = passed_on(news, SEATS), letters(news, HELD)
    if not kept:
        return mail(rows)
    own, to = Owner(letters(counted, ASK), n_heavy), kept[0]["to"]
    samples = unpacked(kept[0]["data"])[2:]
    totals = np.stack([totals_of(c, t, own.dealt, own.counted(), n_heavy) for c, t in zip(samples[::2], samples[1::2], strict=True)])
    return mail(rows + [(s, TELL, to, packed(totals, own.customers[p], *[x[p] for x in samples])) for s, p in zip(own.shards, own.places, strict=True)])


def chances(s: Seats, news: pa.Table, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predictive probability of each leaf, the mean over the samples; with the totals of the samples, and the training tokens of each key."""
    totals, (key_customers, *keys) = told(news)
    drawn = unpacked(letters(news, SEATS)[0]["data"])[2:]
    (_, d1, d2), (_, a1, a2) = m.discounts, m.strengths
    mean = np.zeros(len(s.c))
    light, n_words, n_pairs = s.dealt == 0, len(s.words), int(s.pair.max()) + 1
    in_pair = np.bincount(s.pair, weights=s.c, minlength=n_pairs)[s.pair]
    for number in range(m.samples):
        root, key_c, key_t = Root(totals[number], m), keys[2 * number], keys[2 * number + 1]
        t2, t1 = np.minimum(s.c, 1), np.minimum(s.customers, 1)
        t2[s.open], t1[s.open_mid] = drawn[2 * number], drawn[2 * number + 1]
        c1 = s.per_mid(t2)
        c1[~light], t1[~light] = key_c[s.mid_key[~light]], key_t[s.mid_key[~light]]
        customers, tables = (np.bincount(s.u[light], weights=x[light], minlength=n_words)[s.u] for x in (c1, t1))
        customers[~light], tables[~light] = root.dealt_customers[s.dealt[~light] - 1], root.dealt_tables[s.dealt[~light] - 1]
        word = (c1 - d1 * t1 + (a1 + d1 * tables) * root.chance(key_c[s.root_key], key_t[s.root_key])) / (a1 + customers)
        pair_tables = np.bincount(s.pair, weights=t2, minlength=n_pairs)[s.pair]
        mean += (s.c - d2 * t2 + (a2 + d2 * pair_tables) * word[s.mid]) / (a2 + in_pair)
    return mean / m.samples, totals, key_customers


def score_mail(table: pa.Table, news: pa.Table, heavy: np.ndarray, m: Model, buckets: int) -> pa.Table:
    """Scores of the documents of a key range, by bucket."""
    s = Seats(table, heavy)
    mean, totals, key_customers = chances(s, news, m)
    n_tokens, vocabulary = int(totals[0][3]), int(totals[0][2])
    of_word = key_customers[s.root_key][s.mid]  # training tokens of each leaf's word
    at = tb.runs(s.counts)[:-1]
    each = lambda v: np.add.reduceat(v[s.leaf], at)
    values = s.counts, each((of_word > 0).astype(np.int64)), each(np.log10((of_word + 1.0) / (n_tokens + vocabulary + 1))), each(np.log10(mean))
    bucket = (tb.mix(s.ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for b in range(buckets):
        pick = order[cuts[b] : cuts[b + 1]]
        if len(pick):
            doc, inverse = np.unique(s.ids[pick], return_inverse=True)
            n, known, base, score = (np.bincount(inverse, weights=v[pick]) for v in values)
            rows.append((b, n_tokens, int(doc[0]), packed(steps(doc - doc[0]), n.astype(np.int64), known.astype(np.int64)), np.stack((base, score)).astype("<f8").tobytes()))
    return pa.Table.from_batches([_batch(rows, ["bucket", "train_tokens", "first", "numbers", "sums"], [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 2])])


def add_documents(table: pa.Table) -> pa.Table:
    """One bucket of documents: the sums of their tokens over all key ranges."""
    numbers = [unpacked(x) for x in table["numbers"].to_pylist()]
    ids = np.concatenate([first + np.cumsum(n[0]) for first, n in zip(table["first"].to_pylist(), numbers, strict=True)])
    sums = np.concatenate([np.frombuffer(x, "<f8").reshape(2, -1) for x in table["sums"].to_pylist()], axis=1)
    doc, inverse = np.unique(ids, return_inverse=True)
    n, known, base, score = (np.bincount(inverse, weights=v) for v in (*(np.concatenate([x[i] for x in numbers]) for i in (1, 2)), *sums))
    return pa.table({"doc_id": doc, "n_tokens": n.astype(np.int64), "n_known": known.astype(np.int64), "train_tokens": np.full(len(doc), table["train_tokens"][0].as_py()), "base_score": base, "score": score})


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity): log10 probabilities of every text, learned from the texts that are not held out."""
    m = model or Model()
    spark = docs.sparkSession
    tb.small_batches(spark)
    shards = tb.shards(spark, 32)
    texts = tb.keyed(docs, id_col, text_col)
    heavy = heavy_words(texts, shards)
    n_heavy = len(heavy)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = tb.even_keys(spark, shards, ranges)
    owners = sorted(keys[:OWNERS])  # in the order of their words
    dealt = texts.mapInArrow(lambda it: pack_tokens(it, heavy, keys, m), _TOKENS).repartition(ranges, "shard")
    counted = dealt.groupBy("shard").applyInArrow(lambda t: count_mail(t, heavy, owners), _MAIL).repartition(ranges, "to")
    first = counted.groupBy("to").applyInArrow(lambda t: own_mail(t, n_heavy), _MAIL).repartition(ranges, "to")

    def swept(number: int):
        return lambda a, b: sweep_mail(a, b, m, number)

    def owned(number: int):
        return lambda a, b: owner_mail(a, b, m, number)

    # one line of stages; what every sweep reads again is the same exchange
    news = first
    for number in range(m.burn_in + m.samples):
        news = counted.groupBy("to").cogroup(news.groupBy("to")).applyInArrow(swept(number), _MAIL).repartition(ranges, "to")
        news = first.groupBy("to").cogroup(news.groupBy("to")).applyInArrow(owned(number), _MAIL).repartition(ranges, "to")
    totals = counted.groupBy("to").cogroup(news.groupBy("to")).applyInArrow(lambda a, b: total_mail(a, b, n_heavy, m), _MAIL)

    def score(own: pa.Table, news: pa.Table) -> pa.Table:
        if not own.num_rows:  # a key range without tokens
            return pa.Table.from_batches([_batch([], ["bucket", "train_tokens", "first", "numbers", "sums"], [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 2])])
        return score_mail(own, news, heavy, m, shards)

    parts = dealt.groupBy("shard").cogroup(totals.groupBy("to")).applyInArrow(score, _BACK)
    found = parts.groupBy("bucket").applyInArrow(add_documents, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return found.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % m.modulus == m.held_out).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    )
