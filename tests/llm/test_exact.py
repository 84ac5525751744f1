"""Operators whose results are checked against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from redraft.llm import bpe, exact_dedup, ngram_join, pitman_yor, repeats, token_counts
from redraft.llm.components import components
from tests.llm.conftest import lower

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect() if r["doc_id"] is not None]


# operator 2


@pytest.mark.parametrize("name", ["documents", "odd", "none"])
def test_exact_duplicates(request, name):
    df = request.getfixturevalue(name)
    groups = defaultdict(list)
    for i, t in texts(df):
        groups[t].append(i)
    want = sorted((i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted(tuple(r) for r in exact_dedup.exact_duplicates(df).collect()) == want


@pytest.mark.parametrize("bits", [0, 2])
def test_groups_come_from_the_chain(request, bits):
    """Keys that nearly all texts share: the index alone tells them apart, whatever their digests."""
    df = request.getfixturevalue("odd").unionByName(request.getfixturevalue("documents").select("doc_id", "text", F.lit(0).alias("shard"), F.lit("k").alias("keys"), "lang").limit(60))
    groups = defaultdict(list)
    for i, t in texts(df):
        groups[t].append(i)
    want = sorted((i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    key = lambda text: F.pmod(F.length(text), F.lit(1 << bits)) * F.lit(1 << 61)
    assert sorted(tuple(r) for r in exact_dedup.exact_duplicates(df, key_of=key).collect()) == want


def test_equal_keys_of_different_texts_stay_apart():
    batches = [pa.RecordBatch.from_pydict({"key": [1, 1, 1], "text": ["x", "y", "x"], "keep_id": [5, 6, 7], "n": [1, 2, 3]}), pa.RecordBatch.from_pydict({"key": [1, 2], "text": ["y", "x"], "keep_id": [1, 9], "n": [1, 4]})]
    rows = [r for b in exact_dedup.chain(batches) for r in b.to_pylist()]
    assert [tuple(r.values()) for r in rows] == [(1, 2, 7, 4, "x"), (1, 2, 6, 3, "y"), (2, 1, 9, 4, None)]


def test_texts_are_folded_within_bounds():
    import numpy as np

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "key": [-1, 1] * 50, "text": ["a" * 50, "b" * 50] * 50})
    whole = [r for b in exact_dedup.fold_batches([batch], 1, np.array([7, 8], np.int32)) for r in b.to_pylist()]
    assert [tuple(r.values()) for r in whole] == [(8, -1, "a" * 50, 98, 50), (7, 1, "b" * 50, 99, 50)]
    parts = [r for b in exact_dedup.fold_batches([batch], 0, np.zeros(1, np.int32), most=100) for r in b.to_pylist()]
    assert len(parts) == 100 and sum(r["n"] for r in parts) == 100


def test_directory_splits_overfull_buckets_only(spark):
    counts = spark.createDataFrame([(p, 10, 2) for p in range(8)] + [(1 << 19, 1000, 1)], "prefix int, entries long, keys long")
    found = exact_dedup.directory(counts, capacity=25, most_bits=20)
    starts = sorted((p << (20 - d), d) for d, p in found)
    assert sum(2 ** (20 - d) for _, d in starts) == 2**20  # covers every prefix once
    assert all(b[0] == a[0] + 2 ** (20 - a[1]) for a, b in itertools.pairwise(starts))
    assert (1, 1) in found  # a bucket of one key is not split
    depth, slots = exact_dedup.slots_of(found)
    assert len(slots) == 2**depth and set(slots.tolist()) == set(range(len(found))) and len(found) > 2


# operator 3


def brute_components(df, words, percent):
    sets = defaultdict(set)
    for i, t in texts(df):
        w = WORD.findall(lower(t))
        sets[i] |= {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


@pytest.mark.parametrize(("name", "words", "percent"), [("documents", 4, 85), ("odd", 4, 85), ("odd", 2, 50), ("none", 4, 85)])
def test_jaccard_components(request, name, words, percent):
    df = request.getfixturevalue(name)
    got = ngram_join.jaccard_components(df, words=words, percent=percent)
    assert sorted(tuple(r) for r in got.collect()) == brute_components(df, words, percent)


def test_chains_of_near_copies(spark):
    """Neighbours in a chain link, its ends don't; a cluster around a hub and one beside it stay exact."""
    words = [f"w{i}" for i in range(400)]
    data = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(40)] + [(100 + i, " ".join([*words[300:350], f"x{i}", *words[350:400]])) for i in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.jaccard_components(df, words=2, percent=80).collect()) == brute_components(df, 2, 80)


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (7, 9), (2, 2), (11, 11), (4, 5), (None, 1)]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(tuple(r) for r in got.collect()) == [(2, 2), (3, 2), (4, 2), (5, 2), (7, 7), (8, 7), (9, 7), (11, 11)]


# operator 4


def brute_repeats(df, length):
    out, seen = [], {}
    data = sorted((i, t.encode()) for i, t in texts(df))
    for i, b in data:
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k : k + length], i)
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("name", "length"), [("documents", 50), ("odd", 50), ("odd", 30), ("none", 50)])
def test_repeated_passages(request, name, length):
    df = request.getfixturevalue(name)
    assert sorted(tuple(r) for r in repeats.repeat_digests(df, length=length).collect()) == brute_repeats(df, length)


def test_runs_of_small_period_are_few_phrases():
    import numpy as np

    for unit in (b" ", b"ab", b"0123456789" * 3):
        data = np.frombuffer(b"head" + unit * (200_000 // len(unit)) + b"tail", np.uint8)
        _, begin, end, key, _ = repeats.parse(data, np.array([0, len(data)]), 50)
        assert len(begin) < 200 + 30 * 50 and (end - begin).max() <= repeats.RUN + 49
        covered = np.zeros(len(data) - 49, bool)
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            covered[a : b - 49] = True
        assert covered.all()


def test_repeats_of_runs_and_of_rows_that_share_an_id(spark):
    rng = __import__("random").Random(7)
    part = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = part(90)
    data = [(1, " " * 9000), (2, "x" + " " * 5000 + "y"), (3, "ab" * 4500), (4, "q" + "ba" * 100), (5, part(70) + passage), (6, passage + part(40) + " " * 60), (7, part(300))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(tuple(r) for r in repeats.repeat_digests(df).collect()) == brute_repeats(df, 50)
    again = data + [(5, passage + "other"), (8, passage + part(20)), (8, "z" + passage), (8, "z" + passage)]
    got = sorted(tuple(r)[:4] for r in repeats.repeat_digests(spark.createDataFrame(again, "doc_id long, text string")).collect())
    assert [r for r in got if r[0] == 5] == [(5, 95, 0, 0), (5, 160, 0, 0)] and [r for r in got if r[0] == 8] == [(8, 91, 90, 1), (8, 91, 90, 1), (8, 110, 90, 1)]
    wide = lambda i: (i - 4) << 60
    far = repeats.repeat_digests(spark.createDataFrame([(wide(i), t) for i, t in again], "doc_id long, text string"))
    assert sorted(tuple(r)[:4] for r in far.collect()) == [(wide(i), *rest) for i, *rest in got]


def test_kept_bytes_and_spans(spark):
    passage = "".join(f"{i:03d}-" for i in range(30))
    df = spark.createDataFrame([(1, "head" + passage + "tail"), (2, "é" + passage + "!")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repeats.cut_repeats(df).collect()}
    assert bytes(got[2]["kept"]).decode() == "é!" and got[2]["starts"] == [2] and got[2]["ends"] == [122]
    assert bytes(got[1]["kept"]).decode() == "head" + passage + "tail"


# operator 8


@pytest.mark.parametrize("name", ["documents", "odd", "none"])
def test_token_length_histogram(spark, request, name):
    df = request.getfixturevalue(name)
    hist = token_counts.histogram(token_counts.lengths(df))
    c = bpe.codec(bpe.default_path(), __import__("public_tokenizers").PATTERN)
    n = [len(x) // 4 for x in c.ids([r["text"] or "" for r in df.select("text").collect()])]
    want = [
        {"length": v, "n_docs": k, "docs_within": sum(x <= v for x in n), "tokens_within": sum(x for x in n if x <= v), "docs_longer": sum(x > v for x in n), "truncated_tokens": sum(min(x, v) for x in n), "docs_total": len(n), "tokens_total": sum(n), "quantile": sum(x <= v for x in n) / len(n)}
        for v, k in sorted(Counter(n).items())
    ]
    assert sorted(rows(token_counts.summaries(hist)), key=lambda r: r["length"]) == want
    limits = spark.createDataFrame([(x,) for x in (0, 1, 7, 100, 1024, 5000, 10**9)], "limit long")
    got = {r["limit"]: (r["truncated_tokens"], r["docs_longer"]) for r in token_counts.truncated_totals(hist, limits).collect()}
    assert got == {v: (sum(min(x, v) for x in n), sum(x > v for x in n)) for v in (0, 1, 7, 100, 1024, 5000, 10**9)}


# operator 9


@pytest.mark.parametrize("name", ["documents", "odd", "none"])
def test_language_model_base(request, name):
    df = request.getfixturevalue(name)
    tokens = defaultdict(list)
    train = Counter()
    for i, t in texts(df):
        own = [*WORD.findall(lower(t)), None]
        tokens[i] += own
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(own)
    n, v = sum(train.values()), len(train)
    got = {r["doc_id"]: r for r in pitman_yor.scores(df).collect()}
    assert got.keys() == tokens.keys()
    for i, own in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 7 == 2, len(own), sum(train[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9, abs_tol=1e-9)
        assert r["score"] < 0


def test_language_model_beats_its_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = pitman_yor.scores(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > 0.9 * r["b"] > r["b"]


def local_ranges(data, m, heavy=(), shards=3, owners=2):
    """The stages of the model over key ranges, without Spark: for each range its seats and the mail that it scores with."""
    import numpy as np

    heavy = np.sort(np.array([int(pitman_yor.tokens(pa.RecordBatch.from_pydict({"text": [w]}))[1][0]) for w in heavy], np.int64))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in data], pa.int64()), "text": [t for _, t in data]})
    table = pa.Table.from_batches(list(pitman_yor.pack_tokens([batch], heavy, list(range(shards)), m)))
    dealt = {s: table.filter(pa.compute.equal(table["shard"], s)) for s in set(table["shard"].to_pylist())}
    empty = pitman_yor.mail([])

    def sent(tables):
        whole = pa.concat_tables(tables)
        return {s: whole.filter(pa.compute.equal(whole["to"], s)) for s in range(shards)}

    counted = sent([pitman_yor.count_mail(t, heavy, list(range(owners))) for t in dealt.values()])
    first = sent([pitman_yor.own_mail(t, len(heavy)) for t in counted.values() if t.num_rows])
    news = first
    for number in range(m.burn_in + m.samples):
        news = sent([pitman_yor.sweep_mail(counted.get(s, empty), news[s], m, number) for s in range(shards)])
        news = sent([pitman_yor.owner_mail(first[s], news[s], m, number) for s in range(shards)])
    totals = sent([pitman_yor.total_mail(counted[s], news[s], len(heavy), m) for s in range(shards)])
    return [(pitman_yor.Seats(t, heavy), totals[s]) for s, t in dealt.items()]


@pytest.mark.parametrize("heavy", [(), ("a1",), ("a1", "a2", "a0")])
def test_predictive_probabilities_sum_to_one(heavy):
    """Over all training words, the end and an unknown word, for every context that was seen, and for some that were not."""
    import numpy as np

    m = pitman_yor.Model(samples=2)
    rng = np.random.default_rng(3)
    words = [f"a{k}" for k in range(6)]
    train = [i for i in range(400) if not pitman_yor.held(i, m)][:60]
    ask = [i for i in range(4000) if pitman_yor.held(i, m)]
    data = [(i, " ".join(words[min(k, 5)] for k in rng.geometric(0.4, size=9) - 1)) for i in train]
    for v, u in itertools.product([*words, "zz"], repeat=2):
        data += [(ask.pop(), f"{v} {u} {w}") for w in [*words, "unknown"]] + [(ask.pop(), f"{v} {u}")]
    sums, places = Counter(), Counter()
    for s, news in local_ranges(data, m, heavy):
        p, _, _ = pitman_yor.chances(s, news, m)
        u = s.words[s.u[s.mid]]
        for k in range(len(p)):
            sums[(int(u[k]), int(s.pair[k]), id(s))] += p[k]
            places[(int(u[k]), int(s.pair[k]), id(s))] += 1
    whole = [sums[k] for k, n in places.items() if n == len(words) + 2]
    assert len(whole) >= 40 and all(math.isclose(x, 1, rel_tol=1e-9) for x in whole)


def test_key_ranges_are_dealt_evenly(spark):
    from redraft.llm import textblocks as tb

    keys = tb.even_keys(spark, 30, 7)
    rows = spark.createDataFrame([(k,) for k in keys], "k int").repartition(7, "k").select("k", F.spark_partition_id().alias("p")).collect()
    assert len(set(keys)) == 30 and max(Counter(r["p"] for r in rows).values()) == 5


def test_every_context_has_a_restaurant_of_its_own():
    m = pitman_yor.Model(burn_in=0, samples=1)
    (s, _), *_ = local_ranges([(1, " ".join(f"w{i}" for i in range(20_000)))], m, shards=1, owners=1)
    assert len(set(s.pair.tolist())) == len(s.u) == len(s.c) == 20_001


def test_totals_of_contexts_over_key_ranges(spark):
    """Where every pair occurs once and the root has no discount, nothing is drawn: customers and tables of all contexts are known."""
    d = 0.5
    m = pitman_yor.Model(discounts=(0.0, d, d))
    data = [(i, " ".join(f"a{(i * 37 + k * k) % 89}x{(i + k) % 3}" for k in range(1, 5))) for i in range(400)]
    seen, triples, train, ask = set(), set(), [], []
    for i, t in data:
        words = ["^", "^", *t.split(), "$"]
        own = list(zip(words, words[1:], words[2:]))  # noqa: B905
        pairs = [x[1:] for x in own]
        if pitman_yor.held(i, m):
            ask.append((i, t, own))
        elif len(set(pairs)) == len(pairs) and not seen & set(pairs):
            seen |= set(pairs)
            triples |= set(own)
            train.append((i, t))
    assert len(train) > 20 < len(ask)
    of_pair, of_word, here = Counter(x[:2] for x in triples), Counter(u for u, _ in seen), Counter(w for _, w in seen)

    def p(v, u, w):
        root = (here[w] + 1 / (len(here) + 1)) / (1 + len(seen))
        word = ((1 - d if (u, w) in seen else 0) + (1 + d * of_word[u]) * root) / (1 + of_word[u])
        return ((1 - d if (v, u, w) in triples else 0) + (1 + d * of_pair[v, u]) * word) / (1 + of_pair[v, u])

    df = spark.createDataFrame(train + [(i, t) for i, t, _ in ask], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in pitman_yor.scores(df, model=m).collect()}
    for i, _, own in ask:
        assert math.isclose(got[i], sum(math.log10(p(*x)) for x in own), rel_tol=1e-9)


def ways(c, d):
    """Ways to seat c customers at t tables, from the partitions themselves."""
    out = [0.0] * (c + 1)

    def place(left, sizes):
        if not left:
            out[len(sizes)] += math.prod(math.prod(k - d for k in range(1, n)) for n in sizes)
            return
        for i in range(len(sizes)):
            place(left - 1, [*sizes[:i], sizes[i] + 1, *sizes[i + 1 :]])
        place(left - 1, [*sizes, 1])

    place(c, [])
    return out


def test_numbers_of_tables_have_the_law_of_their_restaurant():
    """A restaurant of three dishes: the joint law of their tables over sweeps against the enumeration of all seatings."""
    import numpy as np

    d, a, c, base = 0.6, 1.3, [4, 3, 2], [0.5, 0.2, 0.3]
    w = [ways(n, d) for n in c]
    law = {t: math.prod(w[i][t[i]] * base[i] ** t[i] for i in range(3)) * math.prod(a + d * k for k in range(sum(t))) for t in itertools.product(*(range(1, n + 1) for n in c))}
    whole = sum(law.values())
    copies, rng = 4000, np.random.default_rng(5)  # restaurants side by side
    n, p = np.tile(c, copies), np.tile(base, copies)
    t = np.ones(len(n), np.int64)
    seen = Counter()
    for sweep in range(30):
        new = np.repeat(pitman_yor.log_mass(t.reshape(-1, 3).sum(axis=1), a, d, rng), 3)
        parent = (np.zeros(len(n)), np.zeros(len(n)), p * 1e18, np.full(len(n), 1e18), 0.0)
        t = pitman_yor.draw(n, new, parent, d, rng)
        if sweep >= 10:
            seen.update(map(tuple, t.reshape(-1, 3).tolist()))
    total = sum(seen.values())
    assert all(abs(seen[k] / total - v / whole) < 0.006 for k, v in law.items())


def test_parents_serve_one_customer_after_another():
    """One dish of one pair, whose word restaurant has nothing else: its tables against the enumeration over both restaurants with the parent's one table."""
    import numpy as np

    d, c, g = 0.5, 5, 0.2
    w, n = ways(c, d), 20_000
    # new tables have weight x; at the parent the first customer opens the only table (chance g), others join it or open one
    x = 0.8
    law = [0.0] + [w[t] * x**t * math.prod((max(j - d, 0) + g) / (1 + j) if j else g / 1 for j in range(t)) for t in range(1, c + 1)]
    zero = np.zeros(n)
    got = pitman_yor.draw(np.full(n, c), np.full(n, math.log(x)), (zero, zero, np.full(n, g), np.full(n, 1.0), d), d, np.random.default_rng(1))
    share = np.bincount(got, minlength=c + 1) / n
    assert all(abs(share[t] - law[t] / sum(law)) < 0.012 for t in range(1, c + 1))


def test_many_customers_have_the_limit_law():
    import numpy as np

    d, c = 0.75, 4000
    t = np.arange(1, c + 1)
    row = np.full(c, -np.inf)
    row[0] = 0
    with np.errstate(divide="ignore"):
        for k in range(1, c):
            stay = np.log(np.maximum(k - d * t, 0)) + row
            stay[k:] = -np.inf
            stay[1:] = np.logaddexp(stay[1:], row[:-1])
            row = stay
    for x in (0.1, 0.7, 3.0):
        exact, found = (np.exp(v - v.max()) for v in (row[:1500] + t[:1500] * math.log(x), pitman_yor.log_ways(c, 1500, d) + t[:1500] * math.log(x)))
        exact, found = exact / exact.sum(), found / found.sum()
        assert np.abs(np.cumsum(exact) - np.cumsum(found)).max() < 0.02


def test_sweeps_see_the_numbers_of_the_last_exchange():
    """After the last sweep every owner's customers are the tables that the key ranges hold."""
    import numpy as np

    m = pitman_yor.Model(burn_in=2, samples=1)
    rng = np.random.default_rng(2)
    data = [(i, " ".join(f"w{k}" for k in rng.integers(1, 9, 40))) for i in range(60)]
    for heavy in ((), ("w3", "w5")):
        found, tables, root, dealt = local_ranges(data, m, heavy), 0, set(), 0
        for s, news in found:
            totals, _ = pitman_yor.told(news)
            drawn = pitman_yor.unpacked(pitman_yor.letters(news, pitman_yor.SEATS)[0]["data"])[2:]
            t1 = np.minimum(s.customers, 1)
            t1[s.open_mid] = drawn[1]
            tables += int(t1[s.dealt == 0].sum())
            root.add(int(totals[0][0]))
            dealt = int(totals[0][4 + len(heavy) :].sum())
        assert root == {tables + dealt} and tables > len(set(np.concatenate([s.words for s, _ in found]).tolist()))


# operator 10


def reference_encoding():
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(bpe.default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["documents", "odd", "none"])
def test_bpe(request, name):
    df, other = request.getfixturevalue(name), reference_encoding()
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = other.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe.round_trip_digests(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_bpe_offsets_and_split_characters(spark):
    text = "naïve 😀😀 — žluťoučký\n"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encode(df).collect()}
    r = got[1]
    assert r["starts"][0] == 0 and max(r["ends"]) == len(text) and all(a < b for a, b in zip(r["starts"], r["ends"], strict=True))
    assert {c for a, b in zip(r["starts"], r["ends"], strict=True) for c in range(a, b)} == set(range(len(text)))
    assert got[2]["ids"] == []
    back = {x["doc_id"]: x for x in bpe.decode(bpe.encode(df)).collect()}
    assert back[1]["text"] == text and back[2]["text"] == ""
    parts = bpe.encode(df).where("doc_id = 1").select(F.posexplode("ids").alias("doc_id", "id")).select("doc_id", F.array("id").alias("ids"))
    alone = sorted(bpe.decode(parts).collect(), key=lambda x: x["doc_id"])
    assert b"".join(bytes(x["decoded"]) for x in alone) == text.encode()
    assert any("�" in x["text"] for x in alone)  # a token that holds part of a character only
