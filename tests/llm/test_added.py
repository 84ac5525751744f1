"""Operators 11 to 13 against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from redraft.llm import codebooks, imatch, infill
from tests.llm.conftest import lower

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect() if r["doc_id"] is not None]


# operator 11


def brute_fingerprints(docs, low, high, shares):
    docs = sorted(docs)
    df = Counter(w for _, t in docs for w in set(WORD.findall(lower(t))))
    words = {w for w, n in df.items() if low * len(docs) < n <= high * len(docs)}

    def digest(ws):
        return hashlib.md5(" ".join(ws).encode()).hexdigest()[:8]

    def components(t):
        found = sorted(words & set(WORD.findall(lower(t))), key=str.encode)
        out = [digest(found) if found else hashlib.md5(lower(t).encode()).hexdigest()[:8]]
        for j, share in enumerate(shares):
            own = [w for w in found if hashlib.sha256(w.encode()).digest()[j] < share]
            out.append(digest(own) if own else "--------")
        return out

    def like(a, b):
        both = [(x, y) for x, y in zip(a, b, strict=True) if (x, y) != ("--------", "--------")]
        return sum(x == y for x, y in both) / len(both)

    out = []
    for i, (doc, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = components(t), components(edited), components(after)
        out.append((doc, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), like(a, b), like(a, c)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name, low, high, shares", [("documents", imatch.LOW, imatch.HIGH, imatch.SHARES), ("documents", 0.0, 1.0, [128, 3]), ("odd", 0.05, 0.5, [256, 64, 8]), ("none", 0.0, 1.0, [9])])
def test_fingerprints(request, name, low, high, shares):
    df = request.getfixturevalue(name)
    got = imatch.fingerprints(df, low=low, high=high, shares=shares)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted_rows(got) == brute_fingerprints(texts(df), low, high, shares)


def test_one_document_is_its_own_next(spark):
    df = spark.createDataFrame([(1 << 61, "A few words of one text, no more.")], "doc_id long, text string")
    assert sorted_rows(imatch.fingerprints(df, high=1.0)) == brute_fingerprints(texts(df), imatch.LOW, 1.0, imatch.SHARES)


def test_a_large_lexicon_meets_terms_by_a_shuffle(documents, monkeypatch):
    want = sorted_rows(imatch.fingerprints(documents))
    monkeypatch.setattr(imatch, "MOST_BROADCAST", 10)
    assert sorted_rows(imatch.fingerprints(documents)) == want


def test_fingerprints_tell_edits_from_other_documents(documents):
    got = imatch.fingerprints(documents).where("n_chars > 200")
    near = got.agg(F.avg("near_edited"), F.avg("near_next"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int"))).first()
    assert near[0] > 0.2 and near[1] < 0.02 and near[2] > 0.95


def test_neighbours_cross_ranges(spark):
    """Ids far apart and in many ranges: every row meets the next one, wherever that lies."""
    ids = [-(1 << 60), -5, 0, 1, 2, 3, 1000, 1001, 10**15, (1 << 62) + 1, *range(2000, 2100)]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(7)
    rows = imatch.neighbours(df).where("not guest").collect()
    order = sorted(ids)
    assert {r["doc_id"]: r["next_text"] for r in rows} == {i: f"text {order[(k + 1) % len(order)]}" for k, i in enumerate(order)}
    assert len({r["bucket"] for r in rows}) > 8


@pytest.mark.parametrize("bounds", [[], [5], [1, 5, 9], list(range(0, 40, 3))])
def test_range_of_is_a_bisection(spark, bounds):
    got = spark.range(-3, 45).select("id", imatch.range_of(F.col("id"), bounds).alias("n")).collect()
    assert all(r["n"] == sum(b <= r["id"] for b in bounds) for r in got)


# operator 12


def brute_infill(doc, t):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{doc}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, t
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def marked(spark):
    """Marks and parts of marks at every place, by many ids, so that all forms occur."""
    pieces = ["<P>", "a<P", "<S", "S>", "<M", "<", ">", "P>x<", "<<M", "abc", "", None, "é<", "\n", "\U0001f600>", "<S>", "x<M>y", "<P<S<M", "word word", "A1B2"]
    return spark.createDataFrame([(i * 37 + j, p, "spm", 3) for i in range(12) for j, p in enumerate(pieces)], "doc_id long, text string, form string, n int")


@pytest.mark.parametrize("name", ["documents", "odd", "none", "marked"])
def test_fill_in_middle(request, name):
    df = request.getfixturevalue(name)
    want = sorted((brute_infill(*x) for x in texts(df)), key=repr)
    made = infill.fill_in_middle(df)
    assert sorted_rows(made) == want
    if name in ("documents", "marked"):
        assert {r[2] for r in want} == {"plain", "psm", "spm"}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    told = sorted(((*r[:5], digest(r[5]), digest(t)) for r, t in ((brute_infill(i, t), t) for i, t in texts(df))), key=repr)
    assert sorted_rows(infill.infill_digests(df)) == told


def test_fill_in_middle_of_a_very_long_text(spark):
    text = ("ab, " * 200_000) + "é" * 50_000
    df = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string")
    assert sorted_rows(infill.fill_in_middle(df)) == sorted((brute_infill(i, text) for i in range(4)), key=repr)


# operator 13


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted((i, v, label) for i, v, label in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v))
    ints = [[math.floor(256 * x) for x in v] for _, v, _ in kept]
    width = len(ints[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in ints]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        own = [[nearest(p, v[p])[1] for p in range(parts)] for v in cut]
        for p in range(parts):
            met = defaultdict(list)
            for v, c in zip(cut, own, strict=True):
                met[c[p]].append(v[p])
            for k, vs in met.items():
                books[p][k] = tuple(sum(x) // len(vs) for x in zip(*vs, strict=True))
    found = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    labels = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for _, c in f), e, labels[label], digest) for (i, _, label), f, e in zip(kept, found, errors, strict=True)), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, part int")


def test_codes(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = codebooks.code_digests(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted_rows(got) == brute_codes([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])


def test_codes_of_odd_vectors(spark):
    """Nulls, ties, repeated vectors and ids, few distinct values, labels without a value; columns with names of the operator's own."""
    rng = np.random.default_rng(3)
    rows = [(int(i) - 20, [float(x) for x in rng.integers(-2, 3, 32) / 512], None if i % 5 == 0 else int(i % 3), "x", 1) for i in range(300)]
    rows += [(500, rows[3][1], 1, "x", 1), (500, rows[3][1], 1, "x", 1), (501, None, 1, "x", 1), (502, [None, *rows[0][1][1:]], 1, "x", 1), (503, [math.nan, *rows[0][1][1:]], 0, "x", 1), (504, [math.inf, *rows[0][1][1:]], 0, "x", 1), (None, rows[0][1], 0, "x", 1)]
    short = [(600, [1.0] * 16, 0, "x", 1), (-90, [1.0] * 33, 0, "x", 1), (601, [], 0, "x", 1), (602, [2e5] * 32, 0, "x", 1)]  # of other lengths, or beyond the largest component
    got = sorted_rows(codebooks.code_digests(vectors(spark, rows + short)))
    assert got == brute_codes([r[:3] for r in rows])
    assert sorted_rows(codebooks.code_digests(vectors(spark, rows[:9]))) == brute_codes([r[:3] for r in rows[:9]])
    assert codebooks.code_digests(vectors(spark, [])).collect() == [] and codebooks.code_digests(vectors(spark, rows[-5:-1])).count() == 0


def test_hot_labels_and_others_get_the_same_sums(spark, monkeypatch):
    coded = spark.createDataFrame([(i, None if i < 60 else "rest" if i < 100 else f"own {i}", i) for i in range(160)], "vec_id long, label string, error long")
    want = Counter()
    for r in coded.collect():
        want[r["label"]] += r["error"]
    for most in (1, 4, 1000):
        monkeypatch.setattr(codebooks, "MOST_HOT", most)
        assert all(r["label_error"] == want[r["label"]] for r in codebooks.label_errors(coded).collect()) and codebooks.label_errors(coded).count() == 160


def test_bounds_save_scans_and_never_decide_wrongly():
    """Well separated clusters: after the first pass bounds decide nearly all; random rounds agree with full scans."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-4000, 4000, (1, 30, 4))
    x = (centres[0][rng.integers(0, 30, 3000)] + rng.integers(-20, 21, (3000, 4))).reshape(3000, 1, 4)
    history = [centres + rng.integers(-15, 16, centres.shape)]
    bounds = codebooks.Bounds(3000, 1)
    for number in range(5):
        bounds.rescans[:] = 0
        bounds.renew(x, history)
        assert (bounds.code[:, 0] == codebooks.nearest(x[:, 0], history[-1][0])[0]).all()
        assert bounds.rescans.sum() == 3000 if number == 0 else bounds.rescans.sum() < 30
        history.append(history[-1] + rng.integers(-9, 10, centres.shape))
    tight = [rng.integers(-3, 4, (2, 7, 3)) for _ in range(6)]  # many ties
    y, bounds = rng.integers(-4, 5, (500, 2, 3)), codebooks.Bounds(500, 2)
    for n in range(1, 7):
        bounds.renew(y, tight[:n])
        for p in range(2):
            assert (bounds.code[:, p] == codebooks.nearest(y[:, p], tight[n - 1][p])[0]).all()


def test_bounds_survive_storage():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    b = codebooks.Bounds(40, 3)
    b.renew(rng.integers(-90, 90, (40, 3, 2)), [rng.integers(-90, 90, (3, 9, 2))])
    back = codebooks.Bounds.read(pa.RecordBatch.from_arrays(b.columns(), ["code", "upper", "upper_at", "lower", "lower_at", "rescans"]), 3)
    assert (back.code == b.code).all() and (back.upper >= b.upper).all() and (back.lower <= b.lower).all() and (back.upper < b.upper + 1e-3).all()


def test_net_ways_are_shorter_than_drifts():
    """An entry that goes and comes back has moved nothing, whatever its moves add up to."""
    book = np.arange(24, dtype=np.int64).reshape(2, 4, 3)
    moved, others = codebooks.ways([book, book + 50, book])[0]
    assert (moved == 0).all() and (others == 0).all()


def test_decompressed_vectors_are_near(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    coded, history = codebooks.compress(df)
    back = {r["vec_id"]: r["vector"] for r in codebooks.decompress(coded, history[-1]).collect()}
    errors = {r["vec_id"]: r["error"] for r in coded.collect()}
    for r in df.collect():
        ints = [math.floor(256 * x) for x in r["embedding"]]
        assert sum((a - round(b * 256)) ** 2 for a, b in zip(ints, back[r["vec_id"]], strict=True)) == errors[r["vec_id"]]


# operator 5's reader


def test_members_are_read_in_linear_time():
    import gzip
    import time

    from redraft.llm import warc

    texts = [b"x" * (n % 5000) + str(n).encode() for n in range(12_000)]
    data = b"".join(gzip.compress(t, 1) for t in texts)
    began = time.time()
    assert list(warc.members(data)) == texts and time.time() - began < 20
    big = gzip.compress(bytes(range(256)) * 40_000) + gzip.compress(b"")
    assert [len(m) for m in warc.members(big)] == [256 * 40_000, 0] and list(warc.members(b"")) == []
    with pytest.raises(ValueError, match="no end"):
        list(warc.members(data[:-3]))


def test_plain_text_ends_where_sql_ends(spark):
    """Blanks before a last line separator are no blanks at the end, as in the SQL, whose $ is the end only."""
    from redraft.llm import warc

    texts = ["<p> ab \u2028", " \n <p>x</p> y &nbsp;\n", "\u0085 a \u0085", "<p> </p>", ""]
    got = [r["p"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(warc.plain_text(F.col("t")).alias("p")).collect()]
    assert got == ["ab \u2028", "x\ny", "\u0085 a \u0085", "", ""]


def test_digests_of_records_are_made_once(spark):
    from redraft.llm import warc

    made = warc.derivatives(spark.createDataFrame([(1, "<r>", "u", "d", "h", "<p>x")], "row_id long, record_id string, target_uri string, date string, http_headers string, body string"))
    generate = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in line]
    assert len(generate) == 1 and "sha2(" not in generate[0]
