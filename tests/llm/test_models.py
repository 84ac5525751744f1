"""Decontamination, WARC, quality, personal data and the pipeline."""

import gzip
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from redraft.llm import decontamination, pii, quality, queries, warc
from redraft.llm.components import saved

SF = "/root/testdata/sf0.01"


def oracle(name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    r = c.sql(queries.ORACLE_SQL[name])
    return sorted(map(str, (tuple(dict(zip(r.columns, x, strict=True))[k] for k in sorted(r.columns)) for x in r.fetchall())))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect()) == oracle(name)


# operator 1


def test_leaks_tolerate_substitutions(spark, odd, none):
    item = [f"t{i}" for i in range(20)]
    swap = lambda *at: " ".join("zz" if i in at else w for i, w in enumerate(item))
    docs = [(1, "before " + swap() + " after"), (2, swap(3, 8, 13, 18)), (3, swap(1, 4, 7, 10, 13)), (4, " ".join([*item[:10], "added", *item[10:]]).upper()), (5, " ".join(item[:12])), (6, None), (7, "")]
    bench = [(50, " ".join(item)), (51, None), (52, ""), (53, "tiny item"), (None, " ".join(item))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in decontamination.decontaminate(d, b).collect()}
    assert got == {1: (True, [50]), 2: (True, [50]), 3: (False, []), 4: (True, [50]), 5: (False, []), 6: (False, []), 7: (False, [])}
    short = spark.createDataFrame([(1, "a tiny, item here"), (2, "tiny other item")], "doc_id long, text string")
    assert {r["doc_id"]: r["item_ids"] for r in decontamination.decontaminate(short, b).collect()} == {1: [53], 2: []}
    assert decontamination.decontaminate(none, b).count() == 0
    clean = decontamination.decontaminate(odd, b.limit(0))
    assert clean.count() == odd.where("doc_id is not null").count() and clean.where("contaminated").count() == 0


def test_every_placing_of_the_substitutions_that_are_allowed(spark):
    """Items of 1 to 25 words, each with as many wrong words as the share allows, wherever they are: all are found; with one more none is."""
    import itertools
    import random

    rng, docs, want = random.Random(3), [], {}
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(1, 26)}
    for n, item in items.items():
        wrong = n // 5
        placings = list(itertools.combinations(range(n), wrong))
        for at in rng.sample(placings, min(len(placings), 60)):
            docs.append((len(docs), "a b " + " ".join("zz" if k in at else w for k, w in enumerate(item)) + " c"))
            want[docs[-1][0]] = [n]
        docs.append((len(docs), " ".join("zz" if k <= wrong else w for k, w in enumerate(item))))
        want[docs[-1][0]] = []
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {r["doc_id"]: r["item_ids"] for r in got} == want


def test_rows_that_share_an_id(spark):
    item = [f"t{i}" for i in range(20)]
    bench = spark.createDataFrame([(1, " ".join(item)), (1, "some other words of the same item id"), (2, "none of these words stand in any document")], "item_id long, text string")
    rows = [(1, " ".join(item)), (1, " ".join(item[:9])), (2, "x"), (2, "some other words of the same item id"), (3, " ".join(item[:9]))]
    for order in (rows, rows[::-1]):
        got = decontamination.decontaminate(spark.createDataFrame(order, "doc_id long, text string").coalesce(1), bench).collect()
        assert sorted((r["doc_id"], r["contaminated"], r["n_items"]) for r in got) == [(1, True, 1), (1, True, 1), (2, True, 1), (2, True, 1), (3, False, 0)]


def test_scattered_pieces_of_an_item_are_no_leak():
    import numpy as np

    item = np.arange(1, 21, dtype=np.uint64)
    apart = np.concatenate([np.concatenate((item[5 * k : 5 * k + 5], np.full(6, 99 + k, np.uint64))) for k in range(4)])
    assert decontamination.found_words(apart, item, np.array([0, 6, 12, 18]))[0] == 5
    close = np.concatenate((item[:10], np.full(2, 99, np.uint64), item[10:]))
    assert decontamination.found_words(close, item, np.array([0, 2])) == (20, 0)


def test_every_whole_item_is_found(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+|[\u0080-￿]+", t.lower())) + " "
    items = {r["item_id"]: norm(r["text"]) for r in bench.collect()}
    got = {r["doc_id"]: set(r["item_ids"]) for r in decontamination.decontaminate(docs, bench).collect()}
    for r in docs.collect():
        assert {i for i, t in items.items() if t in norm(r["text"])} <= got[r["doc_id"]]


# operator 5


def test_warc_records_of_odd_responses(spark):
    rows = [(1, "<r1>", "http://a", "d", "h", "<html><head><title>x</title></head><p>A &amp; B</p><br>C<script>no</script>"), (2, "<r2>", None, None, None, None), (3, None, "u", "d", "h", "x"), (4, "<r4>", "u", "d", "h", "")]
    df = spark.createDataFrame(rows, "row_id long, record_id string, target_uri string, date string, http_headers string, body string")
    got = {(r["row_id"], r["warc_type"]): r for r in warc.derivatives(df).collect()}
    assert got.keys() == {(i, k) for i in (1, 2, 4) for k in ("metadata", "conversion")}
    assert got[1, "conversion"]["block"] == "A & B\nC"
    assert f"conversion: {got[1, 'conversion']['derived_id']}" in got[1, "metadata"]["block"]
    assert all(r["refers_to"] == f"<r{i}>" and f"WARC-Refers-To: <r{i}>" in r["record"] for (i, _), r in got.items())
    assert got[2, "conversion"]["block"] == "" and got[2, "conversion"]["content_length"] == 0
    assert warc.derivatives(df.limit(0)).count() == 0


def test_written_records_are_read_back(spark, tmp_path):
    rows = [(i, f"<r{i}>", f"http://a/{i}", "d", "h", f"<p>é {i}\r\n\r\n</p>" * (i % 5)) for i in range(50)]
    made = warc.derivatives(spark.createDataFrame(rows, "row_id long, record_id string, target_uri string, date string, http_headers string, body string").repartition(3))
    files = warc.write_records(made, f"file://{tmp_path}/out").collect()
    assert sum(r["n_records"] for r in files) == 100 and sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(r["file"] for r in files)
    want = {(r["derived_id"], r["warc_type"], r["refers_to"], r["target_uri"], r["block_digest"], r["content_length"], r["block"]) for r in made.collect()}
    got = {(r["record_id"], r["warc_type"], r["refers_to"], r["target_uri"], r["block_digest"], r["content_length"], bytes(r["block"]).decode()) for r in warc.read_records(spark, f"file://{tmp_path}/out").collect()}
    assert got == want
    whole = b"".join((tmp_path / "out" / r["file"]).read_bytes() for r in files)
    assert gzip.decompress(whole).count(b"WARC/1.1\r\n") == 100 and whole.count(b"\x1f\x8b\x08") >= 100


def test_pages_of_unclosed_tags_take_linear_time(spark):
    import time

    n = 2_000_000
    pages = ["<script>" * (n // 8), "<script" * (n // 7) + "</script>", "<" * n, "<!--" * (n // 4), "<style>" * (n // 7) + "</style>" + "<style>" * 1000, "<br" * (n // 3), "<head>" * (n // 6), "&#65;" * (n // 5), " \n" * (n // 2), "<p>" * (n // 3)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(pages)], "page_id long, html string").repartition(len(pages))
    began = time.time()
    got = {r["page_id"]: r["p"] for r in df.select("page_id", F.substring(warc.plain_text(F.col("html")), 1, 40).alias("p")).collect()}
    assert time.time() - began < 60
    assert got[2] == "<" * 40 and got[4] == "" and got[7] == "A" * 40 and got[9] == ""


def test_characters_of_pages(spark):
    texts = ["A&#66;&#x43;&#x1F600; &amp;#67; &#0; &#xD800; &#1114112; &#99999999;", "<script>a<p>b</p>", "x<!--a<script>b-->c</script>d", "a<script >q</script\n>b</script>c", "\ufdd0script"]
    got = [r["p"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(warc.plain_text(F.col("t")).alias("p")).collect()]
    assert got == ["ABC\U0001f600 &#67; &#0; &#xD800; &#1114112; &#99999999;", "a b", "x c d", "a c", "\ufdd0script"]


# operator 6


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    r = quality.score_documents(docs, labels).where("held_out").join(labels, "doc_id").collect()
    good, bad = [x["score"] for x in r if x["quality"] == 1], [x["score"] for x in r if x["quality"] == 0]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert sum((x["predicted"] == 1) == (x["quality"] == 1) for x in r) / len(r) > 0.95


def test_quality_of_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([(7, 1, None), (6, 0, None), (8, None, 1), (None, 1, 1), (9, 1, 0), (12, 0, 0), (12, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(odd, labels)
    assert got.count() == odd.where("doc_id is not null").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.collect())
    assert quality.score_documents(none, labels).count() == 0
    assert {r["score"] for r in quality.score_documents(odd, labels.limit(0)).collect()} == {0.5}


def test_marginals_against_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    evidence, first, move = rng.normal(size=7), np.array([0, 4, 5, 7]), rng.normal(size=(2, 2))
    got, pairs = quality.marginals(evidence, first, move, True)
    want, expected = np.zeros(7), np.zeros((2, 2))
    for a, b in itertools.pairwise(first):
        total, one, two = 0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            p = np.exp(sum(evidence[a + i] * v for i, v in enumerate(y)) + sum(move[u, v] for u, v in itertools.pairwise(y)))
            total += p
            one += p * np.array(y)
            for u, v in itertools.pairwise(y):
                two[u, v] += p
        want[a:b] = one / total
        expected += two / total
    assert np.allclose(got, want) and np.allclose(pairs, expected)


# operator 7


def brute_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out)


def test_base_spans_of_all_texts(documents, odd):
    import random

    rng = random.Random(5)
    bits = ["1", "25", "4", "@", "a.", "b", ".", "-", "+", "(", ") ", " ", "4111111111111111", "1.2.3.4", "+1 (415) 555-1234", "é", "x@y.z"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    for t in [*(r["text"] or "" for r in documents.collect()), *(r["text"] or "" for r in odd.collect()), *made]:
        assert pii.base_spans(t) == brute_base(t)


def test_field_adds_what_greedy_matches_spoil(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights = pii.train(docs)
    base, added = pii.find_spans("+1 (415) 555-1234 4111111111111111 x", weights)
    assert base == [] and added == [(0, 3, 17), (18, 2, 34)]
    for clean in ("ref 4111111111111112", "pi 3.14159265358979", "2024-01-02 12:33", "version 300.1.2.3", "a@b", "", "no digits"):
        assert pii.find_spans(clean, weights) == ([], [])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_decimals_dates_and_order_numbers_are_no_phone_numbers(spark, sf):
    weights = pii.train(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
    for clean in ("pi 3.14159265358979", "12.5000000001", "0.123456789012", "1.2345678901", "order 1234567890", "id 415555123456", "2024-01-02 12:33", "2024-01-02 2024-01-03", "on 02.01.2024 1234", "10 20 30 40 50 60", "1,234,567,890"):
        assert pii.find_spans(clean, weights) == ([], []), clean
    assert pii.find_spans("call (415) 555-1234.", weights) == ([], [(5, 3, 19)])


def test_fit_takes_the_most_frequent_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "mail a.b@c.org now" if i % 3 else f"call +1 415 555 {1000 + i}") for i in range(60)], "doc_id long, text string")
    monkeypatch.setattr(pii, "TRAIN_BLOCKS", 1)
    weights = pii.train(docs)  # the frequent form alone
    assert pii.find_spans("+1 415 555 1234 5", weights)[1] == [] and (weights[3, 11] == pii.PRIOR[3, 11] or abs(weights[3, 11]) < 0.5)
    monkeypatch.setattr(pii, "MOST_SEGMENTS", 0)
    assert list(pii.count_blocks(docs.select("text").toArrow().to_batches()))[0].num_rows == 0


def test_field_is_fitted_on_all_documents(spark):
    """One document with personal data among many with numbers, the last by the hash of its id."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"))
    last = docs.orderBy(F.xxhash64("doc_id").desc()).first()["doc_id"]
    text = F.when(F.col("doc_id") == last, "mail a.b@c.org now").otherwise(F.concat(F.lit("ref "), F.col("doc_id").cast("string")))
    assert pii.train(docs.withColumn("text", text)) is not None


def test_blocks_have_the_likelihood_of_their_stretch():
    import numpy as np

    part, rng = "a@b.co and " + "so on " * 12 + "10.0.0.1, x 7 (415) 555-1234", np.random.default_rng(6)
    at, segments = pii.candidates(part)
    weights = rng.normal(size=(len(pii.KINDS), pii.N_FEATURES))
    total = [0.0]
    for j in range(1, len(at)):
        ways = [total[j - 1], *[total[i] + np.logaddexp.reduce(weights[:, f].sum(axis=1)) for i, e, f in segments if e == j]]
        total.append(np.logaddexp.reduce(ways))
    own = []
    for block in pii.blocks(part, pii.base_spans(part)):
        x = np.frombuffer(block, "<i4").reshape(-1, 4)
        best = [0.0]
        for j in range(1, int(x[:, 1].max()) + 1):
            score = [weights[:, [b for b in range(pii.N_FEATURES) if f >> b & 1]].sum(axis=1) for _, _, f, _ in x[x[:, 1] == j].tolist()]
            best.append(np.logaddexp.reduce([best[j - 1], *[best[i] + np.logaddexp.reduce(v) for i, v in zip(x[x[:, 1] == j][:, 0].tolist(), score, strict=True)]]))
        own.append(best[-1])
    assert len(own) > 1 and abs(sum(own) - total[-1]) < 1e-9


@pytest.mark.parametrize("text", ["1" * 10**6, "0" * 10**6 + ".1.1.1", "0123456789abcdef" * 62_500, "11 " * 100_000, "a@b" * 100_000, "+1(" * 100_000, "1." * 100_000, "a" * 10**6 + "@b.c", "1" * 40 + "a"], ids=range(9))
def test_long_texts_take_linear_time(text):
    import time

    import numpy as np

    weights = np.random.default_rng(1).normal(size=(len(pii.KINDS), pii.N_FEATURES))
    began = time.time()
    base, _ = pii.find_spans(text, weights)
    assert time.time() - began < 60
    assert base == ([(0, 1, 10**6 + 6)] if text[0] == "0" and text[-1] == "1" else [(0, 0, len(text))] if text.endswith("@b.c") else base)


def test_decoding_and_posteriors_against_enumeration():
    """All cuts of a stretch into segments of a kind and tokens outside: the best one, and the chance of every segment under every kind."""
    import numpy as np

    part, rng = "+1 (415) 555-1234 10.0.0.1", np.random.default_rng(8)
    weights = rng.normal(size=(len(pii.KINDS), pii.N_FEATURES)) / 2
    at, segments = pii.candidates(part)
    n, by_start = len(at) - 1, {}
    for k, (i, j, f) in enumerate(segments):
        by_start.setdefault(i, []).append((k, j, f))

    def cuts(i, only):
        if i >= n:
            yield 0.0, ()
            return
        for score, rest in cuts(i + 1, only):
            yield score, rest
        for k, j, f in by_start.get(i, ()):
            for kind in range(len(pii.KINDS)):
                if not only or pii.REQUIRED[kind] in f:
                    for score, rest in cuts(j, only):
                        yield score + weights[kind, f].sum(), ((k, kind), *rest)

    best = max(score for score, _ in cuts(0, True))
    place = {b: i for i, b in enumerate(at)}
    found = [(kind, next(f for i, j, f in segments if (i, j) == (place[a], place[b]))) for a, kind, b in pii.decode(part, weights)]
    assert len(found) and all(pii.REQUIRED[kind] in f for kind, f in found) and abs(sum(weights[kind, f].sum() for kind, f in found) - best) < 1e-9
    total, chance = 0.0, np.zeros((len(segments), len(pii.KINDS)))
    for score, own in cuts(0, False):
        total += np.exp(score)
        for k, kind in own:
            chance[k, kind] += np.exp(score)
    rows = np.array([(i, j, sum(1 << x for x in f), -1) for i, j, f in segments], "<i4")
    batch = pii._Batch([rows], [1]).index()
    assert np.allclose(batch.expectations(weights), chance / total)


def test_personal_data_rows(spark, odd, none):
    rows = pii.personal_data(odd).collect()
    assert len(rows) == odd.count() and pii.personal_data(none).count() == 0
    df = spark.createDataFrame([(1, "é x.y@b.co and 10.0.0.1"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.span_digests(pii.personal_data(df)).collect()}
    assert got[1]["spans"] == "email:2:10,ip:15:23" and (got[1]["n_email"], got[1]["n_ip"], got[1]["n_card"], got[1]["n_phone"]) == (1, 1, 0, 0)
    assert got[2]["spans"] == ""


# the pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, SF))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and docs.join(before, "doc_id", "left_anti").count() == 0
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] > counts[4] == counts[5]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.good_documents(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    good = labels.where("quality = 1")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.01 * good.count()
    assert kept.where(F.col("doc_id").isNull()).count() == 0


@pytest.mark.parametrize("name", ["odd", "none"])
def test_pipeline_stages_on_odd_tables(spark, request, name):
    """Nulls, empty and long texts, repeated rows, no rows, and columns named like those of the operators."""
    docs = request.getfixturevalue(name)
    for c in ("kept_id", "keep_id", "kept", "component_id", "n_shingles", "contaminated", "item_ids", "predicted", "score", "key", "sha", "signature", "kind.of"):
        docs = docs.withColumn(c, F.lit(1))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        rows = out.collect()
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()} - {None}
        else:
            assert len(rows) == docs.count()
        if name == "none":
            assert rows == []
