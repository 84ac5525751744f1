"""Many patterns against a test of every pattern on every line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from redraft.operators import matching, planning


@pytest.fixture(scope="module")
def lines(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcé "), 30)) for _ in range(400)] + ["", None, "aaaa", "x\ty", "\U0001f600 ab \U0001f600", "aaaa"]
    return spark.createDataFrame([(f"f{i % 7}", i // 7 + 1, t, 9) for i, t in enumerate(texts)], "file string, line int, text string, old int").repartition(3)


PATTERNS = ["a", "ab", "abc", "b a", "é", "aa", "aaa", "\U0001f600", "zzz", "", None, "a\nb", "c", "ab", "bcab", " "]


def brute(lines, longest):
    own = {p for p in PATTERNS if p and "\n" not in p}
    out = []
    for r in lines.collect():
        found = {p for p in own if p in (r["text"] or "")}
        out += [(r["file"], r["line"], r["old"], p) for p in found if not longest or not any(p != q and p in q for q in found)]
    return sorted(out)


@pytest.mark.parametrize("longest", [False, True])
@pytest.mark.parametrize("block", [matching.BLOCK_CHARS, 7])
def test_pattern_hits(spark, lines, longest, block):
    patterns = spark.createDataFrame([(p, 1) for p in PATTERNS], "old_text string, n int")
    got = matching.pattern_hits(lines, patterns, longest, block)
    assert got.columns == ["file", "line", "old", "old_text"]
    assert sorted(tuple(r) for r in got.collect()) == brute(lines, longest)


def test_nothing_to_find(spark, lines):
    none = spark.createDataFrame([], "old_text string")
    assert matching.pattern_hits(lines, none, True).collect() == []
    assert matching.pattern_hits(lines.limit(0), spark.createDataFrame([("a",)], "old_text string")).collect() == []


def test_small_reads_give_the_same(spark, lines, monkeypatch):
    patterns = spark.createDataFrame([(p,) for p in PATTERNS], "old_text string")
    batches = [b for b in lines.where("text is not null").toArrow().to_batches()]
    whole = [r for b in matching.match_batches(iter(batches), ["a", "ab", "é"], True, ["file", "line"]) for r in b.to_pylist()]
    monkeypatch.setattr(matching, "READ_CHARS", 40)
    assert [r for b in matching.match_batches(iter(batches), ["a", "ab", "é"], True, ["file", "line"]) for r in b.to_pylist()] == whole and patterns.count() == len(PATTERNS)


def test_few_and_many_mappings_make_the_same_edits(spark, lines):
    mappings = spark.createDataFrame([("ab", "X"), ("abc", "Y"), ("a", "a"), ("é", "e"), ("", "z"), ("é", "E")], "old_text string, new_text string")
    few = planning.whole_file_edits(lines, mappings)
    many = planning.many_file_edits(lines, mappings)
    assert many.columns == few.columns and sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) and few.count() > 100


def test_no_nested_loop(spark, lines):
    mappings = spark.createDataFrame([("ab", "X"), ("abc", "Y")], "old_text string, new_text string")
    plan = planning.many_file_edits(lines, mappings)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and F is not None


def test_hits_are_never_shuffled(spark, lines):
    """Neither where patterns make several blocks nor to meet the other columns of their mappings."""
    rows = spark.createDataFrame([tuple(r) for r in lines.collect()], lines.schema)
    mappings = spark.createDataFrame([(p, f"{p}{n}") for p in sorted(set(PATTERNS) - {None}) for n in range(2)], "old_text string, new_text string")
    found = matching.mapping_hits(rows, mappings, True, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert sorted(map(tuple, found.select("file", "line", "old", "old_text", "new_text").collect())) == sorted((*r, f"{r[3]}{n}") for r in brute(lines, True) for n in range(2))


def test_patterns_of_one_hash(lines, monkeypatch):
    monkeypatch.setattr(matching.Hashed, "hashes", lambda self, at, n: np.full(len(at), n, np.uint64))
    patterns = sorted({p for p in PATTERNS if p and "\n" not in p})
    rows = lines.toArrow()
    for longest in (False, True):
        got = [r for b in matching.match_batches(rows.to_batches(), patterns, longest, ["file", "line", "old"]) for r in b.to_pylist()]
        assert sorted(tuple(r.values()) for r in got) == brute(lines, longest)
