"""Input that cannot be read: what stops a run and what is only told."""

import json

import pytest

from redraft.sources import readers


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "file int, text string")


@pytest.mark.parametrize("bad", ["not json", '[{"name": ', None, ""])
def test_an_unreadable_report_stops(spark, bad):
    good = json.dumps([{"name": "s", "violations": {"r": {"incidents": [{"uri": "file:///a", "lineNumber": 1}]}}}])
    with pytest.raises(Exception, match="cannot read report 1"):
        readers.findings(texts(spark, good, bad)).collect()
    assert readers.findings(texts(spark, good, bad), strict=False).count() == 1 and readers.findings(texts(spark, "[]")).count() == 0


def test_an_unreadable_strategy_file_is_a_warning(spark):
    files = texts(spark, '{"r": {"strategy": "Manual"}}', "{broken", "[1]", "{}")
    assert [r["rule_id"] for r in readers.strategies(files, "file").collect()] == ["r"]
    told = readers.strategy_warnings(files, "file").collect()
    assert sorted(r["file"] for r in told) == [1, 2] and all(r["warning"].startswith("cannot read strategies") for r in told)


def test_file_lists(spark):
    found = readers.file_filter(texts(spark, "a/b.ts\n# no\n\nfile:///c.ts\n /d.ts ", '{"timed_out": [{"file": "a/b.ts"}], "failed": [{"file": "e"}, {}]}'), root="/p", required=True)
    assert sorted(r["file_uri"] for r in found.collect()) == ["file:///c.ts", "file:///d.ts", "file:///p/a/b.ts", "file:///p/e"]
    with pytest.raises(ValueError, match="names no file"):
        readers.file_filter(texts(spark, "# nothing\n"), required=True)
    with pytest.raises(Exception, match="cannot read file list"):
        readers.file_filter(texts(spark, "{broken")).collect()
    assert readers.file_filter(texts(spark, '{"other": 1}')).collect() == []


def test_totals_of_nothing_are_zero(spark):
    assert readers.report_totals(texts(spark, "[]")).collect() == [(0, 0, 0)] and readers.report_totals(texts(spark, "x").limit(0)).collect() == [(0, 0, 0)]
