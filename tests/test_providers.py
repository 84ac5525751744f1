"""The contract of a language's provider."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from redraft.plans import plan as pl
from redraft.plans import providers
from redraft.sources import readers


def rows(spark, files):
    return readers.source_lines(spark.createDataFrame(files, "file string, text string"))


def one_edit(spark, file, line, old, new):
    return spark.createDataFrame([(file, line, 0, old, new, "r", True)], "file string, line int, seq int, old_text string, new_text string, rule_id string, replace_all boolean")


def test_changed_files_are_tidied_and_hooks_run(spark):
    lines = rows(spark, [("a.ts", "import { A, B } from 'x';\nimport { C, C } from 'y';"), ("b.ts", "import { C, C } from 'y';")])
    noting = dataclasses.replace(providers.JAVASCRIPT, name="n", before=lambda own: own.agg(F.count("*").alias("n")), after=lambda changed, noted: changed.crossJoin(noted))
    done = providers.applied(one_edit(spark, "a.ts", 1, "A", "B"), lines, noting)
    assert sorted(tuple(r) for r in done.lines.collect()) == [("a.ts", 1, "import { B } from 'x';"), ("a.ts", 2, "import { C } from 'y';")]
    assert done.follow_up.collect() == [("a.ts", 2)]
    java = providers.applied(one_edit(spark, "A.java", 2, "b.Old", "a.New"), rows(spark, [("A.java", "import a.New;\nimport b.Old;\nclass A {}")]), providers.JAVA)
    assert sorted(tuple(r) for r in java.lines.collect()) == [("A.java", 1, "import a.New;"), ("A.java", 2, ""), ("A.java", 3, "class A {}")] and java.follow_up is None
    assert providers.applied(one_edit(spark, "b.ts", 1, "none", "x"), lines).lines.collect() == []


def test_functions_must_give_their_columns(spark):
    lines = rows(spark, [("a.ts", "x")])
    bad = dataclasses.replace(providers.JAVASCRIPT, name="bad", tidied=lambda x: x.drop("line"), removals=lambda i, x: x, companions=lambda s, x: s.withColumn("companion_tests", F.lit("t")))
    with pytest.raises(TypeError, match="tidied lines of bad.*line: missing"):
        providers.applied(one_edit(spark, "a.ts", 1, "x", "y"), lines, bad)
    incidents = spark.createDataFrame([(1, "a.ts", 1)], "seq int, file string, line int").withColumn("variables", F.create_map(F.lit("propName"), F.parse_json(F.lit('"p"'))))
    with pytest.raises(TypeError, match="removals of bad"):
        bad.remove(incidents, lines)
    with pytest.raises(TypeError, match="companion_tests: string for array<string>"):
        bad.tests_of(incidents, lines)


def test_providers_are_registered_once():
    providers.register(providers.JAVA)
    with pytest.raises(ValueError, match="already"):
        providers.register(dataclasses.replace(providers.JAVA, matched=()))
    mine = dataclasses.replace(providers.JAVA, name="mine")
    providers.register(mine)
    assert providers.PROVIDERS.pop("mine") is mine


def test_a_plan_takes_its_language_from_the_provider(spark):
    """Annotations, whole-file renames of modules and files of configuration are Java's alone."""
    inc = lambda file, line, **v: {"uri": f"file:///r/{file}", "lineNumber": line, "message": "m", "variables": v}
    report = [{"name": "s", "violations": {"gone": {"labels": ["change-type=prop-removal"], "incidents": [inc("A.java", 2, annotationName="Gone")]}, "move": {"incidents": [inc("A.java", 1, module="m")]}, "built": {"incidents": [inc("target/B.java", 1)]}}}]
    strategies = {"move": {"strategy": "JavaImportRename", "from": "org.a.Old", "to": "org.b.New"}, "built": {"strategy": "Rename", "from": "x", "to": "y"}}
    lines = rows(spark, [("/r/A.java", "import org.a.Old;\n@Gone(1) class X {}"), ("/r/app.xml", "<bean class='org.a.Old'/>")])
    incidents = readers.findings(spark.createDataFrame([(json.dumps(report),)], "text string"))
    p = pl.plan(incidents, readers.strategies(spark.createDataFrame([(0, json.dumps(strategies))], "file_ix int, text string")), lines, "/r", providers.JAVA)
    found = {(r["file"], r["line"], r["old_text"], r["new_text"]) for r in p.edits.collect()}
    assert ("/r/A.java", 2, "@Gone(1) class X {}", "class X {}") in found and ("/r/app.xml", 1, "org.a.Old", "org.b.New") in found and ("/r/A.java", 1, "import org.a.Old;", "import org.b.New;") in found
    assert [(r["rule_id"], r["reason"]) for r in p.ignored.collect()] == [("built", "path")]


def test_lines_meet_edits_once(spark):
    """What edits make of lines is made once, for the lines and for the files that changed."""
    noting = dataclasses.replace(providers.JAVASCRIPT, name="once", after=lambda changed, noted: changed)
    done = providers.applied(one_edit(spark, "a.ts", 1, "A", "B"), rows(spark, [("a.ts", "A\nA"), ("b.ts", "A")]), noting)
    assert done.lines._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 1
    assert "Join" not in done.follow_up._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["file"], r["line"], r["text"]) for r in done.lines.collect()) == [("a.ts", 1, "B"), ("a.ts", 2, "A")]
