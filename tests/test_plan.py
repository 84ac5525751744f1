"""A whole plan on a small report, its parts and its summary."""

import json

from pyspark.sql import functions as F

from redraft.operators import edits as ed
from redraft.plans import plan as pl
from redraft.sources import readers


def test_plan_end_to_end(spark):
    sources = spark.createDataFrame(
        [("/r/a.tsx", "import { Old, Keep } from 'x';\n<Old isOpen b/>\nOldest\nvar --ui-v5-a;"), ("/r/node_modules/b.js", "Old"), ("/r/c.tsx", "nothing")], "file string, text string"
    )
    inc = lambda line, **v: {"uri": "file:///r/a.tsx", "lineNumber": line, "message": "m", "variables": v}
    report = [
        {
            "name": "s",
            "violations": {
                "rename": {"labels": [], "incidents": [inc(1, importedName="Old"), {"uri": "/r/node_modules/b.js", "lineNumber": 1, "variables": {"importedName": "Old"}}, {"uri": "c.tsx", "lineNumber": 1, "message": "m", "variables": {"propName": "zz"}}]},
                "prop": {"labels": ["change-type=prop-removal"], "incidents": [inc(2, propName="isOpen"), inc(3, propName="isOpen")]},
                "css": {"labels": [], "incidents": [inc(4, className="--ui-v5-a"), inc(4, className="--ui-v5-skip")]},
                "dep": {"labels": [], "incidents": [inc(1, dependencyName="d")]},
                "talk": {"labels": ["family=Card"], "incidents": [inc(2, propName="b", n=[1, 2])]},
                "tests": {"labels": ["change-type=test-impact"], "incidents": [inc(2, propName="b")]},
                "hand": {"labels": ["change-type=behavioral"], "incidents": [inc(2, propName="b")]},
            },
        }
    ]
    strategies = {
        "rename": {"strategy": "Rename", "mappings": [{"from": "Old", "to": "New"}, {"from": "Same", "to": "Same"}]},
        "css": {"strategy": "CssVariablePrefix", "from": "v5", "to": "v6", "exclude_patterns": ["skip"]},
        "dep": {"strategy": "EnsureDependency", "package": "d", "new_version": "^2"},
        "talk": {"strategy": "CompositionChange", "component": "Card"},
    }
    lines = readers.source_lines(sources)
    p = pl.plan(readers.findings(spark.createDataFrame([(json.dumps(report),)], "text string")), readers.strategies(spark.createDataFrame([(0, json.dumps(strategies))], "file_ix int, text string")), lines, "/r")
    assert {(r["file"], r["line"], r["old_text"], r["new_text"]) for r in p.edits.collect()} == {("/r/a.tsx", 1, "Old", "New"), ("/r/a.tsx", 2, " isOpen", ""), ("/r/a.tsx", 2, "Old", "New"), ("/r/a.tsx", 3, "Old", "New"), ("/r/a.tsx", 4, "v5", "v6")}
    assert p.subsumed.count() == 0
    assert sorted((r["rule_id"], r["line"]) for r in p.manual.collect()) == [("css", 4), ("hand", 2), ("tests", 2)]
    pending = {r["rule_id"]: r for r in p.pending.collect()}
    assert pending.keys() == {"dep", "talk"} and pending["talk"]["family"] == "Card"
    assert pending["talk"]["message"] == "m\n\nIncident:\nn: [1,2]\npropName: b\n\nStrategy:\nStrategy: CompositionChange\nComponent: Card"
    assert sorted((r["rule_id"], r["file"], r["reason"]) for r in p.skipped.collect()) == [("prop", "/r/a.tsx", "text_not_found"), ("rename", "/r/c.tsx", "text_not_found")]
    assert [(r["rule_id"], r["reason"]) for r in p.ignored.collect()] == [("rename", "path")]
    text = {r["file"]: r["text"] for r in ed.rebuilt_files(ed.apply_edits(p.edits, lines)).collect()}
    assert text["/r/a.tsx"] == "import { New, Keep } from 'x';\n<New b/>\nNewest\nvar --ui-v6-a;"
    row = pl.summary(p).first()
    assert (row["pattern_edits"], row["edits_subsumed"], row["manual_review"], row["pending"], row["skipped"]) == (5, 0, 3, 2, 2) and json.loads(row["json"])["pattern_edits"] == 5


def test_every_incident_has_one_outcome(spark):
    """Two reports that share names and places, all kinds of strategies, odd lines: no incident is lost or counted twice."""
    files = {
        "/r/a.tsx": "import { A,\n  B } from 'old/x';\n<C onX={() => {\n  go();\n}} y/>\n  onX={() => {\n  run();\n}}\n<D/>",
        "/r/J.java": "import org.a.Old;\n@Gone(1) class X { Old o; }",
        "/r/package.json": '{\n  "dependencies": {\n    "p": "^1.0.0",\n    "parent": "1.0.0"\n  }\n}',
        "/r/yarn.lock": '"parent@npm:1.0.0":\n  version: 1.0.0\n  dependencies:\n    mid: "1"\n\n"mid@npm:1":\n  dependencies:\n    "p": "^1"\n',
    }
    inc = lambda file, line, **v: {"uri": f"file:///r/{file}", "lineNumber": line, "message": "m", "variables": v}
    rules = {
        "path": [inc("a.tsx", 2), inc("a.tsx", 9), inc("a.tsx", None)], "prop": [inc("a.tsx", 6, propName="onX"), inc("a.tsx", 3, propName="onX"), inc("a.tsx", 9, propName="onX"), inc("a.tsx", 9), inc("a.tsx", 99, propName="q")],
        "java": [inc("J.java", 1), inc("a.tsx", 1)], "dep": [inc("package.json", 3), inc("yarn.lock", 1), inc("J.java", 1), inc("a.tsx", 1, importedName="A", module="old/x"), inc("package.json", 3, isDependentOf="p", dependencyName="parent")],
        "new": [inc("package.json", 1)], "new2": [inc("package.json", 1)], "same": [inc("a.tsx", 9, propName="D"), inc("a.tsx", None)], "value": [inc("a.tsx", 9, propName="k", propValue="D"), inc("a.tsx", 9, propObjectValues=["z", "C"])],
    }
    report = json.dumps([{"name": "s", "violations": {r: {"labels": ["change-type=prop-removal"] if r == "prop" else [], "incidents": i} for r, i in rules.items()}}])
    strategies = {
        "path": {"strategy": "ImportPathChange", "from": "old/", "to": "new/"}, "java": {"strategy": "JavaImportRename", "from": "org.a.Old", "to": "org.b.New"}, "dep": {"strategy": "EnsureDependency", "package": "p", "new_version": "^2.0.0"},
        "new": {"strategy": "EnsureDependency", "package": "n", "new_version": "1"}, "new2": {"strategy": "EnsureDependency", "package": "o", "new_version": "2"}, "same": {"strategy": "Rename", "from": "D", "to": "D"},
        "value": {"strategy": "Rename", "mappings": [{"from": "D", "to": "E"}, {"from": "C", "to": "K"}]},
    }
    lines = readers.source_lines(spark.createDataFrame(list(files.items()), "file string, text string"))
    registry = spark.createDataFrame([("parent", "1.0.0", {"p": "^1"}), ("parent", "3.1.0", {"p": "^2"})], "package string, version string, dependencies map<string,string>").withColumn("peerDependencies", F.lit(None).cast("map<string,string>"))
    incidents = readers.findings(spark.createDataFrame([("a.json", report), ("b.json", report)], "file string, text string"))
    p = pl.plan(incidents, readers.strategies(spark.createDataFrame([(0, json.dumps(strategies))], "file_ix int, text string")), lines, "/r", registry=registry)
    every = {(r["report"], r["rule_id"], r["incident_ix"]) for r in incidents.collect()}
    seqs = lambda df: {(r["seq"]["report"], r["seq"]["rule_id"], r["seq"]["incident_ix"]) for r in df.select("seq").collect()}
    parts = [seqs(p.edits) | seqs(p.subsumed), seqs(p.manual), seqs(p.pending), seqs(p.skipped), seqs(p.ignored)]
    assert set.union(*parts) == every and sum(map(len, parts)) == len(every) == 2 * sum(map(len, rules.values()))
    edits = {(r["seq"]["rule_id"], r["file"][3:], r["line"], r["old_text"], r["new_text"]) for r in p.edits.collect()}
    assert {("path", "a.tsx", 2, "old/", "new/"), ("prop", "a.tsx", 6, "  onX={() => {", ""), ("prop", "a.tsx", 7, "  run();", ""), ("prop", "a.tsx", 8, "}}", "")} <= edits
    assert {("java", "J.java", 1, "import org.a.Old;", "import org.b.New;"), ("java", "J.java", 2, "@Gone(1) class X { Old o; }", "@Gone(1) class X { New o; }")} <= edits
    assert ("dep", "package.json", 3, '    "p": "^1.0.0",', '    "p": "^2.0.0",') in edits and ("value", "a.tsx", 9, "D", "E") in edits
    assert {e[3] for e in edits if e[0] == "dep" and e[2] == 4} <= {'    "parent": "1.0.0"'}
    reasons = {(r["rule_id"], r["seq"]["incident_ix"]): r["reason"] for r in p.skipped.collect()}
    assert reasons["prop", 1] == "unbalanced_brackets" and reasons["prop", 3] == "missing_variable" and reasons["prop", 4] == "line_out_of_bounds" and reasons["same", 0] == "no_op_rename" and reasons["path", 2] == "no_line_number"
    assert {r["rule_id"] for r in p.pending.collect()} == {"dep"} and {r["reason"] for r in p.ignored.collect()} == {"java_dependency"}


def test_companions(spark):
    listing = spark.createDataFrame([("/s/__tests__/Card.test.tsx",), ("/s/cardView.spec.ts",), ("/s/Other.test.tsx",), ("/s/Card.tsx",), ("/p/src/test/A/XTest.java",), ("/p/src/main/A/XIT.java",)], "path string")
    src = spark.createDataFrame([("/s/Card.tsx",), ("/s/None.tsx",)], "file string")
    assert {r["file"]: r["companion_tests"] for r in pl.companion_tests(src, listing).collect()} == {"/s/Card.tsx": ["/s/__tests__/Card.test.tsx", "/s/cardView.spec.ts"], "/s/None.tsx": []}
    java = spark.createDataFrame([("/p/src/main/A/X.java",)], "file string")
    assert pl.java_companion_tests(java, listing).first()["companion_tests"] == ["/p/src/main/A/XIT.java", "/p/src/test/A/XTest.java"]


def test_dependencies_without_incidents(spark):
    entries = {"a": {"strategy": "EnsureDependency", "package": "new", "new_version": "^2", "old_package": "old"}, "b": {"strategy": "EnsureDependency", "package": "x", "new_version": "1", "old_package": "y"}, "j": {"strategy": "JavaImportRename", "from": "org.a.B", "to": "org.c.D"}}
    from redraft.operators import planning

    known = readers.strategies(spark.createDataFrame([(0, json.dumps(entries))], "file_ix int, text string")).select("rule_id", "entry", planning.strategy_kind().alias("kind"))
    lines = readers.source_lines(spark.createDataFrame([("/p/package.json", '{\n  "old": "1",\n  "y": "1"\n}'), ("/p/x.xml", "<c>org.a.B.m</c> org.a.Bx"), ("/p/X.java", "org.a.B")], "file string, text string"))
    got = pl.proactive_dependencies(known, spark.createDataFrame([("b",)], "rule_id string"), lines).collect()
    assert [(r["line"], r["new_text"]) for r in got] == [(2, '  "new": "^2",')]
    assert [(r["file"], r["old_text"], r["new_text"]) for r in pl.config_renames(known, lines).collect()] == [("/p/x.xml", "org.a.B", "org.c.D")]
    registry = spark.createDataFrame([("p", "1.0.0", {"d": "^4"}, None), ("p", "2.0.0", {"d": "^5"}, None), ("p", "10.0.0", None, {"d": "^4"}), ("p", "3.0.0", None, None), ("p", "4.0.0-rc.1", None, None)], "package string, version string, dependencies map<string,string>, peerDependencies map<string,string>")
    assert pl.latest_compatible(registry, spark.createDataFrame([("p", "d", 5)], "package string, dependency string, major int")).collect() == [("p", "d", 5, "^3.0.0")]


def test_config_renames_meet_lines_where_they_are(spark, monkeypatch):
    """A name on every line is no key that all lines go to; repeated lines count once, repeated renames each, and many renames meet by a shuffle to the same end."""
    entry = "struct<`from`:string,`to`:string>"
    known = spark.createDataFrame([("r", "JavaImportRename", ("org.a.B", "org.c.D")), ("s", "JavaImportRename", ("org.a.B", "x.y.Z")), ("s", "JavaImportRename", ("org.a.B", "x.y.Z")), ("t", "Rename", ("org.a.B", "no"))], f"rule_id string, kind string, entry {entry}")
    lines = spark.createDataFrame([(f"/{i}.xml", 1, "<b class='org.a.B.C' x='org.a.B'/> org.a") for i in (1, 2, 2)] + [("/X.java", 1, "org.a.B")], "file string, line int, text string")
    want = sorted((f, 1, r, "org.a.B", to) for f in ("/1.xml", "/2.xml") for r, to in (("r", "org.c.D"), ("s", "x.y.Z"), ("s", "x.y.Z")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = pl.config_renames(known, lines)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString() and sorted(map(tuple, found.collect())) == want
        monkeypatch.setattr(pl, "BROADCAST_CHARS", 1)
        assert sorted(map(tuple, pl.config_renames(known, lines).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_retry_list_round_trip(spark):
    results = spark.createDataFrame([("f", "r1", False, True, None), ("f", "r0", False, True, None), ("g", "r1", False, False, "boom"), ("h", "r1", True, False, None)], "file string, rule_id string, ok boolean, timed_out boolean, error string")
    text = pl.retry_list(results)
    assert sorted(r["text"] for r in text.collect()) == ['{"failed":[{"file":"g","rule_ids":["r1"],"error":"boom"}]}', '{"timed_out":[{"file":"f","rule_ids":["r0","r1"]}]}']
    assert sorted(r["file_uri"] for r in readers.file_filter(text).collect()) == ["f", "g"]
    asked = results.select("file", "rule_id").withColumn("message", F.lit("m"))
    assert pl.given_up(asked, results).count() == 3
