"""Edits, planners, readers, graph and requests on small cases, and brute force where SQL has no form."""

import json
import random

import pytest
from pyspark.sql import functions as F

from redraft.operators import edits as ed
from redraft.operators import graph, planning, requests
from redraft.sources import readers

EDIT = "file string, line int, seq long, old_text string, new_text string, rule_id string, replace_all boolean"


def edits(spark, *rows):
    return spark.createDataFrame([("f", 1, i, o, n, "r", a) for i, (o, n, a) in enumerate(rows)], EDIT)


def lines(spark, text, file="f"):
    return readers.source_lines(spark.createDataFrame([(file, text)], "file string, text string"))


@pytest.mark.parametrize(
    ("rows", "kept"),
    [
        ([("ab-x", "1", True), ("ab", "2", True)], [0, 1]), ([("FooBar", "1", False), ("Foo", "2", False)], [0]), ([("ab-x", "1", True), ("ab", "2", False)], [0]), ([("ab", "1", True), ("ab-x", "2", False)], [1]),
        ([("a-x", "1", True), ("a-y", "2", True), ("a", "3", True)], [0, 1, 2]), ([("a", "1", False), ("a", "1", False)], [0]), ([("a", "1", False), ("a", "2", False)], [0]), ([], []),
    ],
)
def test_overlapping_edits(spark, rows, kept):
    assert sorted(r["seq"] for r in ed.settled(edits(spark, *rows)).collect()) == kept
    if rows:
        assert ed.subsumed(edits(spark, *rows)).first()["n_subsumed"] == len(rows) - len(kept)


def test_settling_equals_a_sequential_fold(spark):
    rng = random.Random(2)
    data, want = [], set()
    for case in range(300):
        rows = [(rng.choice(["a", "ab", "abc", "bc", "b"]), rng.choice("xy"), rng.random() < 0.5) for _ in range(rng.randint(1, 6))]
        data += [("f", case, i, o, n, "r", a) for i, (o, n, a) in enumerate(rows)]
        kept = []
        for i, (o, n, a) in sorted(enumerate(rows), key=lambda x: (-len(x[1][0]), x[1][0], x[0])):
            if any(o == k[1] for k in kept) or any(o in k[1] and not (a and k[2]) for k in kept if k[1] != o):
                continue
            kept.append((i, o, a))
        want |= {(case, i) for i, _, _ in kept}
    got = {(r["line"], r["seq"]) for r in ed.settled(spark.createDataFrame(data, EDIT)).collect()}
    assert got == want


def test_apply_fail_and_rebuild(spark):
    src = lines(spark, "one two\r\nthree\nfour")
    e = spark.createDataFrame([("f", 1, 0, "one", "1", "r", True), ("f", 2, 1, "zzz", "1", "r", True), ("f", 9, 2, "x", "y", "r", True), ("g", 1, 3, "x", "y", "r", True)], EDIT)
    assert ed.rebuilt_files(ed.apply_edits(e, src)).first()["text"] == "1 two\nthree\nfour"
    assert sorted((r["seq"], r["outcome"], r["total_lines"]) for r in ed.failures(e, src).collect()) == [(1, "text_not_found_on_line", 3), (2, "line_out_of_bounds", 3), (3, "line_out_of_bounds", 0)]
    hunk = ed.diff_hunks(e.where("seq = 0"), src).first()
    assert hunk["hunk"] == "-one two\n+1 two\n three\n four"


def test_inserts_and_repeats(spark):
    e = spark.createDataFrame([("f", 3, 2, "}", "b", "r2", False), ("f", 3, 1, "}", "a", "r1", False), ("f", 3, 3, "}", "a", "r3", False)], EDIT)
    r = ed.merged_inserts(e).first()
    assert (r["new_text"], r["rule_id"], r["seq"]) == ("a,\nb", "r1", 1)
    assert sorted(x["seq"] for x in ed.without_repeats(e).collect()) == [1, 2]


def test_import_paths(spark):
    text = "import { a } from 'old/x';\nimport {\n  b,\n  c,\n} from 'old/y';\nuse(b);\nimport d from 'new/old/z';\nexport {\n  e\n} from 'other';"
    inc = spark.createDataFrame([("f", n, "old/", "new/") for n in (1, 3, 4, 7, 9, 40)], "file string, line int, old_text string, new_text string")
    got = {r["incident_line"]: (r["outcome"], r["line"]) for r in planning.import_changes(inc, lines(spark, text)).collect()}
    assert got == {1: ("edit", 1), 3: ("edit", 5), 4: ("edit", 5), 7: ("already_migrated", None), 9: ("text_not_found", None), 40: ("line_out_of_bounds", None)}
    plain = lines(spark, "x = b;\ny = 1;")
    assert planning.import_changes(inc.where("line = 1"), plain).first()["outcome"] in ("not_in_import_block", "text_not_found")


def test_strategies(spark):
    entry = lambda **k: json.dumps({"r": k})
    cases = [
        (entry(strategy="Rename", **{"from": "a", "to": "b"}), "Rename"), (entry(strategy="Rename"), "Manual"), (entry(strategy="Rename", mappings=[{"from": "a", "to": "b"}]), "Rename"), (entry(strategy="RemoveProp"), "RemoveAttribute"),
        (entry(strategy="ImportPathChange", **{"from": "a"}), "Manual"), (entry(strategy="EnsureDependency", package="p", new_version="1"), "EnsureDependency"), (entry(strategy="UpdateType", **{"from": "A", "to": "B"}), "Rename"),
        (entry(strategy="UpdateType", **{"from": "A<B>", "to": "B"}), "Llm"), (entry(strategy="PropTypeChange"), "Llm"), (entry(strategy="Strange"), "Manual"),
    ]
    for text, want in cases:
        got = readers.strategies(spark.createDataFrame([(0, text)], "file_ix int, text string")).select(planning.strategy_kind().alias("k")).first()["k"]
        assert got == want, text
    two = spark.createDataFrame([(0, entry(strategy="Rename")), (1, entry(strategy="RemoveProp"))], "file_ix int, text string")
    assert readers.strategies(two).select("entry.strategy").collect() == [("RemoveProp",)]
    inc = spark.createDataFrame([("r", ["x"]), ("q", ["family=A", "change-type=prop-removal"]), ("q", []), ("q", ["change-type=other"])], "rule_id string, labels array<string>")
    kinds = spark.createDataFrame([("r", "Rename")], "rule_id string, kind string")
    assert sorted(r["kind"] for r in planning.resolved(inc, kinds).collect()) == ["Llm", "Manual", "RemoveAttribute", "Rename"]


def test_findings_in_either_spelling(spark):
    report = [{"name": "s", "violations": {"r": {"labels": ["l"], "incidents": [{"uri": "file:///a", "lineNumber": 3, "message": "m", "variables": {"k": [1], "n": "x"}}, {"file_uri": "file:///b", "line_number": 4}]}}}]
    got = readers.findings(spark.createDataFrame([(json.dumps(report),)], "text string"))
    assert [(r["rule_id"], r["file_uri"], r["line"], r["incident_ix"]) for r in got.orderBy("incident_ix").collect()] == [("r", "file:///a", 3, 0), ("r", "file:///b", 4, 1)]
    assert got.select(F.expr("try_variant_get(variables['n'], '$', 'string')")).first()[0] == "x"


def test_file_lists(spark):
    retry = json.dumps({"timed_out": [{"file": "a"}], "failed": [{"file": "b", "error": "x"}, {"file": "a"}]})
    got = lambda t: sorted(r["file_uri"] for r in readers.file_filter(spark.createDataFrame([(t,)], "text string")).collect())
    assert got(retry) == ["a", "b"] and got("x\n\n# no\n y \nx") == ["x", "y"]


def test_lock_files(spark):
    yarn = '__metadata:\n  version: 8\n\n"@s/a@npm:^1, @s/a@npm:2":\n  version: 1\n  dependencies:\n    b: "npm:^1"\n    "@s/c": "npm:1"\n  peerDependencies:\n    d: "*"\n  bin:\n    x: y\n\n"w@workspace:.":\n  dependencies:\n    "@s/a": "npm:^1"\n'
    got = {(r["child"], r["parent"]) for r in readers.yarn_edges(lines(spark, yarn)).collect()}
    assert got == {("b", "@s/a"), ("@s/c", "@s/a"), ("d", "@s/a"), ("@s/a", "w")}
    npm = json.dumps({"packages": {"": {"dependencies": {"z": "1"}}, "node_modules/a": {"dependencies": {"b": "1"}}, "node_modules/a/node_modules/@s/b": {"peerDependencies": {"c": "1"}}}})
    got = {(r["child"], r["parent"]) for r in readers.npm_edges(spark.createDataFrame([("f", npm)], "file string, text string")).collect()}
    assert got == {("b", "a"), ("c", "@s/b")}
    pnpm = "lockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies:\n      q: 1\npackages:\n  '@s/a@1.0.0':\n    peerDependencies:\n      c: '*'\nsnapshots:\n  '@s/a@1.0.0(c@1)':\n    dependencies:\n      '@s/b': 1\n    optionalDependencies:\n      d: 2\n  /e@1:\n    dependencies:\n      a: 1\n"
    got = {(r["child"], r["parent"]) for r in readers.pnpm_edges(lines(spark, pnpm)).collect()}
    assert got == {("c", "@s/a"), ("@s/b", "@s/a"), ("d", "@s/a"), ("a", "e")}


def test_manifests(spark):
    text = '{\n  "x": {\n    "p": "9"\n  },\n  "dependencies": {\n    "p": "1.0.0",\n    "q": "2"\n  }\n}'
    assert planning.dependency_blocks(lines(spark, text)).collect() == [("f", "dependencies", 5, 8)]
    wanted = spark.createDataFrame([(1, "f", "p", "^2.0.0"), (2, "f", "q", ">=2"), (3, "f", "z", "1"), (4, "f", "y", "7"), (5, "none", "p", "1")], "seq int, file string, package string, version string")
    got = {r["seq"]: (r["line"], r["new_text"], r["reason"]) for r in planning.manifest_changes(wanted, lines(spark, text)).collect()}
    assert got == {1: (6, '    "p": "^2.0.0",', None), 2: (7, None, "version_already_compatible"), 3: (7, '    "q": "2",\n    "z": "1",\n    "y": "7"', None), 4: (7, None, "merged"), 5: (None, None, "package_json_not_found")}
    rows = readers.manifest_dependencies(spark.createDataFrame([("f", text), ("g", "not json")], "file string, text string"))
    assert sorted((r["section"], r["name"]) for r in rows.collect()) == [("dependencies", "p"), ("dependencies", "q")]
    paths = spark.createDataFrame([("/a/b/c/x.js",), ("/a/y.js",), ("/z/y.js",)], "path string")
    have = spark.createDataFrame([("/a/package.json",), ("/a/b/package.json",)], "file string")
    assert {r["path"]: r["manifest"] for r in readers.nearest_manifest(paths, have).collect()} == {"/a/b/c/x.js": "/a/b/package.json", "/a/y.js": "/a/package.json"}


def test_ancestors(spark):
    e = spark.createDataFrame([("t", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "t"), ("t", "t"), ("x", "y")], "child string, parent string")
    assert sorted((r["node"], r["depth"]) for r in graph.ancestors(e, "t").collect()) == [("a", 1), ("b", 2), ("c", 3)]
    assert [r["node"] for r in graph.dependents(e, "t").collect()] == ["a"]
    assert graph.ancestors(e, "none").count() == 0


def test_chunks_against_a_loop(spark):
    rng = random.Random(4)
    rows, want = [], set()
    for file in range(20):
        fams = sorted([rng.choice(["A", "B", "C", "D"]) for _ in range(rng.randint(0, 14))]) + [None] * rng.randint(0, 20)
        chunk, held, seen = 0, 0, set()
        for place, fam in enumerate(fams, 1):
            full = held >= 8 if fam is None else fam not in seen and (len(seen) >= 2 or held >= 8)
            if full and held:
                chunk, held, seen = chunk + 1, 0, set()
            held += 1
            seen |= {fam} - {None}
            rows.append((file, place, fam))
            want.add((file, place, chunk))
    rng.shuffle(rows)
    got = requests.chunks(spark.createDataFrame(rows, "file int, place int, family string"))
    assert {(r["file"], r["place"], r["chunk"]) for r in got.collect()} == want


def test_requests_and_answers(spark):
    rows = spark.createDataFrame([("f", "r1", 1, 5, "m1", "A"), ("f", "r2", 2, 3, "m2", "A"), ("f", "r3", 3, 9, "m3", None)], "file string, rule_id string, seq long, line int, message string, family string")
    got = {r["key"]: (r["line"], r["message"], r["n"]) for r in requests.consolidated(rows).collect()}
    assert got == {"family:A": (3, "m1\nm2", 2), "rule:r3:3": (9, "m3", 1)}
    asked = requests.prompts(requests.chunks(requests.ordered(rows.withColumn("priority", F.lit(1)))))
    assert [(r["answer"], r["ok"]) for r in requests.answers(asked).collect()] == [("", False)]
    assert [r["answer"] for r in requests.answers(asked, lambda f, p: f"{f}:{p.count('- line')}").collect()] == ["f:3"]
    many = spark.createDataFrame([(f, c, f"{f}{c}") for f in "abcd" for c in (0, 1, 2)], "file string, chunk int, prompt string")

    def client(file, prompt):
        if file == "b" and prompt.startswith("b1"):
            return " "
        if file == "c":
            raise TimeoutError("late")
        if file == "d" and prompt.startswith("d1"):
            raise ValueError("broken")
        return "after " + prompt.split("\n")[-1]

    done = requests.answers(many, client)
    got = {(r["file"], r["chunk"]): (r["answer"], r["ok"], r["tries"], r["error"]) for r in done.collect()}
    assert [got["a", c][0] for c in (0, 1, 2)] == ["after a0", "after after a0", "after after after a0"]
    assert got["b", 0][1] and got["b", 1] == (" ", False, 2, "empty answer") and got["b", 2] == ("", False, 0, None)
    assert got["c", 0] == ("", False, 2, "timeout: late") and got["d", 1] == ("", False, 1, "broken") and got["d", 2][2] == 0
    assert requests.answer_counts(done).collect() == [(1, 3, 1)]
    log = {r["file"]: json.loads(r["text"]) for r in requests.answer_log(done).collect()}
    assert (log["b"]["n_ok"], log["b"]["n_tries"], [c["chunk"] for c in log["b"]["chunks"]]) == (1, 3, [0, 1, 2])
    ask = spark.createDataFrame([("s", "r", 3, 1, "m", ["change-type=test-impact"], ["t2", "t1"]), ("s", "q", 4, 2, "m", ["x"], ["t3"])], "file string, rule_id string, line int, seq int, message string, labels array<string>, companion_tests array<string>")
    assert sorted((r["file"], r["rule_id"], r["line"]) for r in requests.with_test_requests(ask).collect()) == [("s", "q", 4), ("s", "r", 3), ("t1", "test-fix:r", 1), ("t2", "test-fix:r", 1)]
    sizes = spark.createDataFrame([(1, False), (1, True), (2, False), (30, False), (3, True), (40, True)], "n int, t boolean")
    assert [r[0] for r in sizes.select(requests.turns(F.col("n"), F.col("t"))).collect()] == [5, 15, 24, 40, 33, 50]


def test_families_without_noise(spark):
    noise = ["change-type=type-changed", "n"]
    rows = [
        ("f", "a", 1, 1, "its base class changed", "Card", "s1", noise, ["t2"]), ("f", "a", 2, 3, "Do it", "Card", "s2", ["l", "k"], ["t1"]), ("f", "b", 3, 5, "Do it", "Card", "s2", ["k"], None), ("f", "b", 4, 1, "RefAttributes of y", "Tab", None, ["change-type=signature-changed"], None),
        ("f", "c", 5, 7, "alone", None, "s", ["z"], None), ("f", "type-changed", 6, 9, "base class changed", "Row", None, ["l"], None), ("f", "d", 7, 8, "type changed from x", "Row", None, noise, None),  # neither is noise: no such label, no such text
    ]
    df = spark.createDataFrame(rows, "file string, rule_id string, seq int, line int, message string, family string, code_snip string, labels array<string>, companion_tests array<string>")
    got = {r["key"]: r for r in requests.consolidated(df).collect()}
    card = got["family:Card"]
    assert (card["line"], card["message"], card["n"], card["snippets"], card["labels"], card["companion_tests"]) == (3, "Do it", 3, ["s2"], ["l", "k"], ["t1", "t2"])
    assert (got["family:Row"]["line"], got["family:Row"]["message"]) == (8, "base class changed\ntype changed from x")
    assert got["family:Tab"]["message"] == "RefAttributes of y" and got["rule:c:5"]["snippets"] == ["s"]


def test_fix_blocks(spark):
    text = "LINE: 1\n```fix\nLINE: 2\nOLD:  a \nNEW: b\n\nOLD: c\nNEW: d\nLINE: 4\nOLD: e\nNEW:\n```\n```\nLINE: 5\nOLD: x\nNEW: y\n```"
    got = [(r["at_line"], r["old_text"], r["new_text"]) for r in requests.fix_blocks(lines(spark, text)).orderBy("at_line").collect()]
    assert got == [(2, " a", "b"), (4, "e", "")]


def test_labels(spark):
    df = spark.createDataFrame([(["change-type=test-impact", "family=X", "family=Y"],), (["change-type=test-impact", "change-type=b"],), ([],)], "labels array<string>")
    got = df.select(planning.test_impact_only(F.col("labels")).alias("t"), planning.family(F.col("labels")).alias("f")).collect()
    assert [(r["t"], r["f"]) for r in got] == [(True, "X"), (False, None), (False, None)]


def test_balanced_runs(spark):
    src = lines(spark, "a\nf(\n g(\n )\n)\nh(")
    starts = spark.createDataFrame([("f", 2), ("f", 3), ("f", 6), ("f", 1)], "file string, start int")
    got = {r["start"]: r["end"] for r in planning.balanced_runs(starts, src).collect()}
    assert got == {1: 1, 2: 5, 3: 4, 6: None}


def test_missing_peers(spark):
    log = "\x1b[93mYN0002\x1b[0m: │ app@workspace:. doesn't provide react (p1a2), requested by @s/lib.\nYN0002: @s/x@npm:1.0.0 doesn't provide vue (pb)\nYN0002: y@npm:1 doesn't provide react (pc), requested by z.\nYN0000: ok"
    assert sorted(tuple(r) for r in requests.missing_peers(lines(spark, log)).collect()) == [("react", "@s/lib"), ("vue", "@s/x")]


def test_answers_become_edits_of_lines_as_they_were_seen(spark):
    seen = lines(spark, "the one\nthe two\nthree")
    now = lines(spark, "the one\nchanged the two")
    blocks = spark.createDataFrame([("f", 1, 1, "the", "THE", "r"), ("f", 2, 1, "the", "THE", "r"), ("f", 2, 1, "none", "x", "r"), ("f", 3, 2, "the", "x", "r"), ("f", 3, 3, "three", "x", "r"), ("f", 4, 9, "x", "y", "r"), ("f", 5, 1, "", "y", "r")], "file string, block int, at_line int, old_text string, new_text string, rule_id string")
    got = requests.answer_edits(blocks, requests.line_digests(seen), now)
    assert sorted((r["line"], r["old_text"], r["outcome"]) for r in got.collect()) == [
        (1, "", "text_not_found_on_line"), (1, "none", "text_not_found_on_line"), (1, "the", "planned"), (1, "the", "repeated"), (2, "the", "stale"), (3, "three", "line_out_of_bounds"), (9, "x", "line_out_of_bounds")
    ]
    assert {(r["source"], r["confidence"], r["replace_all"]) for r in got.collect()} == {("llm", "medium", False)}


def test_lock_edges_as_by_lines(spark):
    """Odd indents, CR LF, lines before the first entry and entries without a name; neither plan sorts lines by a window."""
    yarn = '\n    "z": 1\n"a@npm:1":\r\n  version: 1\r\n\r\n  dependencies:\r\n    "@s/x": "npm:^2"\r\n      deep: 1\n odd: 1\n    y: 2\n    none\n  bin:\n    t: u\n# c:\n  dependencies:\n    n: 1\n'
    pnpm = "  k:\n    dependencies:\n      no: 1\nsnapshots:\n\n  '@p/a@1(x)':\r\n    dependencies:\r\n      '@s/b': 1\r\n        deep: 1\n odd:\n      lost: 1\n dependencies:\n      lost: 2\n    peerDependencies:\n      c: 2\nother:\n  k:\n    dependencies:\n      no: 1\n"
    frame = lambda t: spark.createDataFrame([("f", t)], "file string, text string")
    for text, whole, by_lines, want in ((yarn, readers.yarn_text_edges, readers.yarn_edges, {("@s/x", "a"), ("y", "a")}), (pnpm, readers.pnpm_text_edges, readers.pnpm_edges, {("@s/b", "@p/a"), ("c", "@p/a")})):
        assert {(r["child"], r["parent"]) for r in whole(frame(text)).collect()} == want
        got = by_lines(readers.source_lines(frame(text)))
        assert {(r["child"], r["parent"]) for r in got.collect()} == want
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_missing_peers_in_odd_lines(spark):
    """A line with what lacks before the code names no peer and ends nothing; escapes may stand within words."""
    log = "x doesn't provide y\n[1] a doesn't provide b YN0002: c\n\x1b[1mYN00\x1b[0m02: │ w@1 doesn't provide p (p1), requested by @s/q@2."
    got = requests.missing_peers(lines(spark, log))
    assert [tuple(r) for r in got.collect()] == [("p", "@s/q")]


def test_runs_make_depths_once(spark):
    """Lines are read character by character once, before what is asked of their depths."""
    text = lines(spark, "<a b={{\n x: 1,\n}}\n>")
    runs = planning.balanced_runs(spark.createDataFrame([("f", 1)], "file string, start int"), text)
    assert [tuple(r) for r in runs.collect()] == [("f", 1, 3)]
    assert "aggregate(" not in runs._jdf.queryExecution().optimizedPlan().toString()


def test_changed_files_take_one_pass_over_lines(spark):
    """Lines meet edits once, and ends are found without a pattern."""
    texts = spark.createDataFrame([("a", "x\r\ny\r\n"), ("b", "y"), ("c", "x\n\n"), ("d", "x\r"), ("e", None)], "file string, text string")
    assert {r["file"]: r["ending"] for r in ed.endings(texts).collect()} == {"a": "\r\n", "b": "", "c": "\n", "d": "", "e": ""}
    lines = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "y"), ("c", 1, "x"), ("c", 2, "")], "file string, line int, text string")
    edits = spark.createDataFrame([("a", 1, 0, "x", "z", "r", True), ("b", 1, 0, "x", "z", "r", True), ("c", 1, 0, "x", "z", "r", False)], "file string, line int, seq int, old_text string, new_text string, rule_id string, replace_all boolean")
    found = ed.changed_files(edits, lines, ed.endings(texts))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 3 and "regexp" not in plan.lower()
    assert sorted((r["file"], r["text"]) for r in found.collect()) == [("a", "z\ny\r\n"), ("c", "z\n\n")]
