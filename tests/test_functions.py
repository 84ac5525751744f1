"""Scalar functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from redraft.functions import text as tx
from redraft.functions import versions as vs


def one(spark, column, **values):
    kinds = {str: "string", int: "int", type(None): "string", list: "array<string>"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "lines"),
    [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("\n", [""]), ("a\r\nb", ["a", "b"]), ("a\r\nb\r\n", ["a", "b"]), ("a\rb", ["a\rb"]), ("\na", ["", "a"])],
)
def test_lines(spark, text, lines):
    assert one(spark, tx.lines_of(F.col("t")), t=text) == lines


@pytest.mark.parametrize(
    ("line", "old", "new", "want"),
    [
        ("List<Foo> x", "Foo", "Bar", "List<Bar> x"), ("FooBar x", "Foo", "Bar", "FooBar x"), ("MyFoo x", "Foo", "Bar", "MyFoo x"), ("Foo_x", "Foo", "Bar", "Foo_x"), ("Foo Foo", "Foo", "Bar", "Bar Bar"),
        ("new Foo()", "Foo", "Bar", "new Bar()"), ("Foo.x(Foo)", "Foo", "Bar", "Bar.x(Bar)"), ("", "Foo", "Bar", ""), ("Foo9", "Foo", "Bar", "Foo9"), ("@Foo", "Foo", "B$1\\", "@B$1\\"), ("a.b", "a.b", "c", "c"), ("aXb", "a.b", "c", "aXb"), ("Foo", "Foo", "Foo", "Foo"),
    ],
)
def test_word_rename(spark, line, old, new, want):
    assert one(spark, tx.replace_words(F.col("t"), old, new), t=line) == want


def test_literal_replacement(spark):
    assert one(spark, tx.replace_first(F.col("t"), "a.", "$1"), t="xa.a.") == "x$1a."
    assert one(spark, tx.replace_all(F.col("t"), "a.", "\\"), t="xa.a.") == "x\\\\"
    assert one(spark, tx.replace_first(F.col("t"), F.col("o"), F.col("n")), t="aba", o="a", n="") == "ba"
    assert one(spark, tx.replace_first(F.col("t"), "", "x"), t="aba") == "aba" == one(spark, tx.replace_all(F.col("t"), "", "x"), t="aba")


@pytest.mark.parametrize(("line", "depth"), [("", 0), ("f(x", 1), ("f(x)", 0), ("})", -2), ("a={[(", 3), ("'('", 0), ('"[" (', 1), ("`{`}", -1), (r"'\'(' (", 1), ('"a\'b" (', 1)])
def test_bracket_depth(spark, line, depth):
    assert one(spark, tx.bracket_depth(F.col("t")), t=line) == depth


def test_specifiers(spark):
    dedup = lambda t: one(spark, tx.unique_specifiers(F.col("t")), t=t)
    assert dedup("import { A, B , A,, C } from 'x';") == "import { A, B, C } from 'x';"
    assert dedup("import A from 'x';") == "import A from 'x';"


def test_sections(spark):
    found = lambda t: one(spark, tx.section(F.col("t")), t=t)
    assert found("a\n## Summary\nx\n## Changes Applied\ny\n## End\nz") == "## Changes Applied\ny"
    assert found("b ## Summary of changes\n only \n") == "## Summary of changes\n only"
    assert found("nothing") is None


def test_paths(spark):
    assert one(spark, tx.path_of_uri(F.col("u"), "/r/"), u="file:///a/b") == "/a/b"
    assert one(spark, tx.path_of_uri(F.col("u"), "/r/"), u="a/b") == "/r/a/b"
    assert one(spark, tx.file_uri(F.col("u"), "/r"), u=" a ") == "file:///r/a"
    assert one(spark, tx.file_uri(F.col("u"), "/r"), u="file:///x") == "file:///x"
    assert one(spark, tx.skips_path(F.col("u")), u="/a/node_modules/b.js") and not one(spark, tx.skips_path(F.col("u")), u="/a/my_node_modules/b.js")


def test_attributes_and_annotations(spark):
    assert one(spark, tx.without_attribute(F.col("t"), "is"), t='<A is isOpen is="x" is={y} b/>') == "<A isOpen b/>"
    assert one(spark, tx.without_annotation(F.col("t"), "Old"), t='  @Old(since = "1") int x;') == "int x;"
    assert one(spark, tx.without_annotation(F.col("t"), "Old"), t="@Older int x;") == "@Older int x;"


@pytest.mark.parametrize(("version", "n"), [("1.2.3", 1), ("^5.0.0", 5), ("~>=2", 2), (">=10.1", 10), ("x", 0), ("", 0), ("v1", 0)])
def test_major(spark, version, n):
    assert one(spark, vs.major(F.col("v")), v=version) == n


@pytest.mark.parametrize(("version", "parts"), [("1.2.3", [1, 2, 3]), ("1.2", [1, 2, 0]), ("7", [7, 0, 0]), ("1.2.3-beta.1", [1, 2, 3]), ("x.1", None), ("1.x", [1, 0, 0])])
def test_parts(spark, version, parts):
    assert one(spark, vs.parts(F.col("v")), v=version) == parts


#: (required, consumer, whether all of the consumer's is allowed)
RANGES = [
    ("^5.0.0", "^5.1.0", True), ("^5.1.0", "^5.0.0", False), ("^5.0.0", "^6.0.0", False), (">=5.0.0", "^6.0.0", True), ("^5.0.0", ">=5.0.0", False), ("~1.2.0", "1.2.9", True), ("~1.2.0", "1.3.0", False),
    ("^0.2.1", "0.2.9", True), ("^0.2.1", "0.3.0", False), ("^0.0.3", "0.0.3", True), ("^0.0.3", "0.0.4", False), ("*", "^9.0.0", True), ("1.x", "~1.9.9", True), ("workspace:*", "1.0.0", False), ("^1.0.0", "latest", False), ("<2.0.0", "1.9.9", True), ("<=2.0.0", "2.0.0", True), (">1.0.0", "1.0.0", False),
    ("^17 || ^18 || ^19", "^17.0.1", True), ("^17 || ^19", "^18.0.0", False), ("^17 || ^18", "^17 || ^18.1", True), ("^17", "^17 || ^18", False), ("1.0.0 - 2.0.0", "^1.2.0", True), ("1.0.0 - 1.5.0", "^1.2.0", False), (">=1.2.0 <2.0.0", "~1.3.0", True), (">= 1.2.0 < 1.3.0", "^1.2.0", False), ("^1 || x y", "2.0.0", False),
    ("^6.0.0", "^6.30.3-pre-v6.0", True), (">=0.0.0", "^17 || ^18", True), ("^1.0.0", "git+ssh://foo", False), ("^17.0.3", "^11.7.3", False), ("^6.4.1", "^6.4.2", True), ("^6.4.1", "^6.4.1", True),
    ("^1 || ^2", ">=1.0.0 <3.0.0", True), ("^1 || ^3", ">=1.0.0 <3.0.0", False), ("^2 || ^1", ">=1.5.0 <2.5.0", True), ("<=1.2.3 || >=1.2.4", "*", True), ("<1.2.3 || >1.2.3", "*", False), ("1.2.3 || 1.2.4", ">=1.2.3 <=1.2.4", True),
    (">=1.0.0-rc.1", "1.0.0-rc.2", True), (">=1.0.0-rc.2", "1.0.0-rc.1", False), (">=1.0.0-rc.2", "1.0.0-rc.10", True), (">=1.0.0-rc.10", "1.0.0-rc.2", False), (">=1.0.0-2", "1.0.0-alpha", True), (">=1.0.0-alpha", "1.0.0-2", False), (">=1.0.0-rc", "1.0.0-rc.0", True), (">=1.0.0-rc.0", "1.0.0-rc", False),
    (">=1.0.0-rc.1", "1.0.0", True), (">=1.0.0", "1.0.0-rc.1", False), ("^1 || ^2", "2.0.0-rc.1", False), ("^1 || ^2", ">=2.0.0-rc.1 <3.0.0", False), ("^1.2.3-beta", "^1.2.3", True), ("^1.2.3", "^1.2.3-beta", False), ("^1", "<2.0.0-rc.3", False), ("~1.2.3-beta.2", "1.2.3-beta.11", True),
    ("1.0.0-rc.1", "1.0.0-rc.1", True), ("1.0.0-rc.1", "1.0.0-rc.1.0", False), ("<1.0.0-rc.1", "<1.0.0", True), ("<1.0.0", "<1.0.0-rc.1", False), (">1.0.0-rc.1", "1.0.0-rc.1", False), ("<=1.0.0-rc.1", "<=1.0.0-rc.1", True),
    ("1.2.3+build", "=v1.2.3+other", True), ("~>1.2", "1.2.9", True), (">2 <1", "1.0.0", False), ("*", ">2 <1", False), ("", "1.0.0", True), ("1 - 2", ">=1.0.0 <3.0.0", True), ("1.0.0 - 2.0.0-rc.1", "2.0.0-rc.0", True), (">1", "2.0.0", True), (">1", "1.9.9", False), ("<=1", "1.9.9", True), ("^1.0.0-01", "1.0.0-1", True),
]


def test_ranges(spark):
    rows = spark.createDataFrame(RANGES, "required string, consumer string, ok boolean")
    wrong = rows.withColumn("found", vs.range_allows(F.col("required"), F.col("consumer"))).where("found is distinct from ok").collect()
    assert not wrong and rows.count() > 60


@pytest.mark.parametrize(
    ("line", "name", "without", "first"),
    [
        ('<A class="x" b>', "class", "<A b>", ' class="x"'), ("<A foo={ {a: '}'} } bar={1}>", "foo", "<A bar={1}>", " foo={ {a: '}'} }"), ("<A class>", "class", "<A>", " class"), ('<A classy="1">', "class", '<A classy="1">', None),
        ("<A class='q' class=\"z\"/>", "class", "<A/>", " class='q'"), ('<A class="open', "class", '<A class="open', None), ("<A on={() => {", "on", "<A on={() => {", None), ("<A on=x>", "on", "<A on=x>", None), ("", "a", "", None), ("<A a.b>", "a.b", "<A>", " a.b"),
    ],
)
def test_attributes(spark, line, name, without, first):
    assert one(spark, tx.without_attribute(F.col("t"), name), t=line) == without and one(spark, tx.first_attribute(F.col("t"), F.lit(name)), t=line) == first


@pytest.mark.parametrize(("line", "want"), [("import { a, b,a } from 'x'", "import { a, b } from 'x'"), ("  import type {a,a} from 'y'", "  import type { a } from 'y'"), ("import x, {a,a} from 'y'", "import x, {a,a} from 'y'"), ("f {a,a} from", "f {a,a} from"), ("import {a,a}", "import {a,a}")])
def test_import_names(spark, line, want):
    assert one(spark, tx.unique_specifiers(F.col("t")), t=line) == want


def test_ranges_are_read_once(spark):
    """The plan of a check of two ranges has each pattern a few times at most, and odd specs are read as before."""
    frame = spark.createDataFrame([(">=1.0.0 ", "^1.2.3"), ("1\x011\x011", "1"), ("", "^1"), (None, "1"), ("^1 || ^2", ">=1.0.0 <3.0.0"), ("1.2.3-rc.1+b", "1.2.3-rc.1")], "a string, b string")
    out = frame.select(vs.range_allows(F.col("a"), F.col("b")).alias("x"))
    assert [r["x"] for r in out.collect()] == [True, False, True, False, True, True]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("~>") <= 8


def test_lines_are_cut_without_patterns(spark):
    texts = ["", "\n", "\r\n", "a", "a\n", "a\r\n\r\n", "\r\r\nb\r", "a\n\n b\r\nc\r\n", "ä\n \n", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = frame.select("i", tx.lines_of(F.col("t")).alias("ls"))
    want = [[], [""], [""], ["a"], ["a"], ["a", ""], ["\r", "b\r"], ["a", "", " b", "c"], ["ä", " "], None]
    assert [r["ls"] for r in out.orderBy("i").collect()] == want
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()
