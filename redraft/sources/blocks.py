"""Reports in YAML's block style as DataFrames: an indentation tree by one window over a file's lines.

Each line is a node at its indent (a list's dash one of its own, half a step deeper).  The window carries forward, for every indent, the last node at it.  A node's ancestors are
those of its shallower last nodes that come after all still shallower ones, so its whole path is at hand without a join.

Read are mappings and lists in block style, plain, single and double quoted scalars, block scalars (| and >) and plain scalars that run over several lines.  Flow
style is read for empty lists and maps only; anchors, tags and lists in lists are not read.  A line of a block scalar that itself looks like the head of one ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redraft.functions.text import lines_of

#: Blanks of the deepest indent that is read; reports need some ten.
DEEPEST = 18
_KEY = r"""^("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s'"#].*?):(?:\s+(.*))?$"""
_SCALAR = r"(?:^|:\s+|-\s+)([|>])([+-]?)\s*$"


def _plain(value: Column) -> Column:
    """A scalar's text; null for null."""
    v = F.trim(value)
    double = F.get(F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>"), 0)
    single = F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit("''"), F.lit("'"))
    bare = F.rtrim(F.regexp_replace(v, r"\s+#.*$", ""))
    return F.when(v.rlike('^".*"$'), double).when(v.rlike("^'.*'$"), single).when(bare.isin("", "~", "null", "[]", "{}"), None).otherwise(bare)


def _as_json(value: Column, quoted: Column) -> Column:
    """A scalar as JSON: numbers and truth values as such unless quoted."""
    text = F.to_json(F.named_struct(F.lit("v"), value))
    text = F.substring(text, F.lit(6), F.length(text) - 6)
    return F.when(value.isNull(), "null").when(~quoted & value.rlike(r"^(-?(0|[1-9][0-9]*)(\.[0-9]+)?|true|false)$"), value).otherwise(text)


def nodes(reports: DataFrame, text_col: str = "text") -> DataFrame:
    """(report, at, path, labels, value, quoted) of the nodes of YAML texts (file, text): the places and labels of a node's ancestors and itself (a key, or - for an item), and its scalar."""
    report = F.col("file").cast("string") if "file" in reports.columns else F.lit("")
    lines = reports.select(report.alias("report"), F.posexplode(lines_of(F.coalesce(F.col(text_col), F.lit("")))).alias("n", "raw"))
    body, blank = F.ltrim("raw"), F.trim("raw") == ""
    indent = F.when(~blank, F.length("raw") - F.length(body))
    order = Window.partitionBy("report").orderBy("n")
    head = F.col("raw").rlike(_SCALAR) & ~body.startswith("#")
    lines = lines.select("report", "n", "raw", indent.alias("indent"), head.alias("head"))
    # a dash before the head's key moves what it may hold to the right of the dash
    lines = lines.withColumn("scalar", F.sum(F.col("head").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = Window.partitionBy("report", "scalar").orderBy("n")
    lines = lines.withColumn("head_indent", F.first("indent").over(own)).withColumn("least", F.min(F.when(~F.col("head"), F.col("indent"))).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = (F.col("scalar") > 0) & ~F.col("head") & F.coalesce(F.col("least") > F.col("head_indent"), F.lit(True))
    lines = lines.withColumn("inside", inside)
    texts = lines.where("inside").groupBy("report", "scalar").agg(F.array_sort(F.collect_list(F.struct("n", "raw", "indent"))).alias("all"))
    step = F.get(F.filter(F.transform("all", lambda x: x["indent"]), lambda i: i.isNotNull()), 0)
    content = texts.select("report", "scalar", F.regexp_replace(F.array_join(F.transform("all", lambda x: F.substring(x["raw"], step + 1, F.length(x["raw"]))), "\n"), "\n+\\z", "").alias("content"))

    rest = lines.where(~F.col("inside") & F.col("indent").isNotNull() & ~F.ltrim("raw").startswith("#") & ~F.col("raw").rlike(r"^(---|\.\.\.)\s*$"))
    body = F.trim("raw")
    dash = body.rlike(r"^-(\s|$)")
    after = F.regexp_replace(body, r"^-\s*", "")
    keyed = lambda t: t.rlike(_KEY)
    inner = F.col("indent") + F.length(body) - F.length(after)
    none = F.lit(None).cast("string")
    node = lambda level, label, value: F.struct(level.cast("int").alias("level"), label.alias("label"), value.alias("value"))
    key_node = lambda level, t: node(2 * level, _plain(F.regexp_extract(t, _KEY, 1)), F.regexp_extract(t, _KEY, 2))
    item = lambda value: node(2 * F.col("indent") + 1, F.lit("-"), value)
    made = F.when(dash & keyed(after), F.array(item(none), key_node(inner, after))).when(dash, F.array(item(after))).when(keyed(body), F.array(key_node(F.col("indent"), body))).otherwise(F.array(node(F.lit(-1), none, body)))
    rows = rest.select("report", "n", "head", "scalar", F.posexplode(made).alias("k", "x")).select("report", (2 * F.col("n") + F.col("k")).alias("at"), "head", "scalar", "x.*")
    # a line that is no node goes on with the scalar of the one before it
    order = Window.partitionBy("report").orderBy("at")
    rows = rows.withColumn("of", F.last(F.when(F.col("level") >= 0, F.col("at")), ignorenulls=True).over(order))
    rows = rows.groupBy("report", "of").agg(
        F.max(F.when(F.col("level") >= 0, F.struct("level", "label", "head", "scalar"))).alias("x"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("value", F.lit("")).alias("value")))), lambda v: v["value"]), " ").alias("value")
    )
    rows = rows.where("of is not null").select("report", F.col("of").alias("at"), "x.*", "value")
    rows = rows.join(content, ["report", "scalar"], "left")
    is_head = F.col("head") & F.col("value").rlike(r"^[|>][+-]?$")
    text = F.when(F.col("value").startswith(">"), F.regexp_replace(F.coalesce("content", F.lit("")), "(?<!\n)\n(?!\n)", " ")).otherwise(F.coalesce("content", F.lit("")))
    block = F.concat(text, F.when(F.col("value").endswith("-"), "").otherwise("\n"))
    rows = rows.select("report", "at", "level", "label", F.when(is_head, block).otherwise(_plain(F.col("value"))).alias("value"), (is_head | F.trim("value").rlike("^[\"']")).alias("quoted"))

    seen = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.last(F.when(F.col("level") == c, F.struct("at", "label")), ignorenulls=True).over(seen) for c in range(2 * DEEPEST + 2)]
    rows = rows.withColumn("last", F.array(*last))
    chain = "array<struct<at:int,label:string>>"
    path = F.aggregate(F.slice("last", 1, F.col("level") + 1), F.array().cast(chain), lambda found, x: F.when(x.isNotNull() & (F.coalesce(F.get(found, F.size(found) - 1)["at"], F.lit(-1)) < x["at"]), F.concat(found, F.array(x))).otherwise(found))
    rows = rows.where(f"level < {2 * DEEPEST + 2}").withColumn("path", path)
    return rows.select("report", "at", F.transform("path", lambda x: x["at"]).alias("path"), F.transform("path", lambda x: x["label"]).alias("labels"), "value", "quoted")


def findings(reports: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of readers.findings from YAML reports (file, text)."""
    rows = nodes(reports, text_col).where("labels[0] = '-'")
    label = lambda i: F.get("labels", i)
    depth = F.size("labels")
    sets = rows.groupBy("report", F.col("path")[0].alias("set")).agg(F.max(F.when((depth == 2) & (label(1) == "name"), F.col("value"))).alias("ruleset"))
    sets = sets.withColumn("ruleset_ix", F.row_number().over(Window.partitionBy("report").orderBy("set")) - 1)
    found = rows.where((label(1) == "violations") & (depth >= 4)).select("*", F.col("path")[0].alias("set"), label(2).alias("rule_id"))
    tags = found.where((label(3) == "labels") & (depth == 5)).groupBy("report", "set", "rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("labels"))
    own = found.where((label(3) == "incidents") & (depth >= 5)).withColumn("item", F.col("path")[4])
    # an item that has keys has a node of its own
    field = lambda *names: F.max(F.when((depth == 6) & label(5).isin(*names), F.col("value")))
    fields = own.groupBy("report", "set", "rule_id", "item").agg(field("uri", "fileUri", "file_uri").alias("file_uri"), field("lineNumber", "line_number").alias("line"), field("message").alias("message"), field("codeSnip", "code_snip").alias("code_snip"), F.max((depth == 6) & (label(5) == "variables")).alias("has_variables"))
    given = own.where((label(5) == "variables") & (depth >= 7)).withColumn("name", label(6))
    each = given.groupBy("report", "set", "rule_id", "item", "name").agg(
        F.max(F.when(depth == 7, F.struct("value", "quoted"))).alias("one"), F.array_sort(F.collect_list(F.when(depth == 8, F.struct("at", _as_json(F.col("value"), F.col("quoted")).alias("j"))))).alias("many")
    )
    literal = F.when(F.size("many") > 0, F.concat(F.lit("["), F.array_join(F.transform("many", lambda x: x["j"]), ","), F.lit("]"))).otherwise(_as_json(F.col("one.value"), F.col("one.quoted")))
    variables = each.select("report", "set", "rule_id", "item", "name", F.parse_json(literal).alias("v")).groupBy("report", "set", "rule_id", "item").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("variables"))
    keys = ["report", "set", "rule_id"]
    out = fields.join(variables, [*keys, "item"], "left").join(tags, keys, "left").join(sets, ["report", "set"])
    ix = F.row_number().over(Window.partitionBy(*keys).orderBy("item")) - 1
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    return out.select(
        "report", "ruleset_ix", "ruleset", "rule_id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), ix.alias("incident_ix"), "file_uri", F.col("line").cast("int").alias("line"),
        "message", "code_snip", F.coalesce("variables", F.when(F.col("has_variables"), empty)).alias("variables"),
    )
