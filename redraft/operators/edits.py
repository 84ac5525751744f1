"""Edits as rows (file, line, seq, old_text, new_text, rule_id, replace_all): settle overlaps, apply, show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redraft.functions.text import replace_all, replace_first

_LINE = ["file", "line"]


def without_repeats(edits: DataFrame) -> DataFrame:
    """Of the same change to the same line the first."""
    keys = [*_LINE, "old_text", "new_text"]
    rest = [c for c in edits.columns if c not in keys]
    best = edits.groupBy(*keys).agg(F.min(F.struct("seq", *[c for c in rest if c != "seq"])).alias("r"))
    return best.select(*[c if c in keys else F.col(f"r.{c}").alias(c) for c in edits.columns])


def settled(edits: DataFrame) -> DataFrame:
    """Edits that stay when those on a line overlap.

    Of edits with the same old text the first stays.  An old text that lies in another edit's old text
    stays only if it and every edit that stays and contains it replace all occurrences.
    The edits of a line, a few whatever the corpus, are gathered once and compared as an array: the input is read once and shuffled once.
    """
    rest = [c for c in edits.columns if c not in _LINE]
    own = edits.groupBy(*_LINE).agg(F.collect_list(F.struct(*rest)).alias("edits"))
    same = lambda x, y: x["old_text"] == y["old_text"]
    within = lambda x, y: (x["old_text"] != y["old_text"]) & F.contains(y["old_text"], x["old_text"])

    def placed(x: Column) -> Column:
        earlier = lambda y: same(x, y) & (y["seq"] < x["seq"])
        return F.struct(x.alias("edit"), F.exists("edits", lambda y: within(x, y)).alias("nested"), (~F.exists("edits", earlier)).alias("first"), (~F.exists("edits", lambda y: earlier(y) & y["replace_all"])).alias("first_of_all"))

    marked = own.select(*_LINE, F.transform("edits", placed).alias("edits"))
    marked = marked.withColumn("blockers", F.filter("edits", lambda y: ~y["nested"] & y["first"] & ~y["edit"]["replace_all"]))
    free = lambda x: x["edit"]["replace_all"] & x["first_of_all"] & ~F.exists("blockers", lambda y: within(x["edit"], y["edit"]))
    stay = F.transform(F.filter("edits", lambda x: F.when(x["nested"], free(x)).otherwise(x["first"])), lambda x: x["edit"])
    return marked.select(*_LINE, F.explode(stay).alias("e")).select(*[c if c in _LINE else F.col(f"e.{c}").alias(c) for c in edits.columns])


def subsumed(edits: DataFrame) -> DataFrame:
    """(n_subsumed): how many edits do not stay."""
    return edits.agg(F.count("*").alias("n")).crossJoin(settled(edits).agg(F.count("*").alias("k"))).select((F.col("n") - F.col("k")).alias("n_subsumed"))


def merged_inserts(edits: DataFrame) -> DataFrame:
    """Insertions before the same line become one edit, by the first: their distinct new texts in order."""
    first = F.min_by("rule_id", "seq").alias("rule_id")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "new_text"))), lambda x: x["new_text"])
    made = edits.groupBy(*_LINE, "old_text").agg(F.min("seq").alias("seq"), F.array_join(F.array_distinct(texts), ",\n").alias("new_text"), first)
    return made.select("file", "line", "seq", "old_text", "new_text", "rule_id", F.lit(False).alias("replace_all"))


def outcomes(edits: DataFrame, lines: DataFrame) -> DataFrame:
    """Each edit with what it meets: applied, text_not_found_on_line or line_out_of_bounds, and the line as it is or the number of lines."""
    sizes = lines.groupBy("file").agg(F.max("line").alias("total_lines"))
    met = edits.join(lines.select("file", "line", F.col("text").alias("actual_line")), _LINE, "left").join(sizes, "file", "left")
    reason = F.when(F.col("actual_line").isNull(), "line_out_of_bounds").when(F.contains("actual_line", "old_text"), "applied").otherwise("text_not_found_on_line")
    return met.select(*edits.columns, reason.alias("outcome"), "actual_line", F.coalesce("total_lines", F.lit(0)).alias("total_lines"))


def failures(edits: DataFrame, lines: DataFrame) -> DataFrame:
    return outcomes(edits, lines).where("outcome <> 'applied'")


def _of_lines(edits: DataFrame) -> DataFrame:
    """(file, line, edits): the edits of a line, longest old text first."""
    return edits.groupBy(*_LINE).agg(F.array_sort(F.collect_list(F.struct((-F.octet_length("old_text")).alias("o"), "old_text", "seq", "new_text", "replace_all"))).alias("edits"))


def _after() -> Column:
    """A line's text after its edits, each on what the one before left."""
    apply = lambda t, e: F.when(e["replace_all"], replace_all(t, e["old_text"], e["new_text"])).otherwise(replace_first(t, e["old_text"], e["new_text"]))
    return F.aggregate("edits", F.col("text"), apply)


def changed_lines(edits: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, line, before, after) of lines that edits change: longest old text first, each on what the one before left."""
    rows = lines.join(_of_lines(edits), _LINE).select("file", "line", F.col("text").alias("before"), _after().alias("after"))
    return rows.where("before <> after")


def apply_edits(edits: DataFrame, lines: DataFrame) -> DataFrame:
    """All lines, with what edits make of them; lines meet edits once."""
    rows = lines.join(_of_lines(edits), _LINE, "left").select("file", "line", "text", F.when(F.col("edits").isNotNull(), _after()).alias("after"))
    return rows.select("file", "line", F.coalesce("after", "text").alias("text"), F.coalesce(F.col("after") != F.col("text"), F.lit(False)).alias("changed"))


def endings(texts: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """(file, ending): what stands behind the last line of each text: CR LF, LF or nothing."""
    text = F.col(text_col)
    return texts.select(F.col(file_col).alias("file"), F.when(text.endswith("\r\n"), "\r\n").when(text.endswith("\n"), "\n").otherwise("").alias("ending"))


def _joined() -> Column:
    """The text of a group's lines."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")


def rebuilt_files(lines: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(file, text) from lines; ends gives (file, ending), which goes after the last line."""
    return _ended(lines.groupBy("file").agg(_joined().alias("text")), ends)


def _ended(rows: DataFrame, ends: DataFrame | None) -> DataFrame:
    return rows if ends is None else rows.join(ends, "file", "left").select("file", F.concat("text", F.coalesce("ending", F.lit(""))).alias("text"))


def changed_files(edits: DataFrame, lines: DataFrame, ends: DataFrame) -> DataFrame:
    """(file, text) of the files that edits change, with what stood behind their last line."""
    after = apply_edits(edits, lines.join(edits.select("file").distinct(), "file", "left_semi"))
    return _ended(after.groupBy("file").agg(_joined().alias("text"), F.bool_or("changed").alias("changed")).where("changed").select("file", "text"), ends)


def diff_hunks(edits: DataFrame, lines: DataFrame, around: int = 3) -> DataFrame:
    """(file, line, first_line, n_lines, hunk): one preview hunk for each changed line with the lines around it as they become.

    Only changed lines are spread over the numbers around them, so what moves is their surroundings, not the corpus.
    """
    changed = changed_lines(edits, lines)
    spread = changed.select("file", F.col("line").alias("at"), F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("line")).where("line >= 1")
    near = spread.join(lines, _LINE).join(changed.select("file", "line", "after"), _LINE, "left")
    shown = F.when(F.col("after").isNotNull(), F.concat(F.lit("-"), "text", F.lit("\n+"), "after")).otherwise(F.concat(F.lit(" "), "text"))
    hunks = near.groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("line", shown.alias("s")))).alias("all"))
    body = F.array_join(F.transform("all", lambda x: x["s"]), "\n")
    return hunks.select("file", F.col("at").alias("line"), F.col("all")[0]["line"].alias("first_line"), F.size("all").alias("n_lines"), body.alias("hunk"))


def blank_repeated_imports(lines: DataFrame, prefix: str = "import ") -> DataFrame:
    """Later lines of a file that repeat an import line are emptied, so that line numbers stay."""
    key = F.trim("text")
    imports = lines.where(key.startswith(prefix)) if prefix else lines.where(key != "")
    first = imports.groupBy("file", key.alias("key")).agg(F.min("line").alias("first_line"))
    rows = lines.withColumn("key", key).join(first, ["file", "key"], "left")
    return rows.select("file", "line", F.when(F.col("first_line") < F.col("line"), "").otherwise(F.col("text")).alias("text"))
