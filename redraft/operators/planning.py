"""Planners: rows of edits, and rows of what is skipped, from incidents, source lines and strategies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redraft.functions import versions as vs
from redraft.functions.text import attribute_start, bracket_depth, contains_any, first_attribute, replace_all, replace_words, without_annotation, without_attribute
from redraft.operators.graph import saved
from redraft.operators.matching import mapping_hits

#: Label values and the strategy they stand for when a rule has none (fixed values).
INFERRED = {
    "change-type=prop-removal": "RemoveAttribute", "change-type=dom-structure": "Manual", "change-type=behavioral": "Manual", "change-type=accessibility": "Manual",
    "change-type=interface-removal": "Manual", "change-type=module-export": "Manual", "change-type=other": "Manual",
}
#: Strategies that a model carries out, with what it is told (fixed values).
ASSISTED = ("PropValueChange", "PropTypeChange", "LlmAssisted", "ChildToProp", "PropToChild", "PropToChildren", "CompositionChange", "DeprecatedMigration", "FamilyMigration", "UpdateSignature")
#: Reasons why an incident makes no edit, and how a report words them (fixed values).
SKIP_TEXTS = {
    "file_unreadable": "file unreadable", "no_line_number": "no line number", "text_not_found": "text not found", "line_out_of_bounds": "line out of bounds", "already_migrated": "already migrated",
    "unbalanced_brackets": "unbalanced brackets", "missing_variable": "missing variable", "no_op_rename": "no-op rename", "not_in_import_block": "not in import block", "empty_llm_response": "empty LLM response",
    "llm_error": "LLM error", "no_compatible_version": "no compatible version", "package_json_not_found": "package.json not found", "version_already_compatible": "version already compatible",
}


#: Reasons that tell of work done before, and that of renames that change nothing (fixed values).
DONE_BEFORE, NO_CHANGE = ("already_migrated", "version_already_compatible"), "no_op_rename"


def skip_group(reason: Column) -> Column:
    """`real` for a skip that someone should look at, `informational` for work done before, null for a rename that changes nothing."""
    return F.when(reason.isin(*DONE_BEFORE), "informational").when(reason != NO_CHANGE, "real")


def strategy_kind(entry: str = "entry") -> Column:
    """What a strategy entry comes to: its own kind where the fields it needs are there, else Manual."""
    e = F.col(entry)
    ends = e["from"].isNotNull() & e["to"].isNotNull()
    mapped = F.exists(F.coalesce(e["mappings"], F.array().cast("array<struct<from:string,to:string,component:string,prop:string>>")), lambda m: m["from"].isNotNull() & m["to"].isNotNull())
    plain = (F.trim(e["from"]) != "") & (F.trim(e["to"]) != "") & ~F.contains(F.trim(e["from"]), F.lit(" ")) & ~F.contains(F.trim(e["to"]), F.lit(" ")) & ~F.contains(e["from"], F.lit("<"))
    kind = e["strategy"]
    return (
        F.when(kind == "Rename", F.when(mapped | ends, "Rename").otherwise("Manual"))
        .when(kind == "RemoveProp", "RemoveAttribute")
        .when(kind.isin("CssVariablePrefix", "ImportPathChange", "JavaImportRename"), F.when(ends, kind).otherwise("Manual"))
        .when(kind == "EnsureDependency", F.when(e["package"].isNotNull() & e["new_version"].isNotNull(), kind).otherwise("Manual"))
        .when(kind == "UpdateType", F.when(~ends, "Manual").when(plain, "Rename").otherwise("Llm"))
        .when(kind.isin(*ASSISTED), "Llm")
        .otherwise("Manual")
    )


def inferred_kind(labels: Column) -> Column:
    """Strategy of the first label that stands for one."""
    table = F.create_map(*[F.lit(x) for pair in INFERRED.items() for x in pair])
    return F.get(F.filter(F.transform(labels, lambda x: table[x]), lambda x: x.isNotNull()), 0)


def resolved(incidents: DataFrame, strategies: DataFrame) -> DataFrame:
    """Incidents with the kind of their rule's strategy, else of their labels, else Llm.  The join picks broadcast or shuffle by size."""
    kinds = strategies.select("rule_id", F.col("kind").alias("own_kind"))
    return incidents.join(kinds, "rule_id", "left").withColumn("kind", F.coalesce("own_kind", inferred_kind(F.col("labels")), F.lit("Llm"))).drop("own_kind")


def first_text(*values: Column) -> Column:
    """The first value that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def whole_file_edits(lines: DataFrame, mappings: DataFrame) -> DataFrame:
    """(file, line, old_text, new_text): each mapping that a line contains, unless a longer one on that line contains it.

    Mappings (old_text, new_text) are a strategy's few rows; they are gathered into one array next to the lines, so lines are read once and never shuffled.
    """
    table = mappings.where("old_text <> new_text and old_text <> ''").agg(F.array_sort(F.collect_set(F.struct((-F.octet_length("old_text")).alias("o"), "old_text", "new_text"))).alias("m"))
    hit = F.filter("m", lambda x: F.contains(F.col("text"), x["old_text"]))
    alone = F.filter("hits", lambda x: ~F.exists("hits", lambda y: (y["old_text"] != x["old_text"]) & F.contains(y["old_text"], x["old_text"])))
    rows = lines.crossJoin(F.broadcast(table)).select("file", "line", hit.alias("hits")).where("size(hits) > 0")
    return rows.select("file", "line", F.explode(alone).alias("e")).select("file", "line", "e.old_text", "e.new_text")


def many_file_edits(lines: DataFrame, mappings: DataFrame) -> DataFrame:
    """whole_file_edits for any number of mappings: one pass over the lines by an automaton of all old texts, and only what it finds meets the mappings."""
    real = mappings.select("old_text", "new_text").where("old_text <> new_text and old_text <> ''").distinct()
    return mapping_hits(lines.select("file", "line", "text"), real, longest=True).select("file", "line", "old_text", "new_text")


def near_edits(incidents: DataFrame, lines: DataFrame, mappings: DataFrame, before: int = 3, after: int = 4) -> DataFrame:
    """(file, incident_line, line, old_text, new_text): mappings of an incident's rule found on the lines around it.

    The window is turned into exact line numbers, so incident and line meet by an equi-join.
    """
    spread = incidents.select("file", "rule_id", F.col("line").alias("incident_line"), F.explode(F.sequence(F.col("line") - before, F.col("line") + after)).alias("line")).where("line >= 1")
    rows = spread.join(lines, ["file", "line"]).join(mappings, "rule_id")
    return rows.where("contains(text, old_text) and old_text <> new_text").select("file", "incident_line", "line", "old_text", "new_text").distinct()


#: Characters at a dead class's end by which it is sought.
ANCHOR = 8


def with_dead(rows: DataFrame, dead: DataFrame) -> DataFrame:
    """Adds is_dead to rows (…, swapped): whether the swapped text holds one of the classes (dead).

    Both sides meet by an equi-join on the last ANCHOR characters of a class (all of a shorter one) and are compared after.
    """
    gone = dead.select("dead").where("dead <> ''").distinct().select("dead", F.expr(f"right(dead, {ANCHOR})").alias("gram"))
    sizes = gone.select(F.length("gram").alias("size")).distinct()  # ANCHOR rows at most
    texts = rows.select("swapped").distinct().crossJoin(F.broadcast(sizes)).where("length(swapped) >= size")
    grams = texts.select("swapped", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("swapped") - F.col("size") + 1), lambda i: F.substring(F.col("swapped"), i, F.col("size"))))).alias("gram"))
    bad = grams.join(gone, "gram").where("contains(swapped, dead)").select("swapped").distinct().withColumn("is_dead", F.lit(True))
    return rows.join(bad, "swapped", "left").withColumn("is_dead", F.coalesce("is_dead", F.lit(False)))


def prefix_swaps(incidents: DataFrame, old: str, new: str, excluded: tuple[str, ...], dead: DataFrame) -> DataFrame:
    """Incidents (…, matched) with outcome rename or manual: manual if an excluded pattern occurs, or if the swapped text holds a class that no longer exists (dead)."""
    out = contains_any(F.col("matched"), F.array(*[F.lit(x) for x in excluded])) if excluded else F.lit(False)
    rows = with_dead(incidents.withColumn("swapped", replace_all(F.col("matched"), old, new)).withColumn("excluded", out), dead)
    return rows.withColumn("outcome", F.when(F.col("excluded") | F.col("is_dead"), "manual").otherwise("rename")).drop("is_dead")


def import_changes(incidents: DataFrame, lines: DataFrame, reach: int = 50) -> DataFrame:
    """(file, incident_line, old_text, new_text, outcome, line) of incidents (file, line, old_text, new_text): where an import's path changes.

    On the incident's own line if it holds the old path; else in the first from clause within reach behind it, if the lines before it show an import block.
    The windows carry flags and line numbers only; texts are fetched for the lines that count.
    """
    target = incidents.select("file", F.col("line").alias("incident_line"), "old_text", "new_text").distinct()
    text, near = F.col("text"), Window.partitionBy("file").orderBy("line")
    opens = F.contains(text, F.lit("{")) | F.ltrim(text).startswith("import") | F.ltrim(text).startswith("export")
    flags = lines.join(target.select("file").distinct(), "file", "left_semi").select("file", "line", opens.alias("opens"), F.when(F.contains(text, F.lit("from ")), F.col("line")).alias("clause"))
    flags = flags.select("file", F.col("line").alias("incident_line"), F.max("opens").over(near.rangeBetween(-reach, -1)).alias("in_block"), F.min("clause").over(near.rangeBetween(0, reach - 1)).alias("clause_line"))
    rows = target.join(flags, ["file", "incident_line"], "left").join(lines.select("file", F.col("line").alias("incident_line"), text.alias("own_text")), ["file", "incident_line"], "left")
    found = rows.join(lines.select("file", F.col("line").alias("clause_line"), text.alias("clause_text")), ["file", "clause_line"], "left")
    old, new = F.col("old_text"), F.col("new_text")
    outcome = (
        F.when(F.col("own_text").isNull(), "line_out_of_bounds")
        .when(F.contains("own_text", old), F.when(F.contains("own_text", new), "already_migrated").otherwise("edit"))
        .when(~F.coalesce("in_block", F.lit(False)), "not_in_import_block")
        .when(F.col("clause_text").isNull() | ~F.contains("clause_text", old), "text_not_found")
        .when(F.contains("clause_text", new), "already_migrated")
        .otherwise("edit")
    )
    here = F.when(outcome == "edit", F.when(F.contains("own_text", old), F.col("incident_line")).otherwise(F.col("clause_line")))
    return found.select("file", "incident_line", "old_text", "new_text", outcome.alias("outcome"), here.alias("line"))


def attribute_edits(lines: DataFrame, name: str) -> DataFrame:
    """(file, line, old_text, new_text) of lines from which an attribute goes."""
    new = without_attribute(F.col("text"), name)
    return lines.select("file", "line", F.col("text").alias("old_text"), new.alias("new_text")).where("old_text <> new_text")


def attribute_removals(incidents: DataFrame, lines: DataFrame) -> DataFrame:
    """(seq, file, line, old_text, new_text, reason) of incidents (seq, file, line, name): what removes an attribute.

    A line that begins with it goes, with those behind it up to where brackets balance; else the attribute goes from within
    the line.  What cannot be removed is one row with the reason and no texts.
    """
    rows = incidents.select("seq", "file", F.col("line").alias("at"), "name")
    own = rows.join(lines.select("file", F.col("line").alias("at"), "text"), ["file", "at"], "left")
    depth, begins = bracket_depth(F.col("text")), F.ltrim("text").startswith(F.col("name"))
    own = own.withColumn("depth", depth).withColumn("begins", begins).withColumn("part", F.when(~begins, first_attribute(F.col("text"), F.col("name"))))
    own = saved(own)  # a row for each incident
    wide = own.where("text is not null and begins and depth <> 0")
    runs = balanced_runs(wide.select("file", F.col("at").alias("start")), lines.join(wide.select("file").distinct(), "file", "left_semi"))
    closed = wide.join(runs.withColumnRenamed("start", "at"), ["file", "at"], "left")
    blanked = closed.where("end is not null").select("seq", "file", F.explode(F.sequence("at", "end")).alias("line")).join(lines, ["file", "line"]).select("seq", "file", "line", F.col("text").alias("old_text"), F.lit("").alias("new_text"), F.lit(None).cast("string").alias("reason"))
    lone = own.where("text is null or not (begins and depth <> 0)")
    reason = F.when(F.col("name") == "", "missing_variable").when(F.col("at").isNull(), "no_line_number").when(F.col("text").isNull(), "line_out_of_bounds").when(~F.col("begins") & F.col("part").isNull(), F.when(F.regexp_like("text", attribute_start(F.col("name"))), "unbalanced_brackets").otherwise("text_not_found"))
    told = lambda df, why: df.select("seq", "file", F.col("at").alias("line"), F.lit(None).cast("string").alias("old_text"), F.lit(None).cast("string").alias("new_text"), why.alias("reason"))
    lone = lone.withColumn("reason", reason)
    cut = lone.where("reason is null").select("seq", "file", F.col("at").alias("line"), F.when(F.col("begins"), F.col("text")).otherwise(F.col("part")).alias("old_text"), F.lit("").alias("new_text"), "reason")
    return blanked.unionByName(cut).unionByName(told(lone.where("reason is not null"), F.col("reason"))).unionByName(told(closed.where("end is null"), F.lit("unbalanced_brackets")))


def balanced_runs(starts: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, start, end): the lines from a start to the first at which brackets are balanced again; end is null if they never are.

    A line that closes brackets ends the runs of the levels between its sums; starts and such lines meet on (file, level),
    where one window gives each start the next line, so long files cost no more than their lines.
    """
    # saved, as a filter on depths would be moved before the join that chose the lines, and depths made of all lines there are
    depths = saved(lines.select("file", "line", bracket_depth(F.col("text")).alias("depth")))
    total = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    sums = depths.withColumn("after", F.sum("depth").over(total)).withColumn("level", F.col("after") - F.col("depth"))
    begun = starts.select("file", F.col("start").alias("line")).distinct().withColumn("is_start", F.lit(True))
    rows = sums.join(begun, ["file", "line"], "left")
    at_once = rows.where("is_start and depth <= 0").select("file", F.col("line").alias("start"), F.col("line").alias("end"))
    open_rows = rows.where("is_start and depth > 0").select("file", "level", "line", F.lit(None).cast("int").alias("closes"))
    closing = rows.where("depth < 0").select("file", F.explode(F.sequence(F.col("after"), F.col("level") - 1)).alias("level"), "line", F.col("line").cast("int").alias("closes"))
    next_close = Window.partitionBy("file", "level").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, 0)
    ends = open_rows.unionByName(closing).withColumn("end", F.last("closes", ignorenulls=True).over(next_close)).where("closes is null")
    return at_once.unionByName(ends.select("file", F.col("line").alias("start"), "end"))


def java_renames(incidents: DataFrame, lines: DataFrame) -> DataFrame:
    """(seq, file, line, old_text, new_text) of incidents (seq, file, old_name, new_name): import lines of the file with the old full name, and, if its last part changes, words elsewhere in it."""
    last = lambda c: F.substring_index(c, ".", -1)
    rows = incidents.select("seq", "file", "old_name", "new_name").join(lines, "file")
    text, imports = F.col("text"), F.ltrim("text").startswith("import ")
    new = F.when(imports, replace_all(text, F.col("old_name"), F.col("new_name"))).when(last("old_name") != last("new_name"), replace_words(text, last("old_name"), last("new_name"))).otherwise(text)
    return rows.select("seq", "file", "line", text.alias("old_text"), new.alias("new_text")).where("old_text <> new_text")


def annotation_edits(lines: DataFrame, name: str) -> DataFrame:
    return lines.where(F.col("text").rlike(rf"@{re.escape(name)}(?![A-Za-z0-9_])")).select("file", "line", F.col("text").alias("old_text"), without_annotation(F.col("text"), name).alias("new_text")).where("old_text <> new_text")


def annotation_removals(incidents: DataFrame, lines: DataFrame) -> DataFrame:
    """(seq, file, line, old_text, new_text, reason) of incidents (seq, file, line, name): the line without an annotation and its arguments, or why not."""
    own = incidents.select("seq", "file", "line", "name").join(lines, ["file", "line"], "left")
    found = F.regexp_like("text", F.concat(F.lit(r"@\Q"), F.substring_index("name", ".", -1), F.lit(r"\E(?![A-Za-z0-9_])")))
    reason = F.when(F.col("name") == "", "missing_variable").when(F.col("line").isNull(), "no_line_number").when(F.col("text").isNull(), "line_out_of_bounds").when(~found, "text_not_found")
    return own.select("seq", "file", "line", F.when(reason.isNull(), F.col("text")).alias("old_text"), F.when(reason.isNull(), without_annotation(F.col("text"), F.substring_index("name", ".", -1))).alias("new_text"), reason.alias("reason"))


def test_impact_only(labels: Column) -> Column:
    return F.array_contains(labels, "change-type=test-impact") & ~F.exists(labels, lambda x: x.startswith("change-type=") & (x != "change-type=test-impact"))


def family(labels: Column) -> Column:
    """Value of the first family label, null without one."""
    return F.substring(F.get(F.filter(labels, lambda x: x.startswith("family=")), 0), 8, 1 << 20)


def dependency_blocks(lines: DataFrame) -> DataFrame:
    """(file, name, start, end): dependency blocks at the first level of manifests, by a running sum of braces; end is the line of the closing one."""
    text = F.col("text")
    net = F.length(F.regexp_replace(text, r"[^{]", "")) - F.length(F.regexp_replace(text, r"[^}]", ""))
    rows = lines.select("file", "line", text.alias("text"), F.sum(net).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)).alias("level"))
    name = F.regexp_extract("text", r'^\s*"(dependencies|devDependencies|peerDependencies)"\s*:\s*\{', 1)
    starts = rows.where((name != "") & (F.col("level") == 2)).select("file", name.alias("name"), F.col("line").alias("start"))
    closes = rows.where("level = 1").select("file", F.col("line").alias("close"))
    return starts.join(closes, "file").where("close > start").groupBy("file", "name", "start").agg(F.min("close").alias("end"))


_ENTRY = r'^(\s*)"([^"]+)"\s*:\s*"([^"]*)"'


def manifest_entries(lines: DataFrame) -> DataFrame:
    """(file, line, text, block, name, version) of the entries of dependency blocks."""
    rows = lines.select("file", "line", "text", F.regexp_extract("text", _ENTRY, 2).alias("name"), F.regexp_extract("text", _ENTRY, 3).alias("version")).where("name <> ''")
    inside = rows.alias("l").join(dependency_blocks(lines).alias("b"), F.expr("l.file = b.file and l.line > b.start and l.line < b.end"))
    return inside.select("l.file", "l.line", "l.text", F.col("b.name").alias("block"), F.col("l.name").alias("name"), "l.version")


def manifest_changes(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """(seq, file, package, line, old_text, new_text, reason) of what manifests should have, wanted (seq, file, package, version).

    The first entry for the package gets the version, unless its range lies in the new one (reason version_already_compatible).  A manifest
    without one gets an entry behind the last of devDependencies, else of dependencies, with that entry's indent; several of one
    manifest make one edit, by the first of them (reason merged for the others).  A manifest without blocks has none (package_json_not_found).
    """
    entries = saved(manifest_entries(lines.join(wanted.select("file").distinct(), "file", "left_semi")))
    first = entries.groupBy("file", "name").agg(F.min_by(F.struct("line", "text", F.col("version").alias("now")), "line").alias("r")).withColumnRenamed("name", "package")
    rows = saved(wanted.select("seq", "file", "package", "version").join(first, ["file", "package"], "left"))
    none = F.lit(None).cast("string")
    have = rows.where("r is not null")
    compatible = (F.col("r.now") == F.col("version")) | vs.range_allows(F.col("version"), F.col("r.now"))
    old, new = F.concat(F.lit('"'), F.col("r.now"), F.lit('"')), F.concat(F.lit('"'), F.col("version"), F.lit('"'))
    # the whole line, so that an edit of one entry never meets the same version of another
    at = F.length(F.regexp_extract("r.text", _ENTRY, 0)) - F.length(old)
    after = F.concat(F.substring("r.text", F.lit(1), at), new, F.substring(F.col("r.text"), at + F.length(old) + 1, F.length("r.text")))
    updates = have.select("seq", "file", "package", F.col("r.line").alias("line"), F.when(~compatible, F.col("r.text")).alias("old_text"), F.when(~compatible, after).alias("new_text"), F.when(compatible, "version_already_compatible").alias("reason"))
    lacks = rows.where("r is null")
    last = entries.where("block in ('devDependencies', 'dependencies')").groupBy("file").agg(F.max_by(F.struct("line", "text"), F.struct(F.col("block") == "devDependencies", "line")).alias("l"))
    placed = lacks.join(last, "file", "left")
    lost = placed.where("l is null").select("seq", "file", "package", F.lit(None).cast("int").alias("line"), none.alias("old_text"), none.alias("new_text"), F.lit("package_json_not_found").alias("reason"))
    group = placed.where("l is not null").groupBy("file", "l").agg(F.min("seq").alias("first"), F.array_sort(F.collect_list(F.struct("seq", "package", "version"))).alias("all"))
    indent = F.regexp_extract("l.text", r"^(\s*)", 1)
    entry = lambda x: F.concat(indent, F.lit('"'), x["package"], F.lit('": "'), x["version"], F.lit('"'))
    made = F.concat(F.regexp_replace("l.text", r",?\s*$", ","), F.lit("\n"), F.array_join(F.array_distinct(F.transform("all", entry)), ",\n"), F.when(F.rtrim("l.text").endswith(","), ",").otherwise(""))
    each = group.select("file", "l", "first", made.alias("made"), F.explode("all").alias("x"))
    leads = F.col("x.seq") == F.col("first")
    inserts = each.select("x.seq", "file", "x.package", F.col("l.line").alias("line"), F.when(leads, F.col("l.text")).alias("old_text"), F.when(leads, F.col("made")).alias("new_text"), F.when(~leads, "merged").alias("reason"))
    return updates.unionByName(inserts).unionByName(lost)


def peer_ranges(missing: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(peer, requested_by, range) of missing peers: the range that the requesting package's manifest (file = its name) asks for, null if it names none."""
    asked = dependencies.where("section = 'peerDependencies'").select(F.col("file").alias("requested_by"), F.col("name").alias("peer"), F.col("version").alias("range"))
    return missing.join(asked, ["requested_by", "peer"], "left").select("peer", "requested_by", "range")
