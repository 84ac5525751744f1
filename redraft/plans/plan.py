"""The whole way from findings to edits: dispatch by strategy, settle, route what no pattern can do, report.

Resolved incidents, and then what the planners make of them, are written once to the shared folder, so each of
a plan's tables is a small query; every planner is a filter of the incidents joined with the source lines by file
and line.  Only the kinds of strategy that occur reach the driver, so that planners without incidents cost nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redraft.functions import versions as vs
from redraft.functions.text import SKIPPED_JS, contains_any, is_lock_file, path_of_uri, replace_all, skips_path
from redraft.operators import edits as ed
from redraft.operators import graph, planning
from redraft.sources import readers

if TYPE_CHECKING:
    from redraft.plans.providers import Provider

#: Variables that name what an incident matched, in order of preference (fixed values), by language, and of style classes.
MATCHED_JS = ("propName", "componentName", "importedName", "className", "variableName")
MATCHED_JAVA = ("importedName", "typeName", "methodName", "constructorName", "annotationName", "matchingText")
MATCHED_CLASS = ("matchingText", "className")
#: Label of rules whose matches are classes that no longer exist (fixed value).
DEAD_CLASS = "change-type=css-dead-class"
#: Endings of files whose dependency findings a model handles.
SCRIPT_ENDINGS = (".ts", ".tsx", ".js", ".jsx")
#: Characters of renames that go to every task.
BROADCAST_CHARS = 16_000_000
#: Place in the order of a run of edits that no incident asks for: behind all.
NO_RULESET = (1 << 31) - 1


@dataclass(frozen=True)
class Plan:
    """edits: changes that stay; subsumed: changes that others make needless; manual, pending and skipped: incidents for people, for a model, and without an edit; ignored: incidents that ask for nothing.

    An incident (seq) is in edits or subsumed, or in just one of the others.
    """

    edits: DataFrame
    subsumed: DataFrame
    manual: DataFrame
    pending: DataFrame
    skipped: DataFrame
    ignored: DataFrame


def variable(name: str) -> Column:
    """A variable of an incident if it is a text, else null."""
    value = F.expr(f"variables['{name}']")
    return F.when(F.expr(f"schema_of_variant(variables['{name}'])") == "STRING", F.try_variant_get(value, "$", "string"))


def matched_text(names: tuple[str, ...] = MATCHED_JS) -> Column:
    """The first of the variables that is a text, even an empty one; for Java the first that is not empty; else the empty text."""
    return planning.first_text(*[variable(n) for n in names]) if names == MATCHED_JAVA else F.coalesce(*[variable(n) for n in names], F.lit(""))


def matched_for(mappings: Column, names: tuple[str, ...] = MATCHED_JS) -> Column:
    """What a rename's incident matched: its matched text if a mapping has it, else a prop's value, else one of an object's values that a mapping has; else the matched text."""
    olds = F.transform(mappings, lambda m: m["old_text"])
    own = matched_text(names)
    value = variable("propValue")
    values = F.filter(F.transform(F.try_variant_get(F.expr("variables['propObjectValues']"), "$", "array<variant>"), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))), lambda x: F.array_contains(olds, x))
    return F.when(F.array_contains(olds, own), own).when(F.array_contains(olds, value), value).otherwise(F.coalesce(F.get(values, 0), own))


def annotation_name() -> Column:
    """The annotation that a Java incident is about: its name, else what it matched without the at sign and the package."""
    return F.substring_index(F.regexp_replace(planning.first_text(variable("annotationName"), variable("matchingText")), "^@", ""), ".", -1)


def prepared(incidents: DataFrame, root: str, skipped: tuple[str, ...] = SKIPPED_JS) -> DataFrame:
    """Incidents (of readers.findings) with file, never_edited (in a folder whose files are not) and seq, which tells all incidents of a run apart and orders them."""
    rows = incidents.withColumn("file", path_of_uri(F.col("file_uri"), root))
    return rows.withColumn("never_edited", skips_path(F.col("file"), skipped)).withColumn("seq", F.struct("report", "ruleset_ix", "rule_id", "incident_ix"))


_ROWS = ["seq", "rule_id", "file", "line", "old_text", "new_text", "replace_all", "reason"]


def _rows(df: DataFrame, line: Column | str, old: Column | None = None, new: Column | None = None, every: Column | bool = False, reason: Column | str | None = None) -> DataFrame:
    """What a planner makes of incidents: an edit, or the reason for none."""
    text = lambda x: (F.lit(x) if isinstance(x, str) or x is None else x).cast("string")
    line = F.col(line) if isinstance(line, str) else line
    return df.select("seq", "rule_id", "file", line.cast("int").alias("line"), text(old).alias("old_text"), text(new).alias("new_text"), F.lit(every).alias("replace_all") if isinstance(every, bool) else every.alias("replace_all"), text(reason).alias("reason"))


def _flag(df: DataFrame, kind: str) -> DataFrame:
    return df.where(F.col("kind") == kind)


def mappings_of(entry: str = "entry") -> Column:
    """A strategy's renames: its mappings with both ends, else its own ends."""
    e = F.col(entry)
    many = F.transform(F.filter(F.coalesce(e["mappings"], F.array().cast("array<struct<from:string,to:string,component:string,prop:string>>")), lambda m: m["from"].isNotNull() & m["to"].isNotNull()), lambda m: F.struct(m["from"].alias("old_text"), m["to"].alias("new_text")))
    return F.when(F.size(many) > 0, many).otherwise(F.array(F.struct(e["from"].alias("old_text"), e["to"].alias("new_text"))))


def rename_rows(incidents: DataFrame, lines: DataFrame) -> DataFrame:
    """Edits of rename incidents (…, mappings, matched, whole_file, replace_all), and the reasons of those without.

    An import's incident renames all over its file, the longest of mappings that lie in each other.  Others rename near their line: if a mapping is what
    they matched, that mapping on the line itself, whether or not the line shows it, and all mappings on three lines before and four behind; else all on one line before and four behind.
    """
    real = F.filter("mappings", lambda m: (m["old_text"] != m["new_text"]) & (m["old_text"] != ""))
    rows = incidents.withColumn("real", real).withColumn("primary", F.get(F.filter("mappings", lambda m: m["old_text"] == F.col("matched")), 0))
    lost, rows = rows.where("line is null"), rows.where("line is not null")
    same = "not whole_file and primary is not null and primary.old_text = primary.new_text"
    unchanged, rows = rows.where(same), rows.where(f"not coalesce({same}, false)")
    wide, near = rows.where("whole_file"), rows.where("not whole_file")

    # lines are read once for each file and rule, not for each incident
    hits = F.filter("real", lambda m: F.contains(F.col("text"), m["old_text"]))
    alone = F.filter("hits", lambda x: ~F.exists("hits", lambda y: (y["old_text"] != x["old_text"]) & F.contains(y["old_text"], x["old_text"])))
    by_file = wide.select("file", "rule_id", "real").distinct().join(lines, "file").select("file", "rule_id", F.col("line").alias("at"), hits.alias("hits")).where("size(hits) > 0").select("file", "rule_id", "at", F.explode(alone).alias("m"))
    over = wide.join(by_file, ["file", "rule_id"])

    around = near.withColumn("at", F.explode(F.sequence(F.col("line") - F.when(F.col("primary").isNotNull(), 3).otherwise(1), F.col("line") + 4))).where("at >= 1")
    met = around.join(lines.select("file", F.col("line").alias("at"), "text"), ["file", "at"])
    others = F.filter("real", lambda m: F.contains(F.col("text"), m["old_text"]) & ~((F.col("at") == F.col("line")) & F.coalesce(m["old_text"] == F.col("primary.old_text"), F.lit(False))))
    close = met.withColumn("m", F.explode(others))
    edit = lambda df: _rows(df, "at", F.col("m.old_text"), F.col("m.new_text"), F.col("replace_all"))
    first = near.where("primary is not null").withColumn("at", F.col("line")).withColumn("m", F.col("primary"))
    on_lines = graph.saved(edit(over).unionByName(edit(close)))  # used twice; the lines are read once for each of the two
    made = on_lines.unionByName(edit(first))
    found = on_lines.select("seq").distinct()
    none = wide.unionByName(near.where("primary is null")).join(found, "seq", "left_anti")
    no_op = F.when(F.size("real") == 0, "no_op_rename").otherwise("text_not_found")
    return made.unionByName(_rows(lost, "line", reason="no_line_number")).unionByName(_rows(unchanged, "line", reason="no_op_rename")).unionByName(_rows(none, "line", reason=no_op))


def dependency_rows(incidents: DataFrame, lines: DataFrame, registry: DataFrame | None) -> DataFrame:
    """Manifest edits of dependency incidents, and the reasons of those without, in one of three ways.

    One on a lock file updates those direct dependencies of its manifest that pull the package in; one that names a dependent (isDependentOf) updates
    that package; both to the newest release of the registry that reaches the wanted major, unless the manifest's range of the package lies in the wanted one.  Any other sets
    the strategy's package and version in its manifest.  The manifest is the file itself, else the nearest above it.
    """
    manifests = lines.where(F.col("file").rlike(r"(^|/)package\.json$")).select("file").distinct()
    own = F.when(F.col("file").rlike(r"(^|/)package\.json$"), F.col("file"))
    near = readers.nearest_manifest(incidents.where(own.isNull()).select(F.col("file").alias("path")).distinct(), manifests)
    rows = incidents.join(near.withColumnRenamed("path", "file"), "file", "left").withColumn("manifest", F.coalesce(own, "manifest"))
    rows = rows.select("seq", "rule_id", "file", "line", "manifest", F.col("entry.package").alias("package"), F.col("entry.new_version").alias("version"), is_lock_file(F.col("file")).alias("lock"), variable("isDependentOf").alias("depends_on"), variable("dependencyName").alias("dependent"))
    rows = graph.saved(rows)  # a row for each dependency incident; read by every branch below
    lost, rows = rows.where("manifest is null"), rows.where("manifest is not null")
    direct = rows.where("not lock and depends_on is null").select("seq", F.col("manifest").alias("file"), "package", "version")
    indirect = rows.where("lock or depends_on is not null").withColumn("needs", F.when(F.col("lock"), F.col("package")).otherwise(F.col("depends_on")))
    wanted, unresolved = direct, indirect.withColumn("reason", F.lit("no_compatible_version"))
    if registry is not None:
        entries = planning.manifest_entries(lines.join(indirect.select(F.col("manifest").alias("file")).distinct(), "file", "left_semi"))
        now = graph.saved(entries.groupBy("file", "name").agg(F.min_by("version", "line").alias("now")))
        have = indirect.join(now.select(F.col("file").alias("manifest"), F.col("name").alias("needs"), "now"), ["manifest", "needs"], "left")
        have = graph.saved(have.withColumn("compatible", F.coalesce(vs.range_allows(F.col("version"), F.col("now")), F.lit(False))))
        done, open_rows = have.where("compatible"), have.where("not compatible")
        locks = open_rows.where("lock")
        above = graph.ancestors_of(lock_edges(lines.join(locks.select("file").distinct(), "file", "left_semi")), locks.select("file", F.col("package").alias("target")).distinct())
        parents = locks.join(above.select("file", F.col("target").alias("package"), F.col("node").alias("parent")), ["file", "package"]).join(now.select(F.col("file").alias("manifest"), F.col("name").alias("parent")), ["manifest", "parent"])
        asked = parents.select("seq", "manifest", "parent", "needs", "version").unionByName(open_rows.where("not lock").select("seq", "manifest", F.col("dependent").alias("parent"), "needs", "version"))
        asked = asked.select("seq", "manifest", F.col("parent").alias("package"), F.col("needs").alias("dependency"), vs.major(F.col("version")).cast("int").alias("major"))
        latest = latest_compatible(registry, asked.select("package", "dependency", "major").distinct())
        resolved = graph.saved(asked.join(latest, ["package", "dependency", "major"]).select("seq", F.col("manifest").alias("file"), "package", F.col("latest").alias("version")))
        wanted = direct.unionByName(resolved)
        unresolved = done.withColumn("reason", F.lit("version_already_compatible")).select("seq", "rule_id", "file", "line", "reason").unionByName(open_rows.join(resolved.select("seq").distinct(), "seq", "left_anti").select("seq", "rule_id", "file", "line", F.lit("no_compatible_version").alias("reason")))
    changes = graph.saved(planning.manifest_changes(wanted, lines))
    # of the parents of one incident some may be as they should: it has a reason only if it has no edit
    asking = rows.select("seq", "rule_id", F.col("line").alias("at"))
    planned = changes.join(asking, "seq").withColumn("edits", F.max(F.col("reason").isNull() | (F.col("reason") == "merged")).over(Window.partitionBy("seq"))).where("reason is null or reason = 'merged' or not edits")
    planned = planned.select("seq", "rule_id", "file", F.coalesce("line", "at").cast("int").alias("line"), "old_text", "new_text", F.lit(False).alias("replace_all"), "reason")
    none = planned.where("reason is not null and reason <> 'merged'").dropDuplicates(["seq"])
    return planned.where("reason is null or reason = 'merged'").unionByName(none).unionByName(_rows(unresolved, "line", reason=F.col("reason"))).unionByName(_rows(lost, "line", reason="package_json_not_found"))


def lock_edges(lines: DataFrame) -> DataFrame:
    """(file, child, parent) of all lock files among the lines, each read by its name's format."""
    named = lambda name: lines.where(F.substring_index("file", "/", -1) == name)
    npm = readers.npm_edges(ed.rebuilt_files(named("package-lock.json")))
    return readers.yarn_edges(named("yarn.lock")).unionByName(npm).unionByName(readers.pnpm_edges(named("pnpm-lock.yaml")))


def dependency_route() -> Column:
    """Where a dependency incident goes: dropped for Java sources, a model's for scripts, else the manifest planner's."""
    path = F.lower("file")
    script = F.lit(False)
    for ending in SCRIPT_ENDINGS:
        script = script | path.endswith(ending)
    return F.when(path.endswith(".java"), "dropped").when(script, "pending").otherwise("manifest")


def routed_dependencies(incidents: DataFrame) -> DataFrame:
    """Adds route to dependency incidents."""
    return incidents.withColumn("route", dependency_route())


def strategy_context(entry: str = "entry") -> Column:
    """What a model is told about a strategy: one line for each field that is there."""
    e = F.col(entry)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    pairs = F.array_join(F.transform(e["member_mappings"], lambda m: F.concat(m["old_name"], F.lit(" -> "), m["new_name"])), ", ")
    renames = F.array_join(F.transform(e["mappings"], lambda m: F.concat(F.coalesce(m["from"], F.lit("?")), F.lit(" -> "), F.coalesce(m["to"], F.lit("?")))), ", ")
    many = lambda x: F.when(F.size(x) > 0, F.array_join(x, ", "))
    return F.concat_ws(
        "\n", line("Strategy", e["strategy"]), line("From", e["from"]), line("To", e["to"]), line("Component", e["component"]), line("Prop", e["prop"]), line("Replacement", e["replacement"]),
        line("Package", e["package"]), line("Version", e["new_version"]), line("Mappings", F.nullif(renames, F.lit(""))), line("Members", F.nullif(pairs, F.lit(""))), line("Removed members", many(e["removed_members"])),
    )


def incident_context(variables: str = "variables") -> Column:
    """All variables of an incident by name: texts as they are, other values as JSON."""
    entries = F.array_sort(F.map_keys(variables))
    shown = F.transform(entries, lambda k: F.concat(k, F.lit(": "), F.coalesce(F.try_variant_get(F.element_at(F.col(variables), k), "$", "string"), F.to_json(F.element_at(F.col(variables), k)))))
    return F.array_join(shown, "\n")


def companion_tests(sources: DataFrame, listing: DataFrame) -> DataFrame:
    """(file, companion_tests): test files of a source in its folder or in __tests__ below it, whose name without endings starts with the source's stem, in any case."""
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    name = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    tests = listing.where(F.col("path").rlike(r"\.(test|spec)\.(ts|tsx|js|jsx)$")).select(F.col("path").alias("test"), F.regexp_replace(folder("path"), "/__tests__$", "").alias("folder"), F.lower(name("path")).alias("base"))
    own = sources.select("file").distinct().select("file", folder("file").alias("folder"), F.lower(F.regexp_replace(name("file"), r"\.[^.]*$", "")).alias("stem"))
    found = own.join(tests, "folder").where(F.expr("startswith(base, stem)")).groupBy("file").agg(F.array_sort(F.collect_set("test")).alias("companion_tests"))
    return sources.join(found, "file", "left").withColumn("companion_tests", F.coalesce("companion_tests", F.array().cast("array<string>")))


def java_companion_tests(sources: DataFrame, listing: DataFrame) -> DataFrame:
    """(file, companion_tests) of Java sources: Test, Tests and IT classes in the mirrored test tree or the same folder."""
    stem = F.regexp_replace("file", r"\.java$", "")
    ends = F.array(*[F.lit(x) for x in ("Test.java", "Tests.java", "IT.java")])
    guesses = F.array_distinct(F.flatten(F.transform(F.array(F.replace(stem, F.lit("/src/main/"), F.lit("/src/test/")), stem), lambda s: F.transform(ends, lambda e: F.concat(s, e)))))
    found = sources.select("file", F.explode(guesses).alias("path")).join(listing.select("path").distinct(), "path", "left_semi").groupBy("file").agg(F.array_sort(F.collect_set("path")).alias("companion_tests"))
    return sources.join(found, "file", "left").withColumn("companion_tests", F.coalesce("companion_tests", F.array().cast("array<string>")))


def proactive_dependencies(strategies: DataFrame, incidents: DataFrame, lines: DataFrame) -> DataFrame:
    """Manifest edits of dependency strategies that name an old package but have no incident: old package and version become the new ones on the old package's lines."""
    silent = strategies.join(incidents.select("rule_id"), "rule_id", "left_anti").where("kind = 'EnsureDependency' and coalesce(entry.old_package, '') <> ''")
    wanted = silent.select("rule_id", F.col("entry.old_package").alias("old_package"), F.col("entry.package").alias("package"), F.col("entry.new_version").alias("version"))
    shape = r'^\s*"([^"]+)"\s*:\s*"([^"]*)"'
    rows = lines.where(F.col("file").endswith("package.json")).withColumn("name", F.regexp_extract("text", shape, 1)).where("name <> ''")
    hit = rows.join(wanted, F.col("name") == F.col("old_package"))
    new = F.regexp_replace("text", F.lit(shape), F.concat(F.regexp_extract("text", r"^(\s*)", 1), F.lit('"'), F.col("package"), F.lit('": "'), F.col("version"), F.lit('"')))
    return hit.select("file", "line", "rule_id", F.col("text").alias("old_text"), new.alias("new_text"))


def config_renames(strategies: DataFrame, lines: DataFrame) -> DataFrame:
    """Edits of files other than Java sources that hold the old full name (two dots at least) of a Java rename; candidates meet on the dotted words of a line.

    The renames of a run go to every task where they are few, as they are in all but odd runs: a name that is on very many lines would meet in one task, and lines without a rename would be shuffled.
    """
    old = strategies.where("kind = 'JavaImportRename' and entry.`from` rlike '[.].*[.]'").select("rule_id", F.col("entry.from").alias("old_text"), F.col("entry.to").alias("new_text"))
    few = old.agg(F.coalesce(F.sum(F.length("rule_id") + F.length("old_text") + F.length("new_text")), F.lit(0))).first()[0] <= BROADCAST_CHARS
    known = F.broadcast(old) if few else old
    dotted = F.regexp_extract_all("text", F.lit(r"[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*){2,}"), 0)
    words = lines.where(~F.col("file").endswith(".java")).select("file", "line", F.explode(F.array_distinct(dotted)).alias("word"))
    upto = lambda pieces: F.transform(F.sequence(F.lit(3), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, 1, i), "."))
    names = words.select("file", "line", F.explode(upto(F.split("word", r"\."))).alias("old_text"))
    named = names.join(F.broadcast(old.select("old_text")) if few else old.select("old_text"), "old_text", "left_semi").select("file", "line", "old_text").distinct()
    return named.join(known, "old_text").select("file", "line", "rule_id", "old_text", "new_text")


def latest_compatible(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """(package, dependency, major, latest): of a registry (package, version, dependencies map, peerDependencies map) the newest release whose range for `dependency` reaches `major`, or that does not need it; wanted is (package, dependency, major)."""
    rows = registry.where(vs.is_release(F.col("version"))).join(wanted, "package")
    need = F.coalesce(F.element_at("dependencies", F.col("dependency")), F.element_at("peerDependencies", F.col("dependency")))
    fits = rows.where(need.isNull() | (vs.major(need) >= F.col("major")))
    return fits.groupBy("package", "dependency", "major").agg(F.concat(F.lit("^"), F.max_by("version", F.struct(vs.parts(F.col("version")).alias("p"), "version"))).alias("latest"))


def plan(incidents: DataFrame, strategies: DataFrame, lines: DataFrame, root: str, provider: Provider | None = None, listing: DataFrame | None = None, registry: DataFrame | None = None, only: DataFrame | None = None) -> Plan:
    """The plan of a run: incidents as readers.findings gives them, strategies (rule_id, entry), source lines (file, line, text).

    provider is the language's (by default JavaScript's); listing (path) are the files among which companion tests are sought, else those of the lines; registry is that of latest_compatible; only (file_uri) limits the run to some files.
    """
    if provider is None:
        from redraft.plans.providers import JAVASCRIPT as provider
    names = provider.matched
    known = strategies.select("rule_id", "entry", planning.strategy_kind().alias("kind"))
    found = incidents if only is None else incidents.join(only.select("file_uri").distinct(), "file_uri", "left_semi")
    # a few reports hold all incidents: they are dealt out, as all that follows is made for each
    found = found.repartition(max(4 * found.sparkSession.sparkContext.defaultParallelism, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = planning.resolved(prepared(found, root, provider.skipped), known).join(known.select("rule_id", "entry"), "rule_id", "left")
    rows = graph.saved(rows.withColumn("route", F.when(F.col("never_edited"), "dropped").when(F.col("kind") == "EnsureDependency", dependency_route())))
    live = rows.where("route is null or route <> 'dropped'")

    kinds = {(r["kind"], r["route"]) for r in live.select("kind", "route").distinct().collect()}
    has = lambda kind, route=None: (kind, route) in kinds
    outcomes = [_rows(live.where(F.lit(False)), "line")]

    whole = provider.is_whole_file()
    if has("Rename"):
        renames = _flag(live, "Rename").withColumn("mappings", mappings_of()).withColumn("whole_file", whole)
        outcomes.append(rename_rows(renames.withColumn("matched", matched_for(F.col("mappings"), names)).withColumn("replace_all", F.col("whole_file")), lines))
    marked = _flag(live, "CssVariablePrefix").withColumn("shown", matched_text(MATCHED_CLASS))
    marked = marked.withColumn("swapped", replace_all(F.col("shown"), F.col("entry.from"), F.col("entry.to"))).withColumn("excluded", contains_any(F.col("shown"), F.coalesce("entry.exclude_patterns", F.array().cast("array<string>"))))
    blocked = F.col("excluded") | F.col("is_dead")
    if has("CssVariablePrefix"):
        marked = graph.saved(planning.with_dead(marked, dead_classes(found)))
        swaps = marked.where(~blocked).withColumn("mappings", F.array(F.struct(F.col("entry.from").alias("old_text"), F.col("entry.to").alias("new_text"))))
        outcomes.append(rename_rows(swaps.withColumn("matched", matched_text(names)).withColumn("whole_file", whole).withColumn("replace_all", F.lit(True)), lines))
    else:
        marked = marked.withColumn("is_dead", F.lit(False))
    if has("RemoveAttribute"):
        removed = _flag(live, "RemoveAttribute")
        cut = provider.remove(removed, lines).join(removed.select("seq", "rule_id"), "seq")
        outcomes.append(_rows(cut, "line", F.col("old_text"), F.col("new_text"), reason=F.col("reason")))
    if has("ImportPathChange"):
        moved = _flag(live, "ImportPathChange").select("seq", "rule_id", "file", "line", F.col("entry.from").alias("old_text"), F.col("entry.to").alias("new_text"))
        places = planning.import_changes(moved.where("line is not null"), lines).withColumnRenamed("line", "at").withColumnRenamed("incident_line", "line")
        moved = moved.join(places, ["file", "line", "old_text", "new_text"], "left")
        outcomes.append(_rows(moved.where("outcome = 'edit'"), "at", F.col("old_text"), F.col("new_text")).unionByName(_rows(moved.where("outcome is null or outcome <> 'edit'"), "line", reason=F.coalesce("outcome", F.lit("no_line_number")))))
    if has("JavaImportRename"):
        named = _flag(live, "JavaImportRename").withColumn("old_name", F.col("entry.from")).withColumn("new_name", F.col("entry.to"))
        renamed = planning.java_renames(named, lines).join(named.select("seq", "rule_id"), "seq")
        outcomes.append(_rows(renamed, "line", F.col("old_text"), F.col("new_text")).unionByName(_rows(named.join(renamed.select("seq").distinct(), "seq", "left_anti"), "line", reason="text_not_found")))
    if has("EnsureDependency", "manifest"):
        outcomes.append(dependency_rows(live.where("route = 'manifest'"), lines, registry).select(*_ROWS))
    at_last = lambda df: df.withColumn("seq", F.struct(F.lit("").alias("report"), F.lit(NO_RULESET).alias("ruleset_ix"), F.col("rule_id"), F.lit(0).alias("incident_ix")))
    outcomes.append(_rows(at_last(proactive_dependencies(known, found, lines)), "line", F.col("old_text"), F.col("new_text")))
    own_edits = provider.edits_of_its_own(known, lines)
    if own_edits is not None:
        outcomes.append(_rows(at_last(own_edits), "line", F.col("old_text"), F.col("new_text"), every=True))
    outcomes = graph.union_saved(outcomes)  # each planner's rows are written on their own, so that no plan holds all planners

    edits = outcomes.where("reason is null or reason = 'merged'").drop("reason")
    kept = graph.saved(ed.settled(ed.without_repeats(edits.where("old_text is not null"))))
    told = outcomes.where("reason is not null and reason <> 'merged'")

    talks = _flag(live, "Llm")
    files = lines.select(F.col("file").alias("path")).distinct() if listing is None else listing
    asked = provider.tests_of(talks.unionByName(live.where("route = 'pending'")), files)
    lonely = (F.col("kind") == "Llm") & planning.test_impact_only(F.col("labels")) & (F.size("companion_tests") == 0)
    from_module = F.concat(F.lit("Import "), variable("importedName"), F.lit(" from "), F.col("entry.package"), F.lit(" "), F.col("entry.new_version"), F.lit(" instead of "), variable("module"))
    message = F.when(F.col("kind") == "EnsureDependency", F.concat_ws("\n\n", from_module, "message")).otherwise(F.concat_ws("\n\n", "message", F.concat(F.lit("Incident:\n"), F.nullif(incident_context(), F.lit(""))), F.concat(F.lit("Strategy:\n"), F.when(F.col("entry").isNotNull(), strategy_context()))))
    by_hand = lambda df, why: df.select("rule_id", "file", F.coalesce("line", F.lit(0)).alias("line"), "seq", F.concat_ws(" ", why, "message").alias("message"), "code_snip")
    gone = F.when(F.col("excluded"), F.concat(F.lit("Class "), F.col("shown"), F.lit(" was removed."))).otherwise(F.concat(F.lit("Class "), F.col("swapped"), F.lit(" does not exist any more.")))
    no_label = F.array().cast("array<string>")
    return Plan(
        edits=kept,
        subsumed=edits.join(kept.select("file", "line", "seq", "old_text"), ["file", "line", "seq", "old_text"], "left_anti").select(*edits.columns),
        manual=by_hand(_flag(live, "Manual"), F.lit(None).cast("string")).unionByName(by_hand(marked.where(blocked), gone)).unionByName(by_hand(asked.where(lonely), F.lit("Only tests are touched, and there are none."))),
        pending=asked.where(~lonely).select("rule_id", "file", "line", "seq", message.alias("message"), "code_snip", F.when(F.col("kind") == "Llm", F.col("labels")).otherwise(no_label).alias("labels"), F.when(F.col("kind") == "Llm", planning.family(F.col("labels"))).alias("family"), "companion_tests"),
        skipped=told.select("rule_id", "file", "line", "seq", "reason"),
        ignored=rows.where("route = 'dropped'").select("rule_id", "file", "line", "seq", F.when(F.col("never_edited"), "path").otherwise("java_dependency").alias("reason")),
    )


def dead_classes(incidents: DataFrame) -> DataFrame:
    """(dead): the classes that incidents of rules with the label for dead classes matched."""
    rows = incidents.where(F.array_contains("labels", DEAD_CLASS))
    return rows.select(F.explode(F.array(*[variable(n) for n in MATCHED_CLASS])).alias("dead")).where("dead <> ''").distinct()


def summary(p: Plan) -> DataFrame:
    """One row with the counters of a run, also as JSON."""
    counts = p.edits.agg(F.count("*").alias("pattern_edits"), F.count_distinct("seq").alias("pattern_fixes"), F.count_distinct("file").alias("files_with_fixes"))
    for name, df in (("edits_subsumed", p.subsumed), ("manual_review", p.manual), ("pending", p.pending), ("skipped", p.skipped)):
        counts = counts.crossJoin(df.agg(F.count("*").alias(name)))
    return counts.select("*", F.to_json(F.struct("*")).alias("json"))


def retry_rows(results: DataFrame) -> DataFrame:
    """(timed_out, file, rule_ids, error) of model results (file, rule_id, ok, timed_out, error) that did not finish."""
    return results.where("not ok").groupBy("timed_out", "file").agg(F.array_sort(F.collect_set("rule_id")).alias("rule_ids"), F.max("error").alias("error"))


def retry_list(results: DataFrame) -> DataFrame:
    """(text): a JSON line for each file to try again, with its rules, under timed_out or failed; readers.file_filter reads them back."""
    row = F.struct("file", "rule_ids", "error")
    of = lambda late: F.when(F.col("timed_out") == F.lit(late), F.array(row))
    return retry_rows(results).select(F.to_json(F.struct(of(True).alias("timed_out"), of(False).alias("failed"))).alias("text"))


def given_up(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests whose file a model did not finish, for people; joined by file and rule, never by position."""
    return requests.join(results.where("not ok").select("file", "rule_id").distinct(), ["file", "rule_id"], "left_semi")


def family_context(entry: str = "entry", fields: frozenset[str] | None = None) -> Column:
    """What a model is told about a family of components, from the fields that its entry has: structure, props that stay, move, go or change, children, imports, and where a deprecated family went."""
    e = F.col(entry)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    many = lambda x: F.when(F.size(x) > 0, F.array_join(x, ", "))
    moved = lambda m, sign: F.when(F.size(m) > 0, F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat(x["key"], F.lit(sign), x["value"])), ", "))
    parts = [
        line("Structure", e["target_structure"]), line("Props that stay", many(e["retained_props"])), line("Props that move to children", moved(e["prop_to_child"], " -> ")), line("Props that go", moved(e["unmapped_removed_props"], ": ")),
        line("Children that become props", moved(e["child_props_to_parent"], " -> ")), line("Children that go", many(e["removed_children"])), line("New imports", F.concat(many(e["new_imports"]), F.coalesce(F.concat(F.lit(" from "), e["import_source"]), F.lit("")))),
        line("Imports that go", many(e["removed_imports"])),
    ]
    keys = lambda m: F.array_sort(F.map_keys(m))
    changed = lambda m: F.when(F.size(m) > 0, F.array_join(F.transform(keys(m), lambda k: F.concat(k, F.lit(" ("), F.array_join(F.transform(F.element_at(m, k), lambda c: F.concat(c["from"], F.lit(" -> "), c["to"])), "; "), F.lit(")"))), ", "))
    for name, title in (("prop_value_changes", "Values that change"), ("prop_type_changes", "Types that change")):
        if fields is None or name in fields:
            parts.append(line(title, changed(e[name])))
    if fields is None or "deprecated_migration" in fields:
        d = e["deprecated_migration"]
        same = F.transform(d["matching_props"], lambda p: F.concat(p["old_name"], F.lit(" -> "), p["new_name"], F.when(p["type_changed"], F.concat(F.lit(" ("), p["old_type"], F.lit(" -> "), p["new_type"], F.lit(")"))).otherwise(F.lit(""))))
        renders = F.exists(F.concat(F.coalesce(F.map_keys(d["new_props"]), F.array().cast("array<string>")), F.coalesce(e["retained_props"], F.array().cast("array<string>"))), lambda p: p.startswith("render"))
        parts += [line("Package", F.concat(d["old_package"], F.lit(" -> "), d["new_package"])), line("Props that match", many(same)), line("New props", moved(d["new_props"], ": ")), line("Props without a match", many(d["removed_props"])), F.when(renders, F.lit("Props that start with render take a function that returns the element."))]
    return F.concat_ws("\n", *parts)


def with_family(requests: DataFrame, families: DataFrame) -> DataFrame:
    """Requests (…, family) with the context of their family (families: rule_id family:<name>, entry) before their message; others stay as they are."""
    fields = frozenset(families.select("entry.*").columns)
    known = families.where("rule_id like 'family:%'").select(F.substring("rule_id", 8, 1 << 20).alias("family"), family_context(fields=fields).alias("family_text"))
    joined = requests.join(known, "family", "left")
    return joined.select(*[F.when(F.col("family_text").isNotNull(), F.concat("family_text", F.lit("\n\n"), "message")).otherwise(F.col("message")).alias("message") if c == "message" else F.col(c) for c in requests.columns])
