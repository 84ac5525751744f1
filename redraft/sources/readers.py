"""Readers: findings, strategies, file lists, source lines and lock files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redraft.functions.text import file_uri, lines_of

FINDINGS = (
    "array<struct<name:string, violations:map<string, struct<labels:array<string>, incidents:array<struct<"
    "uri:string, fileUri:string, file_uri:string, lineNumber:int, line_number:int, message:string, codeSnip:string, code_snip:string, variables:map<string,variant>>>>>, errors:map<string,string>>>"
)
STRATEGY = (
    "struct<strategy:string, `from`:string, `to`:string, component:string, prop:string, replacement:string, package:string, new_version:string, old_package:string, exclude_patterns:array<string>, "
    "target_structure:string, retained_props:array<string>, prop_to_child:map<string,string>, unmapped_removed_props:map<string,string>, child_props_to_parent:map<string,string>, removed_children:array<string>, "
    "new_imports:array<string>, import_source:string, removed_imports:array<string>, prop_value_changes:map<string,array<struct<`from`:string,`to`:string>>>, prop_type_changes:map<string,array<struct<`from`:string,`to`:string>>>, "
    "deprecated_migration:struct<old_package:string, new_package:string, matching_props:array<struct<old_name:string, new_name:string, old_type:string, new_type:string, type_changed:boolean>>, new_props:map<string,string>, removed_props:array<string>>, "
    "mappings:array<struct<`from`:string, `to`:string, component:string, prop:string>>, member_mappings:array<struct<old_name:string,new_name:string>>, removed_members:array<string>>"
)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): each file once, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def source_lines(texts: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """(file, line, text) of every line, numbered from 1."""
    rows = texts.select(F.col(file_col).alias("file"), F.posexplode(lines_of(F.coalesce(F.col(text_col), F.lit("")))).alias("at", "text"))
    return rows.select("file", (F.col("at") + 1).alias("line"), "text")


def _read(parsed: Column, what: str, name: Column) -> Column:
    """What was parsed of a file; one that cannot be read ends the query with its name."""
    return F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.concat(F.lit(f"cannot read {what} "), F.coalesce(name, F.lit("")))))


def findings(reports: DataFrame, text_col: str = "text", strict: bool = True) -> DataFrame:
    """One row per incident of JSON reports (file, text), with the report and the ordinals that order them; snake and camel case names are both read.

    A report that cannot be read ends the query with an error that names it; without strict it has no rows.
    """
    report = F.col("file").cast("string") if "file" in reports.columns else F.lit("")
    parsed = F.from_json(F.col(text_col), FINDINGS)
    sets = reports.select(report.alias("report"), F.posexplode(_read(parsed, "report", report) if strict else parsed).alias("ruleset_ix", "s"))
    rules = sets.select("report", "ruleset_ix", F.col("s.name").alias("ruleset"), F.explode("s.violations").alias("rule_id", "v"))
    rows = rules.select("report", "ruleset_ix", "ruleset", "rule_id", F.coalesce("v.labels", F.array().cast("array<string>")).alias("labels"), F.posexplode("v.incidents").alias("incident_ix", "i"))
    return rows.select(
        "report", "ruleset_ix", "ruleset", "rule_id", "labels", "incident_ix",
        F.coalesce("i.uri", "i.fileUri", "i.file_uri").alias("file_uri"), F.coalesce("i.lineNumber", "i.line_number").alias("line"),
        F.col("i.message").alias("message"), F.coalesce("i.codeSnip", "i.code_snip").alias("code_snip"), F.col("i.variables").alias("variables"),
    )


def report_totals(reports: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: rules with findings, incidents and errors of all reports."""
    sets = reports.select(F.explode(F.from_json(F.col(text_col), FINDINGS)).alias("s"))
    counts = sets.select(F.coalesce(F.size(F.map_keys("s.violations")), F.lit(0)).alias("v"), F.aggregate(F.coalesce(F.map_values("s.violations"), F.array()), F.lit(0), lambda a, x: a + F.coalesce(F.size(x["incidents"]), F.lit(0))).alias("i"), F.coalesce(F.size(F.map_keys("s.errors")), F.lit(0)).alias("e"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return counts.agg(total("v").alias("violations"), total("i").alias("incidents"), total("e").alias("errors"))


def report_errors(reports: DataFrame, text_col: str = "text") -> DataFrame:
    """(message, n, first) of the distinct errors of reports (file, text): how often each occurs, and the first report that has it."""
    sets = reports.select(F.col("file").cast("string").alias("report"), F.explode(F.from_json(F.col(text_col), FINDINGS)).alias("s"))
    each = sets.select("report", F.explode("s.errors").alias("rule_id", "message"))
    return each.groupBy("message").agg(F.count("*").alias("n"), F.min("report").alias("first"))


def strategies(documents: DataFrame, order_col: str = "file_ix", text_col: str = "text") -> DataFrame:
    """(rule_id, entry) of JSON maps; of a rule in several files the last file's entry."""
    rows = documents.select(order_col, F.explode(F.from_json(F.col(text_col), f"map<string,{STRATEGY}>")).alias("rule_id", "entry"))
    return last_wins(rows, ["rule_id"], [order_col])


def strategy_warnings(documents: DataFrame, order_col: str = "file_ix", text_col: str = "text") -> DataFrame:
    """(order_col, warning) of strategy files that cannot be read; strategies goes on without them."""
    return documents.where(F.from_json(F.col(text_col), "map<string,variant>").isNull()).select(order_col, F.concat(F.lit("cannot read strategies "), F.col(order_col).cast("string"), F.lit(": no JSON map")).alias("warning"))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the last in order; one shuffle with a partial maximum, no sort of a key's rows."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*[c if c in keys else F.col(f"r.{c}").alias(c) for c in rows.columns])


def file_filter(texts: DataFrame, text_col: str = "text", root: str | None = None, required: bool = False) -> DataFrame:
    """(file_uri) of file lists: a JSON retry file's timed_out and failed files, or one name a line without blanks and # lines.

    With a root names become URIs below it, so that they meet those of incidents.  JSON that cannot be read ends the query; required also refuses lists that name no file.
    """
    retry = "struct<timed_out:array<struct<file:string>>, failed:array<struct<file:string>>>"
    text = F.trim(F.col(text_col))
    parsed = _read(F.from_json(text, "variant"), "file list", F.substring(text, 1, 40))
    parsed = F.from_json(F.to_json(parsed), retry)
    named = F.concat(F.coalesce(parsed["timed_out"]["file"], F.array().cast("array<string>")), F.coalesce(parsed["failed"]["file"], F.array().cast("array<string>")))
    plain = F.filter(F.transform(lines_of(F.col(text_col)), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    found = texts.select(F.explode(F.when(text.startswith("{"), named).otherwise(plain)).alias("file_uri"))
    found = found.select((F.col("file_uri") if root is None else file_uri(F.col("file_uri"), root)).alias("file_uri")).where("file_uri is not null").distinct()
    if required and found.isEmpty():
        raise ValueError("the file list names no file")
    return found


# lock files: edges (child, parent), the parent depends on the child


def yarn_name(header: Column) -> Column:
    """Package of a lock entry's header: its first specifier up to the last @npm: or @workspace:, else up to the @ after the scope."""
    first = F.regexp_replace(F.trim(F.split(F.regexp_replace(header, r":\s*$", ""), ",")[0]), '"', "")
    npm, space = F.regexp_extract(first, r"^(.+)@npm:", 1), F.regexp_extract(first, r"^(.+)@workspace:", 1)
    plain = F.regexp_extract(first, r"^(@?[^@]+)@", 1)
    return F.coalesce(F.nullif(npm, F.lit("")), F.nullif(space, F.lit("")), F.nullif(plain, F.lit("")))


def _first(piece: Column) -> Column:
    return F.substring_index(piece, "\n", 1)


def _pieces(text: Column, start: str) -> Column:
    """A text (ends of lines LF) cut before each line that begins as start says; in the first piece may stand what is before them."""
    return F.explode(F.split(text, f"\n(?={start})"))


def _whole(lines: DataFrame) -> DataFrame:
    """(file, text) of lines (file, line, text)."""
    own = lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("all"))
    return own.select("file", F.array_join(F.transform("all", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))


def yarn_edges(lines: DataFrame) -> DataFrame:
    """yarn_text_edges of lock files given as (file, line, text)."""
    return yarn_text_edges(_whole(lines))


def yarn_text_edges(texts: DataFrame) -> DataFrame:
    """Edges of lock files (file, text): a text is cut into its entries and those into their blocks, no line is sorted."""
    entries = texts.select("file", _pieces(F.replace("text", F.lit("\r\n"), F.lit("\n")), r"\S").alias("entry"))
    header = _first(F.col("entry"))
    named = header.rlike(r"^\S") & header.endswith(":") & ~header.startswith("#") & ~header.startswith("__metadata")
    blocks = entries.where(named).select("file", yarn_name(header).alias("parent"), _pieces(F.col("entry"), r"  \S").alias("block")).where("parent <> ''")
    block = _first(F.col("block"))
    deep = blocks.where(block.startswith("  ") & F.trim(block).isin("dependencies:", "peerDependencies:"))
    rows = deep.select("file", "parent", F.explode(F.split("block", "\n")).alias("text")).where(F.col("text").rlike(r"^    \S"))
    found = rows.select("file", "parent", F.split(F.trim("text"), ": ", 2).alias("entry")).where("size(entry) = 2")
    return found.select("file", F.regexp_replace(F.col("entry")[0], '^"|"$', "").alias("child"), "parent").distinct()


_NPM = "struct<packages:map<string,struct<version:string, dependencies:map<string,string>, devDependencies:map<string,string>, peerDependencies:map<string,string>>>>"


def npm_edges(texts: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """Edges of npm lock files; the root package is left out."""
    entries = texts.select(F.col(file_col).alias("file"), F.explode(F.from_json(F.col(text_col), _NPM)["packages"]).alias("key", "p")).where("key <> ''")
    names = F.concat(*[F.coalesce(F.map_keys(F.col(f"p.{s}")), F.array().cast("array<string>")) for s in ("dependencies", "devDependencies", "peerDependencies")])
    return entries.select("file", F.explode(names).alias("child"), F.substring_index("key", "node_modules/", -1).alias("parent")).distinct()


def pnpm_name(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, r"^/?(@[^/]+/[^@]+|[^@]+)", 1), F.lit(""))


def pnpm_edges(lines: DataFrame) -> DataFrame:
    """pnpm_text_edges of lock files given as (file, line, text)."""
    return pnpm_text_edges(_whole(lines))


def pnpm_text_edges(texts: DataFrame) -> DataFrame:
    """Edges of pnpm lock files (file, text): two-blank keys under packages: and snapshots:, six-blank names under their dependency blocks; texts are cut, no line is sorted."""
    tops = texts.select("file", _pieces(F.replace("text", F.lit("\r\n"), F.lit("\n")), r"\S").alias("top")).where(F.rtrim(_first(F.col("top"))).isin("packages:", "snapshots:"))
    keys = tops.select("file", _pieces(F.col("top"), r"  \S").alias("entry")).where(F.col("entry").startswith("  "))
    names = keys.select("file", "entry", F.regexp_replace(F.trim(_first(F.col("entry"))), "^['\"]|['\"]?:.*$", "").alias("key")).where("key <> ''")
    blocks = names.select("file", pnpm_name(F.col("key")).alias("parent"), _pieces(F.col("entry"), r"(?:   )? \S").alias("block"))
    block = _first(F.col("block"))
    deep = blocks.where(block.startswith("    ") & F.trim(block).isin("dependencies:", "peerDependencies:", "optionalDependencies:"))
    rows = deep.select("file", "parent", F.explode(F.split("block", "\n")).alias("text")).where(F.col("text").rlike(r"^      \S"))
    return rows.select("file", F.regexp_replace(F.regexp_extract(F.trim("text"), "^(.+?):", 1), "^['\"]|['\"]$", "").alias("child"), "parent").distinct()


_MANIFEST = "struct<dependencies:map<string,string>, devDependencies:map<string,string>, peerDependencies:map<string,string>>"


def manifest_dependencies(texts: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """(file, section, name, version) of package manifests; what cannot be read has no rows."""
    parsed = texts.select(F.col(file_col).alias("file"), F.from_json(F.col(text_col), _MANIFEST).alias("m"))
    sections = F.map_from_arrays(F.array(*[F.lit(s) for s in ("dependencies", "devDependencies", "peerDependencies")]), F.array("m.dependencies", "m.devDependencies", "m.peerDependencies"))
    return parsed.select("file", F.explode(sections).alias("section", "all")).select("file", "section", F.explode("all").alias("name", "version"))


def direct_versions(dependencies: DataFrame) -> DataFrame:
    """(file, name, version) of manifest_dependencies: the version under dependencies, else under devDependencies."""
    own = dependencies.where("section in ('dependencies', 'devDependencies')")
    return own.groupBy("file", "name").agg(F.min_by("version", "section").alias("version"))  # dependencies come first by name


def nearest_manifest(paths: DataFrame, manifests: DataFrame) -> DataFrame:
    """(path, manifest): of the manifests in a path's folder or above it the nearest; joined by folder, not by prefix tests."""
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda i: F.concat_ws("/", F.slice(F.split("path", "/"), 1, i)))
    up = paths.select("path", F.explode(folders).alias("folder"))
    have = manifests.select(F.col("file").alias("manifest"), F.regexp_replace("file", "/[^/]*$", "").alias("folder"))
    return up.join(have, "folder").groupBy("path").agg(F.max_by("manifest", F.struct(F.length("folder"), "manifest")).alias("manifest"))
