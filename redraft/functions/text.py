"""Column functions on source text.  All run inside Spark's generated code; none is a UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder names whose files are never edited (fixed values), by language.
SKIPPED_JS = ("node_modules",)
SKIPPED_JAVA = ("target", "build", ".gradle", ".mvn", ".settings", ".idea", ".classpath", ".project", "bin", "out", "node_modules")
#: Names of lock files (fixed values).
LOCK_FILES = ("yarn.lock", "package-lock.json", "pnpm-lock.yaml")
#: Sections of a model's answer that tell what it changed, in order of preference (fixed values).
CHANGE_HEADINGS = ("## Changes Applied", "## Summary of Changes", "## Summary of changes", "## Summary")


def _col(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def lines_of(text: Column) -> Column:
    """Lines of a text without their ends: CR LF and LF end a line, a last end adds none, an empty text has none."""
    # ends by plain comparison and a split by one character, which no pattern is run for
    trimmed = F.when(text.endswith("\r\n"), F.left(text, F.length(text) - 2)).when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.replace(trimmed, F.lit("\r\n"), F.lit("\n")), "\n", -1))


def replace_all(s: Column, old: Column | str, new: Column | str) -> Column:
    """Every occurrence of a literal; an empty one changes nothing."""
    return F.when(_col(old) == "", s).otherwise(F.replace(s, _col(old), _col(new)))


def replace_first(s: Column, old: Column | str, new: Column | str) -> Column:
    """The first occurrence of a literal."""
    at = F.instr(s, _col(old)) if isinstance(old, Column) else F.locate(old, s)
    return F.when((at > 0) & (_col(old) != ""), F.overlay(s, _col(new), at, F.length(_col(old)))).otherwise(s)


def replace_words(s: Column, old: Column | str, new: Column | str) -> Column:
    """Occurrences with no ASCII letter, digit or underscore next to them."""
    if isinstance(old, str) and isinstance(new, str):
        return F.regexp_replace(s, rf"(?<![A-Za-z0-9_]){re.escape(old)}(?![A-Za-z0-9_])", new.replace("\\", "\\\\").replace("$", "\\$"))
    found = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), _col(old), F.lit(r"\E(?![A-Za-z0-9_])"))
    return F.regexp_replace(s, found, F.replace(F.replace(_col(new), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")))


def contains_any(s: Column, parts: Column) -> Column:
    return F.exists(parts, lambda p: F.contains(s, p))


def skips_path(path: Column, names: tuple[str, ...] = SKIPPED_JS) -> Column:
    """True if a component of the path is one of the names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def is_lock_file(path: Column) -> Column:
    return F.substring_index(path, "/", -1).isin(*LOCK_FILES)


def path_of_uri(uri: Column, root: str) -> Column:
    """file:// goes; what is left is joined to the root if relative."""
    path = F.regexp_replace(uri, r"^file://", "")
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def file_uri(path: Column, root: str) -> Column:
    path = F.trim(path)
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    return F.when(path.startswith("file://"), path).otherwise(F.concat(F.lit("file://"), full))


def bracket_depth(s: Column) -> Column:
    """Opening less closing brackets outside quotes: a fold over characters that carries depth, open quote and the character before."""

    def step(a: Column, c: Column) -> Column:
        quote = c.isin("'", '"', "`") & (a["before"] != "\\")
        quoted = a["quote"] != ""
        opened = F.when(quote & ~quoted, c).when(quote & (a["quote"] == c), F.lit("")).otherwise(a["quote"])
        moved = F.when(quoted, 0).when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)
        return F.struct((a["depth"] + moved).alias("depth"), opened.alias("quote"), c.alias("before"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit("").alias("before"))
    return F.aggregate(F.split(s, ""), start, step, lambda a: a["depth"])


def unique_specifiers(line: Column) -> Column:
    """A one-line import with each of its names once, in order of first use; other lines stay."""
    opened, closed = F.locate("{", line), F.locate("}", line)
    head, tail = F.substring(line, 1, opened), F.substring(line, closed, F.length(line))
    names = F.filter(F.transform(F.split(F.substring(line, opened + 1, closed - opened - 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    # before the names only `import`, perhaps with `type`; behind them `from`
    words = F.filter(F.split(F.translate(head, "\t{", " "), " "), lambda x: x != "")
    begins = F.array_join(words, " ").isin("import", "import type")
    goes_on = F.ltrim(F.substring(tail, 2, F.length(line))).startswith("from")
    return F.when((opened > 0) & (closed > opened) & begins & goes_on, F.concat(head, F.lit(" "), F.array_join(F.array_distinct(names), ", "), F.lit(" "), tail)).otherwise(line)


def distinct_words(text: Column) -> Column:
    """Words separated by blanks, each once, in order of first use."""
    return F.array_join(F.array_distinct(F.filter(F.split(text, " "), lambda x: x != "")), " ")


def section(text: Column, headings: tuple[str, ...] = CHANGE_HEADINGS) -> Column:
    """The first heading, in order of preference, that occurs, with its text up to the next second-level heading, trimmed; null without one."""

    def found(heading: str) -> Column:
        at = F.locate(heading, text)
        body = F.substring_index(F.substring(text, at + len(heading), F.length(text)), "\n## ", 1)
        return F.when(at > 0, F.regexp_replace(F.concat(F.lit(heading), body), r"\s+\z", ""))

    return F.coalesce(*[found(h) for h in headings])


def without_escapes(line: Column) -> Column:
    """A terminal line without its colour codes."""
    return F.regexp_replace(line, "\x1b\\[[0-9;]*[A-Za-z]", "")


def without_annotation(line: Column, name: Column | str) -> Column:
    """A trimmed line without @name and its arguments on that line."""
    return F.trim(F.regexp_replace(line, F.concat(F.lit(r"@\Q"), _col(name), F.lit(r"\E(?![A-Za-z0-9_])(\s*\([^)]*\))?")), F.lit("")))


def _closing_brace(s: Column) -> Column:
    """Place, from 1, of the brace that closes the one a text begins with; 0 if none does.  Braces in quotes do not count."""

    def step(a: Column, c: Column) -> Column:
        quote = F.when(a["quote"] == c, F.lit("")).when((a["quote"] == "") & c.isin("'", '"', "`"), c).otherwise(a["quote"])
        depth = a["depth"] + F.when(a["quote"] != "", 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.when(a["end"] > 0, a).otherwise(F.struct((a["at"] + 1).alias("at"), depth.alias("depth"), quote.alias("quote"), F.when((depth == 0) & (c == "}"), a["at"] + 1).otherwise(0).alias("end")))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit(0).alias("end"))
    return F.aggregate(F.split(s, ""), start, step, lambda a: a["end"])


def attribute_value(rest: Column) -> Column:
    """How many characters of what follows an attribute's name are its value: an equals sign and a quoted text or braces, which may nest; 0 for a bare name, null for a value without an end."""
    behind = F.substring(rest, 3, F.length(rest))
    quoted = lambda q: F.nullif(F.locate(q, behind), F.lit(0)) + 2
    return F.when(rest.startswith('="'), quoted('"')).when(rest.startswith("='"), quoted("'")).when(rest.startswith("={"), F.nullif(_closing_brace(F.substring(rest, 2, F.length(rest))), F.lit(0)) + 1).when(rest.startswith("="), F.lit(None)).otherwise(0)


def attribute_start(name: Column | str) -> Column:
    """Pattern of an attribute's name with the blanks before it."""
    return F.concat(F.lit("\\s+\\Q"), _col(name), F.lit("\\E(?=[\\s=/>]|$)"))


def without_attribute(line: Column, name: Column | str) -> Column:
    """A line without an attribute, its value and the blanks before it, wherever it occurs among a tag's attributes."""
    start = attribute_start(name)
    pieces, starts = F.split(line, start, -1), F.regexp_extract_all(line, start, F.lit(0))
    cut = F.zip_with(starts, F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda s, p: F.coalesce(F.substring(p, attribute_value(p) + 1, F.length(p)), F.concat(s, p)))
    return F.concat(pieces[0], F.array_join(cut, ""))


def first_attribute(line: Column, name: Column | str) -> Column:
    """The first occurrence of an attribute with the blanks before it, null if there is none or its value has no end on the line."""
    start = attribute_start(name)
    at, found = F.regexp_instr(line, start), F.regexp_substr(line, start)
    rest = F.substring(line, at + F.length(found), F.length(line))
    return F.when(at > 0, F.concat(found, F.substring(rest, 1, attribute_value(rest))))
