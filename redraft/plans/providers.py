"""What a language brings to a plan: a registered set of DataFrame functions, each checked for the columns that it must give.

A provider says which variables name what an incident matched, which folders are never edited, how attributes go, where companion tests lie and which edits it makes of its own;
how lines of changed files are tidied after edits; and what is noted before edits are applied and done after.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redraft.functions.text import SKIPPED_JAVA, SKIPPED_JS, unique_specifiers
from redraft.operators import edits as ed
from redraft.operators import graph, planning
from redraft.plans import plan as pl

#: Columns that a provider's functions must give, with their types.
REMOVALS = {"seq": None, "file": "string", "line": "int", "old_text": "string", "new_text": "string", "reason": "string"}
COMPANIONS = {"file": "string", "companion_tests": "array<string>"}
OWN_EDITS = {"file": "string", "line": "int", "rule_id": "string", "old_text": "string", "new_text": "string"}
LINES = {"file": "string", "line": "int", "text": "string"}


def checked(df: DataFrame, columns: dict[str, str | None], what: str) -> DataFrame:
    """df, if it has the columns with their types (None: any)."""
    have = dict(df.dtypes)
    wrong = [f"{c}: {have.get(c, 'missing')} for {kind or 'any type'}" for c, kind in columns.items() if c not in have or kind is not None and have[c] != kind]
    if wrong:
        raise TypeError(f"{what} must have other columns: {'; '.join(wrong)}")
    return df


def _same(lines: DataFrame) -> DataFrame:
    return lines


@dataclass(frozen=True)
class Provider:
    """name; variables of matched texts in order, and those that make a rename one of the whole file; folders never edited; then functions:

    attribute: name of what is to be removed; removals: (incidents, lines) to REMOVALS; companions: (sources, listing) to sources with COMPANIONS; own_edits: (strategies, lines) to OWN_EDITS;
    tidied: lines of changed files to lines; before: lines of the files to be changed to what after gets; after: (changed files, what before gave) to any rows.
    """

    name: str
    matched: tuple[str, ...]
    whole_file: tuple[str, ...]
    skipped: tuple[str, ...]
    attribute: Callable[[], Column]
    removals: Callable[[DataFrame, DataFrame], DataFrame]
    companions: Callable[[DataFrame, DataFrame], DataFrame]
    own_edits: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    tidied: Callable[[DataFrame], DataFrame] = field(default=_same)
    before: Callable[[DataFrame], DataFrame | None] | None = None
    after: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None

    def is_whole_file(self) -> Column:
        """Whether an incident's rename is one of its whole file: it has one of the variables."""
        found = F.map_contains_key("variables", F.lit(self.whole_file[0]))
        for name in self.whole_file[1:]:
            found = found | F.map_contains_key("variables", F.lit(name))
        return found

    def remove(self, incidents: DataFrame, lines: DataFrame) -> DataFrame:
        return checked(self.removals(incidents.withColumn("name", self.attribute()), lines), REMOVALS, f"removals of {self.name}")

    def tests_of(self, sources: DataFrame, listing: DataFrame) -> DataFrame:
        return checked(self.companions(sources, listing), COMPANIONS, f"companions of {self.name}")

    def edits_of_its_own(self, strategies: DataFrame, lines: DataFrame) -> DataFrame | None:
        return None if self.own_edits is None else checked(self.own_edits(strategies, lines), OWN_EDITS, f"own edits of {self.name}")


def tidied_script(lines: DataFrame) -> DataFrame:
    """Import lines name each specifier once."""
    return lines.withColumn("text", unique_specifiers(F.col("text")))


JAVASCRIPT = Provider(
    "javascript", pl.MATCHED_JS, ("importedName",), SKIPPED_JS, lambda: F.coalesce(pl.variable("propName"), F.lit("")), planning.attribute_removals, pl.companion_tests, tidied=tidied_script
)
JAVA = Provider(
    "java", pl.MATCHED_JAVA, ("importedName", "module"), SKIPPED_JAVA, pl.annotation_name, planning.annotation_removals, pl.java_companion_tests, own_edits=pl.config_renames, tidied=ed.blank_repeated_imports
)
PROVIDERS = {p.name: p for p in (JAVASCRIPT, JAVA)}


def register(provider: Provider) -> None:
    """Make a provider known by its name; one of that name that is known already stays unless it is the same."""
    if PROVIDERS.setdefault(provider.name, provider) != provider:
        raise ValueError(f"there is a provider {provider.name} already")


@dataclass(frozen=True)
class Applied:
    """lines (file, line, text) of the files that edits change, as they become; follow_up: what the provider's after gave, or None."""

    lines: DataFrame
    follow_up: DataFrame | None


def applied(edits: DataFrame, lines: DataFrame, provider: Provider = JAVASCRIPT) -> Applied:
    """Edits applied to their files, whose lines the provider then tidies; its hooks see the files as they were and those that changed."""
    own = lines.join(edits.select("file").distinct(), "file", "left_semi")
    noted = None if provider.before is None else provider.before(own)
    after = graph.saved(ed.apply_edits(edits, own))  # read for what changed and for the lines
    changed = after.where("changed").select("file").distinct()
    kinds = {c: dict(lines.dtypes)[c] for c in ("file", "line", "text")}
    made = checked(provider.tidied(after.join(changed, "file", "left_semi").select("file", "line", "text")), kinds, f"tidied lines of {provider.name}")
    return Applied(made, None if provider.after is None else provider.after(changed, noted))
