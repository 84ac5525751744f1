"""What a model is told about the kind of migration: a small table of contexts by name, with a general one for names that have none."""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Context:
    name: str
    description: str = "a code migration"
    constraints: str = "Change only what is asked for and keep behaviour."
    priority: int = 3
    verification: str = "Read the changed lines again."


GENERAL = Context("general")


def context_table(spark: SparkSession, contexts: tuple[Context, ...] = ()) -> DataFrame:
    """The contexts as a table; of two with a name the later one counts."""
    rows = {c.name: c for c in (GENERAL, *contexts)}
    return spark.createDataFrame([astuple(c) for c in rows.values()], ", ".join(f"{f.name} {'int' if f.name == 'priority' else 'string'}" for f in fields(Context)))


def with_context(requests: DataFrame, table: DataFrame, name_col: str = "ruleset") -> DataFrame:
    """Requests with the description, constraints, priority and verification of their context, the general one where theirs is not in the table."""
    parts = [c for c in table.columns if c != "name"]
    own = table.select(F.col("name").alias(name_col), *[F.col(c).alias(f"own_{c}") for c in parts])
    general = table.where(F.col("name") == GENERAL.name).select(*[F.col(c).alias(f"general_{c}") for c in parts])
    joined = requests.join(own, name_col, "left").crossJoin(F.broadcast(general))
    return joined.select(*requests.columns, *[F.coalesce(f"own_{c}", f"general_{c}").alias(c) for c in parts])


def system_text() -> Column:
    """The opening of a prompt from the columns that with_context adds."""
    return F.concat(F.lit("This is "), "description", F.lit(". "), "constraints", F.lit(" "), "verification")
