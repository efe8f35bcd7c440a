"""Keyed changes of stored tables as joins: each returns the table's next state, to be written as a new version.

A key with a null names no row: new rows with one are left out, so that running a change twice adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their keys; ``keep`` columns stay as they first were. Both have the
    same columns and one row a key."""
    o, n = F.struct(*[F.col(c) for c in old.columns]).alias("o"), F.struct(*[F.col(c) for c in old.columns]).alias("n")
    both = old.select(*keys, o).join(new.dropna(subset=keys).select(*keys, n), keys, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*[pick(c).alias(c) for c in old.columns])


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose keys it lacks, one a key."""
    return old.unionByName(new.dropna(subset=keys).dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def children_replaced(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of every parent that ``new`` names are replaced by its rows."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def cascaded(child: DataFrame, gone: DataFrame, parent: str) -> DataFrame:
    return child.join(gone.select(parent), parent, "left_anti")


def enqueued(jobs: DataFrame, wanted: DataFrame, keys: list[str], open_: Column) -> DataFrame:
    """The wanted jobs that no open job already covers, one a key."""
    return wanted.dropna(subset=keys).dropDuplicates(keys).join(jobs.filter(open_).select(*keys), keys, "left_anti")


def attempts(old: DataFrame, outcomes: DataFrame, key: str, most: int = 10) -> DataFrame:
    """Deliveries after a round of sends. old: key, n_attempts, status; outcomes: key, sent."""
    tried = old.join(outcomes, key, "left")
    n = F.col("n_attempts") + F.col("sent").isNotNull().cast("int")
    return tried.select(key, n.cast("long").alias("n_attempts"), F.when(F.col("sent"), "sent").when(F.col("sent").isNotNull() & (n >= most), "failed").otherwise(F.col("status")).alias("status"))


def sparse(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Columns that ``new`` has replace those of ``old``, null too; a column that it lacks, or whose name is in its array
    ``untouched``, stays."""
    columns = [c for c in old.columns if c != key]
    given = [c for c in columns if c in new.columns]
    both = old.join(new.select(key, F.lit(True).alias("hit"), F.coalesce("untouched", F.array().cast("array<string>")).alias("untouched"), *[F.col(c).alias(f"new_{c}") for c in given]), key, "left")
    pick = lambda c: F.when(F.col("hit") & ~F.array_contains("untouched", c), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c)
    return both.select(key, *map(pick, columns))
