"""Shared helpers of the training-data operators: input projection, shared storage and small SQL idioms."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.sources.storage import delete, new_path

#: White space of the word rule, fixed by the query contracts: space and the controls 0x09 to 0x0D.
WORD = "[^\\x20\\x09-\\x0D]+"
GAPS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Tables stored inside the calls of tidied() that are going on.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by stored() once no later step reads it."""
    delete(df.sparkSession, df._stored_at)


def tidied(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """build()'s result as a stored table; the other tables that it stored on the way are deleted."""
    outer, made = _made.get(), []
    _made.set(made)
    out = None
    try:
        out = stored(build(), name)
    finally:
        _made.set(outer)
        for path in made:
            if out is None or path != out._stored_at:
                delete(spark, path)
    if outer is not None:
        outer.append(out._stored_at)
    return out


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever its case."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = f"{name}_"
        held.add(name.lower())
        out.append(name)
    return out


def id_and_text(df: DataFrame) -> DataFrame:
    """The two columns most operators need, a null text as the empty one; every other column is pruned here."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span struct, comma-joined, in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sliced(texts: list, chars: int = 1_000_000):
    """Index ranges over texts of about so many characters each, to bound what one numpy step holds."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
