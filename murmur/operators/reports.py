"""Counts, coverage, retention and catalogue merges. A null status, disposition or age is counted as such and deletes nothing."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def shard_coverage(workers: DataFrame, shards: int) -> DataFrame:
    """shard, n_workers, state (missing, single, duplicated) of every shard."""
    every = workers.sparkSession.range(shards).select(F.col("id").alias("shard"))
    held = workers.groupBy("shard").agg(F.count("*").alias("n_workers"))
    n = F.coalesce("n_workers", F.lit(0))
    return every.join(held, "shard", "left").select("shard", n.alias("n_workers"), F.when(n == 0, "missing").when(n == 1, "single").otherwise("duplicated").alias("state"))


def deletable(segments: DataFrame, jobs: DataFrame, backed: DataFrame, disposable_s: int = 600, failed_s: int = 86_400) -> DataFrame:
    """Segments that may go: disposable ones past the first age whose job ended, failed ones past the second; none that
    backs a mention. segments: segment_id, disposition, age_s; jobs: segment_id, job_status; backed: segment_id."""
    ended = (F.col("disposition") == "disposable") & (F.col("age_s") > disposable_s) & F.col("job_status").isin("succeeded", "abandoned")
    failed = (F.col("disposition") == "failed") & (F.col("age_s") > failed_s)
    one = jobs.groupBy("segment_id").agg(F.max("job_status").alias("job_status"))  # of several jobs one counts
    return segments.join(one, "segment_id", "left").filter(ended | failed).join(backed, "segment_id", "left_anti")


def merged_catalogue(rows: DataFrame, overrides: DataFrame, deletions: DataFrame) -> DataFrame:
    """Catalogue rows without deleted ones, names overridden where given."""
    kept = rows.join(deletions, "host", "left_anti")
    return kept.join(overrides.groupBy("host").agg(F.max("name").alias("new_name")), "host", "left").withColumn("name", F.coalesce("new_name", "name")).drop("new_name")


def distinct_word_ratio(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return F.struct(F.size(words).cast("long").alias("n_words"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


def repetition_loops(docs: DataFrame, least_words: int = 12, ratio: float = 0.2) -> DataFrame:
    """Texts whose distinct words are a small share of all: the signature of a decoder that loops."""
    counted = docs.select("doc_id", distinct_word_ratio(F.coalesce("text", F.lit(""))).alias("w")).select("doc_id", "w.n_words", "w.n_distinct")
    return counted.withColumn("loops", (F.col("n_words") >= least_words) & (F.col("n_distinct") < ratio * F.col("n_words")))


@F.pandas_udf(T.DoubleType())
def _compression(texts: pd.Series) -> pd.Series:
    data = [t.encode() for t in texts]
    return pd.Series([len(d) / len(zlib.compress(d)) if d else 0.0 for d in data])


def decoder_loops(docs: DataFrame, least_chars: int = 60, compression: float = 2.4, least_words: int = 12, ratio: float = 0.2) -> DataFrame:
    """Texts that a decoder repeated itself in: they compress too well, or few of their words are distinct. Words are
    split at white space, whatever their script and case."""
    text = F.trim(F.coalesce("text", F.lit("")))
    words = F.filter(F.split(F.upper(text), r"(?U)\s+"), lambda w: w != "")
    rows = docs.select("doc_id", F.when(F.char_length(text) >= least_chars, _compression(text)).otherwise(F.lit(0.0)).alias("compression"), F.size(words).cast("long").alias("n_words"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))
    few = (F.col("n_words") >= least_words) & (F.col("n_distinct") < ratio * F.col("n_words"))
    return rows.select("doc_id", "n_words", "n_distinct", ((F.col("compression") > compression) | few).alias("loops"))
