"""Campaign intent to searchable station indexes: star join, surface forms, fingerprints, subscription states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bindings(campaigns: DataFrame, stations: DataFrame, keywords: DataFrame) -> DataFrame:
    """One row for each station, keyword and campaign of the active campaigns' enabled keywords."""
    active = campaigns.filter(F.col("status") == "active").select("campaign_id")
    return stations.join(active, "campaign_id").join(keywords.filter("enabled"), "campaign_id")


def station_demand(bound: DataFrame) -> DataFrame:
    """Reference and index counts of each station."""
    return bound.groupBy("station_id").agg(
        F.countDistinct("campaign_id").alias("reference_count"),
        F.countDistinct("keyword_id").alias("keyword_count"),
        F.count("*").alias("binding_count"),
    )


def index_terms(bound: DataFrame) -> DataFrame:
    """Values of each station without regard to case and outer spaces: the least display, sorted distinct keywords. The
    script-aware index, with aliases and boundaries, is ``matching.index_terms``."""
    term = F.trim(F.lower("value"))
    return bound.filter(term != "").groupBy("station_id", term.alias("term")).agg(
        F.min("value").alias("display"),
        F.array_join(F.transform(F.array_sort(F.collect_set("keyword_id")), lambda x: x.cast("string")), ",").alias("keyword_ids"),
        F.char_length(F.first(term)).cast("long").alias("length"),
    )


def fingerprint(parts: Column) -> Column:
    """SHA-256 over the parts, each ended by NUL."""
    return F.sha2(F.array_join(F.transform(parts, lambda p: F.concat(p, F.lit("\0"))), ""), 256)


def index_fingerprints(bound: DataFrame) -> DataFrame:
    """One fingerprint a station over its keyword and campaign pairs in order; it changes only when the index does."""
    entry = F.concat_ws("|", F.lpad(F.col("keyword_id").cast("string"), 12, "0"), F.lpad(F.col("campaign_id").cast("string"), 12, "0"), F.col("value"))
    parts = F.array_sort(F.collect_set(entry))
    return bound.groupBy("station_id").agg(fingerprint(F.concat(F.array(F.first(F.col("station_id").cast("string"))), parts)).alias("fingerprint"))


def subscription_states(desired: DataFrame, existing: DataFrame, grace_s: int = 300) -> DataFrame:
    """Next state of each station. desired: station_id, reference_count; existing: station_id, state, deadline_s
    (seconds to the wind-down deadline, null: none)."""
    both = desired.join(existing, "station_id", "full_outer")
    wanted, state = F.coalesce("reference_count", F.lit(0)) > 0, F.col("state")
    admitted = F.when(state.isNull() | state.isin("stopped", "desired", "winding_down"), "pending_capacity").otherwise(state)
    dropped = F.when(F.col("deadline_s").isNull(), F.when(state == "stopped", "stopped").otherwise("winding_down")).when(F.col("deadline_s") <= 0, "stopped").otherwise("winding_down")
    deadline = F.when(wanted, F.lit(None).cast("long")).when(F.col("deadline_s").isNull() & (state != "stopped"), F.lit(grace_s).cast("long")).when(F.col("deadline_s") > 0, F.col("deadline_s"))
    return both.select("station_id", F.coalesce("reference_count", F.lit(0)).cast("long").alias("reference_count"), F.when(wanted, admitted).otherwise(dropped).alias("state"), deadline.alias("deadline_s"))
