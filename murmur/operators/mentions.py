"""Mention feed: union of stores, labels and defaults, filters, paging, counts, top keyword, policy fan-out.

Nulls: a missing label is neutral, a missing review flag asks for review, a null key is in no campaign or group of others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def feed(mentions: DataFrame, legacy: DataFrame) -> DataFrame:
    """Both mention stores in one shape, with a discriminator, bucketed labels and defaults."""
    label = F.when(F.col("quality") == 1, "positive").when((F.col("quality") == 0) & (F.col("toxic") == 1), "negative").otherwise("neutral")
    first = mentions.select(F.lit("pipeline").alias("store"), "mention_id", "station", label.alias("sentiment"), F.coalesce("toxic", F.lit(1)).cast("long").alias("needs_review"), F.coalesce("lang", F.lit("")).alias("language"))
    second = legacy.select(F.lit("legacy").alias("store"), "mention_id", "station", F.when(F.col("label").isin("positive", "negative"), F.col("label")).otherwise("neutral").alias("sentiment"), F.lit(1).cast("long").alias("needs_review"), F.lit("").alias("language"))
    return first.unionByName(second)


def filtered(rows: DataFrame, station=None, sentiment=None, stores=None) -> DataFrame:
    """All given filters together; an absent one doesn't filter."""
    for column, value in (("station", station), ("sentiment", sentiment)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows if stores is None else rows.filter(F.col("store").isin(*stores))


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def sentiment_counts(rows: DataFrame) -> DataFrame:
    """One row with the count of each label, the whole, and the rows that need review."""
    count = lambda k: F.count(F.when(F.col("sentiment") == k, 1)).alias(k)
    return rows.agg(*map(count, ("positive", "neutral", "negative")), F.count("*").alias("total"), F.coalesce(F.sum("needs_review"), F.lit(0)).alias("needs_review"))


def top_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key. Aggregates before it moves rows, so a hot key isn't sorted in one task."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def fan_out(mentions: DataFrame, campaigns: DataFrame, defaults: dict[str, bool], on: str = "station") -> DataFrame:
    """One row for each mention and campaign with the policy verdict, joined by ``on``: by station each mention meets every
    campaign of it, by mention_id its own. mentions: mention_id, flag (null: none); campaigns: campaign_id, policy (map of
    flag to boolean, null: the defaults)."""
    merged = F.map_zip_with(F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]), F.coalesce("policy", F.create_map().cast("map<string,boolean>")), lambda k, a, b: F.coalesce(b, a))
    both = mentions.join(campaigns.withColumn("merged", merged).drop("policy"), on)
    allowed = F.coalesce(F.try_element_at("merged", F.col("flag")), F.lit(True))
    included = F.col("flag").isNull() | allowed
    return both.select("mention_id", "campaign_id", included.alias("included"), F.when(~included, F.concat(F.lit("excluded by "), "flag")).alias("reason"))


def best_pass(transcripts: DataFrame) -> DataFrame:
    """The later ASR pass of each segment. transcripts: segment_id, pass, and others."""
    return top_by(transcripts.withColumn("_p", -F.ascii("pass")), ["segment_id"], ["_p"]).drop("_p")


def running_rank(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
