"""The mention feed: both stores joined to their campaigns and keywords in one shape, filters, pages and totals.

Nulls: a mention without analysis is neutral, needs review and has an empty context; one without end ends where it
starts; a filter value of None doesn't filter. Ties of a page are broken by mention and campaign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("store", "mention_id", "campaign_id", "campaign_name", "keyword_value", "matched_alias", "station_id", "context", "sentiment", "confidence", "needs_review", "started_at", "clip_end", "audio_key")


def top_keyword(keywords: DataFrame) -> DataFrame:
    """The keyword of each mention and campaign: a confirmed one first, then the first found."""
    best = F.min_by(F.struct("canonical_value", "matched_text"), F.struct((~F.col("confirmed")).alias("c"), "ordinal", "keyword_id"))
    return keywords.groupBy("mention_id", "campaign_id").agg(best.alias("b")).select("mention_id", "campaign_id", F.col("b.canonical_value").alias("keyword_value"), F.col("b.matched_text").alias("matched_alias"))


def label(sentiment: Column) -> Column:
    return F.when(sentiment.isin("positive", "negative"), sentiment).otherwise("neutral")


def campaign_feed(events: DataFrame, fan_out: DataFrame, keywords: DataFrame, analyses: DataFrame, owners: DataFrame, legacy: DataFrame, values: DataFrame) -> DataFrame:
    """A row for each mention and campaign that includes it, and the older store's mentions. values: keyword_id,
    canonical_value."""
    found = events.join(fan_out.filter("included"), "mention_id").join(owners, "campaign_id").join(top_keyword(keywords), ["mention_id", "campaign_id"], "left").join(analyses, "mention_id", "left")
    first = found.select(
        F.lit("pipeline").alias("store"), "mention_id", "campaign_id", "campaign_name",
        F.coalesce("keyword_value", F.lit("")).alias("keyword_value"), "matched_alias", "station_id",
        F.coalesce("summary", F.lit("")).alias("context"), label(F.col("sentiment")).alias("sentiment"), "confidence",
        F.coalesce("needs_review", F.lit(True)).alias("needs_review"), "started_at",
        F.coalesce("ended_at", "started_at").alias("clip_end"), F.when(F.col("evidence_available"), F.col("evidence_key")).alias("audio_key"),
    )
    older = legacy.join(owners, "campaign_id").join(values, "keyword_id").select(
        F.lit("legacy").alias("store"), "mention_id", "campaign_id", "campaign_name",
        F.col("canonical_value").alias("keyword_value"), F.lit(None).cast("string").alias("matched_alias"), "station_id",
        F.lit("").alias("context"), F.col("sentiment"), "confidence", F.lit(True).alias("needs_review"), "started_at",
        F.col("started_at").alias("clip_end"), "audio_key",
    )
    return first.unionByName(older)


def filtered(rows: DataFrame, campaign=None, station=None, sentiment=None, keywords=None, since=None) -> DataFrame:
    """All given filters together."""
    for column, value in (("campaign_id", campaign), ("station_id", station), ("sentiment", sentiment)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    if keywords is not None:
        rows = rows.filter(F.col("keyword_value").isin(*keywords))
    return rows if since is None else rows.filter(F.col("started_at") >= since)


def newest(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(F.desc("started_at"), F.desc("mention_id"), F.desc("campaign_id"), "store").offset(offset).limit(limit)


def page_with_more(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page and, in each of its rows, whether there is a next one: one row more is fetched and not returned."""
    numbered = rows.orderBy(*order).offset(offset).limit(limit + 1).withColumn("place", F.monotonically_increasing_id())
    more = numbered.agg((F.count("*") > limit).alias("has_more"))
    return numbered.orderBy("place").limit(limit).drop("place").join(F.broadcast(more))  # one row


def totals(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Mentions of each campaign over both stores, 0 where there are none."""
    n = rows.groupBy("campaign_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("store") == "pipeline", 1)).alias("n_pipeline"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return owners.select("campaign_id").join(n, "campaign_id", "left").select("campaign_id", zero("n"), zero("n_pipeline"))


def cards(campaigns: DataFrame, stations: DataFrame, keywords: DataFrame) -> DataFrame:
    """Campaigns with their stations and keywords in order, absent ones as empty lists."""
    listed = lambda rows, column: rows.groupBy("campaign_id").agg(F.array_join(F.array_sort(F.collect_set(column)), ",").alias(column + "s"))
    out = campaigns.join(listed(stations, "station"), "campaign_id", "left").join(listed(keywords, "keyword"), "campaign_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("stations", "keywords")})


def pending_analysis(mentions: DataFrame, analyses: DataFrame, settled: Column, retries: int) -> DataFrame:
    """Settled mentions without analysis, with a pending one, or with a failed one that may be tried again. analyses:
    mention_id, status, attempts."""
    both = mentions.filter(settled).join(analyses, "mention_id", "left")
    return both.filter(F.col("status").isNull() | (F.col("status") == "pending") | ((F.col("status") == "error") & (F.col("attempts") < retries)))


def reference_counts(stations: DataFrame, members: DataFrame, campaigns: DataFrame) -> DataFrame:
    """How many active campaigns each station is a member of."""
    active = members.join(campaigns.filter("status = 'active'").select("campaign_id"), "campaign_id").groupBy("station_id").agg(F.countDistinct("campaign_id").alias("n"))
    return stations.join(active, "station_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
