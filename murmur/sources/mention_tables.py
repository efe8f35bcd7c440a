"""The mention store's tables as views of the given ones: orders are mentions, their lines the campaigns and keywords
that a mention has, suppliers are campaigns, events are mentions of the older store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.sources.views import Views


def mention_events(v: Views) -> DataFrame:
    key = F.col("o_orderkey")
    return v.table("orders").select(
        key.alias("mention_id"),
        F.concat(F.lit("st"), (F.col("o_custkey") % 100).cast("string")).alias("station_id"),
        F.col("o_orderdate").alias("started_at"),
        F.when(key % 4 != 0, F.col("o_orderdate") + F.expr("INTERVAL 20 SECONDS")).alias("ended_at"),
        (key % 3 == 0).alias("evidence_available"),
        F.concat(F.lit("evidence/"), key.cast("string")).alias("evidence_key"),
    )


def mention_campaigns(v: Views) -> DataFrame:
    lines = v.spread("lineitem", v.table("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag"), "l_orderkey")
    return lines.groupBy(F.col("l_orderkey").alias("mention_id"), F.col("l_suppkey").alias("campaign_id")).agg((F.max("l_returnflag") != "R").alias("included"))


def mention_keywords(v: Views) -> DataFrame:
    part = v.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("canonical_value"), F.col("p_type").alias("matched_text"))
    return v.table("lineitem").join(part, "l_partkey").select(F.col("l_orderkey").alias("mention_id"), F.col("l_suppkey").alias("campaign_id"), F.col("l_partkey").alias("keyword_id"), "canonical_value", "matched_text", (F.col("l_linestatus") == "O").alias("confirmed"), F.col("l_linenumber").alias("ordinal"))


def analyses(v: Views) -> DataFrame:
    mood = F.element_at(F.create_map(*[F.lit(x) for x in ("1-URGENT", "negative", "2-HIGH", "mixed", "3-MEDIUM", "positive")]), F.col("o_orderpriority"))
    return v.table("orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("mention_id"), mood.alias("sentiment"), F.round(F.col("o_totalprice") % 1, 2).alias("confidence"), (F.col("o_orderkey") % 5 == 0).alias("needs_review"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("summary"))


def owners(v: Views) -> DataFrame:
    return v.table("supplier").select(F.col("s_suppkey").alias("campaign_id"), F.col("s_name").alias("campaign_name"))


def legacy_mentions(v: Views) -> DataFrame:
    label = F.when(F.col("value") > 50, "positive").when(F.col("value") > 20, "mixed").otherwise("negative")
    return v.table("events").filter("event_type IN ('purchase', 'click')").select(
        F.col("event_id").alias("mention_id"),
        (F.col("user_id") % 90 + 1).alias("campaign_id"),
        (F.col("user_id") % 150 + 1).alias("keyword_id"),
        F.concat(F.lit("st"), (F.col("user_id") % 100).cast("string")).alias("station_id"),
        label.alias("sentiment"),
        F.col("value").alias("confidence"),
        F.col("ts").alias("started_at"),
        F.concat(F.lit("clip/"), F.col("event_id").cast("string")).alias("audio_key"),
    )


SQL = """
mention_events AS (SELECT o_orderkey AS mention_id, 'st' || (o_custkey % 100) AS station_id, o_orderdate AS started_at,
 CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL 20 SECONDS END AS ended_at, o_orderkey % 3 = 0 AS evidence_available, 'evidence/' || o_orderkey AS evidence_key FROM orders),
mention_campaigns AS (SELECT l_orderkey AS mention_id, l_suppkey AS campaign_id, max(l_returnflag) <> 'R' AS included FROM lineitem GROUP BY ALL),
mention_keywords AS (SELECT l_orderkey AS mention_id, l_suppkey AS campaign_id, l_partkey AS keyword_id, p_name AS canonical_value, p_type AS matched_text,
 l_linestatus = 'O' AS confirmed, l_linenumber AS ordinal FROM lineitem JOIN part ON p_partkey = l_partkey),
analyses AS (SELECT o_orderkey AS mention_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'negative' WHEN '2-HIGH' THEN 'mixed' WHEN '3-MEDIUM' THEN 'positive' END AS sentiment,
 round(o_totalprice % 1, 2) AS confidence, o_orderkey % 5 = 0 AS needs_review, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS summary FROM orders WHERE o_orderstatus <> 'P'),
owners AS (SELECT s_suppkey AS campaign_id, s_name AS campaign_name FROM supplier),
legacy_mentions AS (SELECT event_id AS mention_id, user_id % 90 + 1 AS campaign_id, user_id % 150 + 1 AS keyword_id, 'st' || (user_id % 100) AS station_id,
 CASE WHEN value > 50 THEN 'positive' WHEN value > 20 THEN 'mixed' ELSE 'negative' END AS sentiment, value AS confidence, ts AS started_at, 'clip/' || event_id AS audio_key
 FROM events WHERE event_type IN ('purchase', 'click'))
"""
