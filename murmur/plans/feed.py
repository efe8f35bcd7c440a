"""Queries of the mention feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators import feed
from murmur.sources import mention_tables as tables
from murmur.sources.views import SQL as VIEWS
from murmur.sources.views import Views


def _feed(v: Views) -> DataFrame:
    values = v.table("part").select(F.col("p_partkey").alias("keyword_id"), F.col("p_name").alias("canonical_value"))
    return feed.campaign_feed(tables.mention_events(v), tables.mention_campaigns(v), tables.mention_keywords(v), tables.analyses(v), tables.owners(v), tables.legacy_mentions(v), values)


FEED = """
feed AS (SELECT 'pipeline' AS store, e.mention_id, mc.campaign_id, c.campaign_name,
  coalesce((SELECT mk.canonical_value FROM mention_keywords mk WHERE mk.mention_id = e.mention_id AND mk.campaign_id = mc.campaign_id ORDER BY mk.confirmed DESC, mk.ordinal, mk.keyword_id LIMIT 1), '') AS keyword_value,
  (SELECT mk.matched_text FROM mention_keywords mk WHERE mk.mention_id = e.mention_id AND mk.campaign_id = mc.campaign_id ORDER BY mk.confirmed DESC, mk.ordinal, mk.keyword_id LIMIT 1) AS matched_alias,
  e.station_id, coalesce(a.summary, '') AS context, CASE WHEN a.sentiment IN ('positive', 'negative') THEN a.sentiment ELSE 'neutral' END AS sentiment, a.confidence,
  coalesce(a.needs_review, true) AS needs_review, e.started_at, coalesce(e.ended_at, e.started_at) AS clip_end, CASE WHEN e.evidence_available THEN e.evidence_key END AS audio_key
 FROM mention_events e JOIN mention_campaigns mc ON mc.mention_id = e.mention_id AND mc.included JOIN owners c ON c.campaign_id = mc.campaign_id LEFT JOIN analyses a ON a.mention_id = e.mention_id
 UNION ALL
 SELECT 'legacy', m.mention_id, m.campaign_id, c.campaign_name, p_name, NULL, m.station_id, '', m.sentiment, m.confidence, true, m.started_at, m.started_at, m.audio_key
 FROM legacy_mentions m JOIN owners c ON c.campaign_id = m.campaign_id JOIN part ON p_partkey = m.keyword_id)
"""


def _with(body: str, *more: str) -> str:
    return "WITH " + ", ".join(x.strip() for x in more) + " " + body


def campaign_feed(v: Views) -> DataFrame:
    return _feed(v)


def filtered_feed(v: Views) -> DataFrame:
    return feed.filtered(_feed(v), campaign=7, sentiment="positive", since="1995-01-01")


def feed_of_keywords(v: Views) -> DataFrame:
    names = [r.p_name for r in v.table("part").select("p_name").distinct().orderBy("p_name").limit(5).collect()]
    return feed.filtered(_feed(v), keywords=names).groupBy("keyword_value", "sentiment").agg(F.count("*").alias("n"), F.max("started_at").alias("latest_at"))


def newest_mentions(v: Views) -> DataFrame:
    return feed.newest(_feed(v), 40, 20)


def mentions_with_more(v: Views) -> DataFrame:
    rows = feed.filtered(_feed(v), station="st7").select("store", "mention_id", "campaign_id", "started_at")
    return feed.page_with_more(rows, [F.desc("started_at"), F.desc("mention_id"), F.desc("campaign_id"), "store"], 10, 5)


def campaign_totals(v: Views) -> DataFrame:
    return feed.totals(_feed(v), tables.owners(v))


def campaign_cards(v: Views) -> DataFrame:
    owners = v.campaigns().select("campaign_id", "status", "created_at")
    return feed.cards(owners, v.campaign_stations().select("campaign_id", F.lpad(F.col("station_id").cast("string"), 6, "0").alias("station")), v.campaign_keywords().select("campaign_id", F.col("value").alias("keyword")))


def pending_analysis(v: Views) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("pending", "ready", "error"))), (F.col("o_custkey") % 3 + 1).cast("int"))
    made = v.table("orders").filter("o_orderkey % 6 <> 0").select(F.col("o_orderkey").alias("mention_id"), status.alias("status"), (F.col("o_custkey") % 5).alias("attempts"))
    rows = feed.pending_analysis(tables.mention_events(v), made, F.col("started_at") <= F.lit("1998-01-01").cast("timestamp_ntz"), 3)
    return rows.orderBy("started_at", "mention_id").limit(100).select("mention_id", "started_at", "status", "attempts")


def station_references(v: Views) -> DataFrame:
    every = v.table("supplier").select(F.col("s_suppkey").alias("station_id"))
    return feed.reference_counts(every, v.campaign_stations(), v.campaigns())


QUERIES = {
    "campaign_feed": (campaign_feed, _with("SELECT * FROM feed", tables.SQL, FEED)),
    "filtered_feed": (filtered_feed, _with("SELECT * FROM feed WHERE campaign_id = 7 AND sentiment = 'positive' AND started_at >= TIMESTAMP '1995-01-01'", tables.SQL, FEED)),
    "feed_of_keywords": (feed_of_keywords, _with("""SELECT keyword_value, sentiment, count(*) AS n, max(started_at) AS latest_at FROM feed
WHERE keyword_value IN (SELECT DISTINCT p_name FROM part ORDER BY p_name LIMIT 5) GROUP BY ALL""", tables.SQL, FEED)),
    "newest_mentions": (newest_mentions, _with("SELECT * FROM feed ORDER BY started_at DESC, mention_id DESC, campaign_id DESC, store LIMIT 40 OFFSET 20", tables.SQL, FEED)),
    "mentions_with_more": (mentions_with_more, _with("""SELECT store, mention_id, campaign_id, started_at, (SELECT count(*) FROM feed WHERE station_id = 'st7') > 15 AS has_more
FROM feed WHERE station_id = 'st7' ORDER BY started_at DESC, mention_id DESC, campaign_id DESC, store LIMIT 10 OFFSET 5""", tables.SQL, FEED)),
    "campaign_totals": (campaign_totals, _with("SELECT campaign_id, count(store) AS n, count(*) FILTER (store = 'pipeline') AS n_pipeline FROM owners LEFT JOIN feed USING (campaign_id) GROUP BY campaign_id", tables.SQL, FEED)),
    "campaign_cards": (campaign_cards, _with("""SELECT campaign_id, status, created_at, coalesce(stations, '') AS stations, coalesce(keywords, '') AS keywords FROM campaigns
LEFT JOIN (SELECT campaign_id, string_agg(s, ',' ORDER BY s) AS stations FROM (SELECT DISTINCT campaign_id, lpad(CAST(station_id AS VARCHAR), 6, '0') AS s FROM campaign_stations) GROUP BY campaign_id) USING (campaign_id)
LEFT JOIN (SELECT campaign_id, string_agg(value, ',' ORDER BY value) AS keywords FROM (SELECT DISTINCT campaign_id, value FROM campaign_keywords) GROUP BY campaign_id) USING (campaign_id)""", VIEWS)),
    "pending_analysis": (pending_analysis, _with("""SELECT mention_id, started_at, status, attempts FROM mention_events
LEFT JOIN (SELECT o_orderkey AS mention_id, ['pending', 'ready', 'error'][o_custkey % 3 + 1] AS status, o_custkey % 5 AS attempts FROM orders WHERE o_orderkey % 6 <> 0) USING (mention_id)
WHERE started_at <= TIMESTAMP '1998-01-01' AND (status IS NULL OR status = 'pending' OR (status = 'error' AND attempts < 3)) ORDER BY started_at, mention_id LIMIT 100""", tables.SQL)),
    "station_references": (station_references, _with("""SELECT s_suppkey AS station_id, coalesce(n, 0) AS n FROM supplier LEFT JOIN
(SELECT station_id, count(DISTINCT campaign_id) AS n FROM campaign_stations JOIN campaigns USING (campaign_id) WHERE status = 'active' GROUP BY station_id) ON station_id = s_suppkey""", VIEWS)),
}
