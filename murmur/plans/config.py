"""Queries of configuration: customers are campaigns, parts keyword entities, suppliers stations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions import audio as measures
from murmur.operators import config
from murmur.sources import mention_tables
from murmur.sources.views import Views


def station_settings(v: Views) -> DataFrame:
    """Suppliers as settings files, with comments, quotes, repeats and broken lines."""
    key = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("# a comment\n\nexport STATION_ID="), key, F.lit('\nSTATION_NAME="'), F.col("s_name"), F.lit("\"\n broken line\nLANG='en'\nLANG = hi\n=x\nEMPTY="))
    rows = v.table("supplier").select("s_suppkey", config.settings(text).alias("m"))
    return rows.select("s_suppkey", *[F.try_element_at("m", F.lit(k)).alias(k.lower()) for k in ("STATION_ID", "STATION_NAME", "LANG", "EMPTY")], F.size("m").cast("long").alias("n"))


def metadata_stations(v: Views) -> DataFrame:
    """A metadata document for each nation: a list for some, an object for the others."""
    one = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    lists = v.table("supplier").groupBy("s_nationkey").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("body"))
    docs = lists.select(F.when(F.col("s_nationkey") % 2 == 0, F.col("body")).otherwise(F.concat(F.lit('{"stations": '), "body", F.lit("}"))).alias("body")).unionByName(v.spark.createDataFrame([("{broken",), (None,)], "body string"))
    return config.by_name(config.station_metadata(docs, "body").select(F.col("id").alias("station_id"), "name"))


def keyword_entities(v: Views) -> DataFrame:
    """Parts of one name are an entity; their brands and types are aliases, the brands once more in capitals."""
    links = v.table("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("campaign_id"), F.array_sort(F.collect_set(F.col("l_suppkey") % 5)).alias("station_ids"))
    part = v.table("part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").alias("entity_id"), F.col("p_name").alias("display_name"), F.col("p_partkey").alias("ordinal"), F.array(F.col("p_type"), F.upper("p_brand"), F.col("p_brand"), F.lit(" ")).alias("aliases"))
    got = config.entities(part.join(links, "l_partkey"))
    return got.select("entity_id", "display_name", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("campaign_ids", "station_ids")], F.array_join("aliases", "|").alias("aliases"))


ENTITIES_SQL = """
WITH links AS (SELECT l_partkey, min(l_suppkey) AS c FROM lineitem GROUP BY l_partkey), own AS (SELECT * FROM part JOIN links ON l_partkey = p_partkey),
names AS (SELECT lower(p_name) AS entity_id, unnest([p_type, upper(p_brand), p_brand]) AS alias, unnest([0, 1, 2]) AS i, p_partkey FROM own),
first AS (SELECT entity_id, arg_min(alias, (p_partkey, i)) AS alias, min((p_partkey, i)) AS o FROM names GROUP BY entity_id, lower(alias)),
listed AS (SELECT entity_id, string_agg(alias, '|' ORDER BY o) AS aliases FROM first GROUP BY entity_id),
stations AS (SELECT lower(p_name) AS entity_id, array_to_string(list_sort(list(DISTINCT l_suppkey % 5)), ',') AS station_ids FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY lower(p_name)),
whole AS (SELECT lower(p_name) AS entity_id, arg_min(p_name, p_partkey) AS display_name, array_to_string(list_sort(list(DISTINCT c)), ',') AS campaign_ids FROM own GROUP BY lower(p_name))
SELECT entity_id, display_name, campaign_ids, station_ids, aliases FROM whole JOIN stations USING (entity_id) JOIN listed USING (entity_id)"""


def keyword_configuration(v: Views) -> DataFrame:
    rows = v.table("part").select(F.col("p_partkey").alias("entity_id"), (F.col("p_partkey") % 3 == 0).alias("managed"), F.col("p_name").alias("name"))
    return config.configuration(rows, rows.filter("entity_id % 4 = 0").withColumn("managed", F.lit(True)).withColumn("name", F.lit("new")))


def campaign_requests(v: Views) -> DataFrame:
    n = F.col("c_custkey")
    words = F.when(n % 7 != 0, F.array(F.col("c_mktsegment"), F.lower("c_mktsegment"), F.concat(F.lit(" "), "c_name"), F.lit("")))
    stations = F.when(n % 5 != 0, F.array(F.col("c_nationkey").cast("string")))
    rows = v.table("customer").select("c_custkey", F.when(n % 11 == 0, F.repeat("c_name", 20)).when(n % 13 != 0, F.col("c_name")).otherwise(" ").alias("name"), words.alias("keywords"), stations.alias("station_ids"))
    return config.refused_requests(rows).select("c_custkey", "refused", F.array_join("distinct_keywords", "|").alias("keywords"))


def playback_windows(v: Views) -> DataFrame:
    e = mention_tables.mention_events(v)
    lead = F.make_dt_interval(secs=(F.col("mention_id") % 7).cast("decimal(18,6)"))
    tail = F.make_dt_interval(secs=(F.col("mention_id") % 23).cast("decimal(18,6)"))
    rows = e.select("mention_id", "started_at", "ended_at", (F.col("started_at") - lead).alias("clip_start"), (F.col("started_at") + tail).alias("clip_end"))
    return config.playback(rows).select("mention_id", F.round("play_from", 3).alias("play_from"), F.round("play_to", 3).alias("play_to"))


PLAYBACK_SQL = f"""
WITH {mention_tables.SQL.strip()}, placed AS (SELECT mention_id, mention_id % 7 AS lead, mention_id % 7 + mention_id % 23 AS length, CASE WHEN ended_at IS NULL THEN 0 ELSE 20 END AS said FROM mention_events),
cut AS (SELECT mention_id, least(greatest(lead - 2.0, 0), length) AS a, least(lead + said + 2.0, length) AS b FROM placed)
SELECT mention_id, CAST(a AS DOUBLE) AS play_from, CAST(greatest(b, a + 0.5) AS DOUBLE) AS play_to FROM cut"""


def live_sessions(v: Views) -> DataFrame:
    """Events' users as workers, whose heartbeat lists a session for each of their purchases, and other things."""
    one = F.concat(F.lit('{"station_id": "'), F.col("event_id").cast("string"), F.lit('", "state": "active", "class": "'), F.col("event_type"), F.lit('"}'))
    beats = v.table("events").filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("worker_id")).agg(F.concat(F.lit('{"sessions": [1, "text", '), F.array_join(F.array_sort(F.collect_list(one)), ","), F.lit("]}")).alias("detail"))
    return config.live_sessions(beats, "detail").select("worker_id", "station_id", "state", "class", "session_id")


def selection_summaries(v: Views) -> DataFrame:
    states = ("active", "probing", "failed_probe", "stopped", "activating", "degraded", "pending_capacity")
    state = F.element_at(F.array(*map(F.lit, states)), (F.col("station_id") % len(states) + 1).cast("int"))
    return config.selection_summary(v.campaign_stations().withColumn("state", state))


def fallback_backlog(v: Views) -> DataFrame:
    made = v.table("orders").select(F.col("o_orderkey").alias("mention_id"), F.when(F.col("o_orderstatus") == "P", "fallback").otherwise("ready").alias("status"))
    failed = v.table("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("mention_id"))
    return config.backlog_page(made, mention_tables.mention_events(v).select("mention_id", "started_at"), failed, 20)


def unpublished_mentions(v: Views) -> DataFrame:
    rows = mention_tables.mention_events(v).select("mention_id", "started_at", F.when(F.col("mention_id") % 5 != 0, F.col("started_at")).alias("published_at"))
    return config.unpublished(rows, 30).drop("published_at")


def oldest_deletions(v: Views) -> DataFrame:
    rows = v.table("events").filter("event_type = 'view'").select(F.col("event_id").alias("segment_id"), (F.col("event_id") * 37 % 100_000).alias("age_s"))
    sizes = v.table("orders").select(F.col("o_orderkey").alias("segment_id"), (F.col("o_custkey") * 100).alias("size"))
    return config.deletions(rows, sizes)


def sample_windows(v: Views) -> DataFrame:
    """Texts' bytes in windows of 256 bytes: how many, and their frames (a window is shorter than one)."""
    rows = config.windows_of(v.table("documents").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("pcm")), 256)
    return rows.groupBy("id").agg(F.count("*").alias("n_windows"), F.sum(F.octet_length("pcm")).alias("n_bytes"), F.octet_length(F.max_by("pcm", "window")).cast("long").alias("last_bytes"), F.max(measures.signals(F.col("pcm"))["frame_count"]).alias("most_frames"))


QUERIES = {
    "station_settings": (station_settings, "SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS station_id, s_name AS station_name, 'hi' AS lang, '' AS empty, CAST(4 AS BIGINT) AS n FROM supplier"),
    "metadata_stations": (metadata_stations, "SELECT CAST(s_suppkey AS VARCHAR) AS station_id, s_name AS name, row_number() OVER (ORDER BY lower(s_name), CAST(s_suppkey AS VARCHAR)) AS place FROM supplier"),
    "keyword_entities": (keyword_entities, ENTITIES_SQL),
    "keyword_configuration": (keyword_configuration, """SELECT p_partkey AS entity_id, false AS managed, p_name AS name FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 0
UNION ALL SELECT p_partkey, true, 'new' FROM part WHERE p_partkey % 4 = 0"""),
    "campaign_requests": (campaign_requests, """SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 13 = 0 THEN 'no name' WHEN c_custkey % 11 = 0 THEN 'long name' WHEN c_custkey % 7 = 0 THEN 'no keyword' WHEN c_custkey % 5 = 0 THEN 'no station' END AS refused,
CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment || '|' || c_name END AS keywords FROM customer"""),
    "playback_windows": (playback_windows, PLAYBACK_SQL),
    "live_sessions": (live_sessions, "SELECT user_id AS worker_id, CAST(event_id AS VARCHAR) AS station_id, 'active' AS state, 'purchase' AS class, CAST(NULL AS VARCHAR) AS session_id FROM events WHERE event_type = 'purchase'"),
    "selection_summaries": (selection_summaries, """WITH t AS (SELECT l_orderkey AS campaign_id, l_suppkey % 7 AS m FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem))
SELECT campaign_id, count(*) AS n, count(*) FILTER (m IN (0, 4)) AS active, count(*) FILTER (m IN (1, 6)) AS waiting, count(*) FILTER (m IN (2, 5)) AS failing FROM t GROUP BY campaign_id"""),
    "fallback_backlog": (fallback_backlog, """SELECT o_orderkey AS mention_id, 'fallback' AS status, o_orderdate AS started_at FROM orders WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20"""),
    "unpublished_mentions": (unpublished_mentions, "SELECT o_orderkey AS mention_id, o_orderdate AS started_at FROM orders WHERE o_orderkey % 5 = 0 ORDER BY o_orderdate, o_orderkey LIMIT 30"),
    "oldest_deletions": (oldest_deletions, """SELECT segment_id, age_s, coalesce(o_custkey * 100, 0) AS size FROM (SELECT event_id AS segment_id, event_id * 37 % 100000 AS age_s FROM events WHERE event_type = 'view' ORDER BY age_s DESC, segment_id LIMIT 200) LEFT JOIN orders ON o_orderkey = segment_id"""),
    "sample_windows": (sample_windows, """SELECT doc_id AS id, CAST(ceil(strlen(text) / 256) AS BIGINT) AS n_windows, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(strlen(text) - 256 * (ceil(strlen(text) / 256) - 1) AS BIGINT) AS last_bytes,
CAST(0 AS BIGINT) AS most_frames FROM documents WHERE strlen(text) > 0"""),
}
