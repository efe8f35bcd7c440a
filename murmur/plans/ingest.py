"""Queries of incremental ingest: events are result objects and mentions, parts are bound keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators import ingest
from murmur.sources.views import Views

BUCKET, PREFIXES = "radio", ("audio/", "clips/")


def _objects(v: Views) -> DataFrame:
    return v.table("events").select(F.concat(F.lit("r/"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 9 == 0, ".tmp").otherwise(".json")).alias("key"), F.md5(F.col("event_id").cast("string")).alias("etag"), F.col("ts").alias("modified_at"))


def _watermarks(v: Views) -> DataFrame:
    old = F.col("event_id") % 4 == 0
    return v.table("events").filter("event_id % 3 <> 0").select(F.concat(F.lit("r/"), F.col("event_id").cast("string"), F.lit(".json")).alias("key"), F.when(old, "old").otherwise(F.md5(F.col("event_id").cast("string"))).alias("etag"), F.when(F.col("event_id") % 5 == 0, 6).otherwise(7).alias("revision"))


def changed_objects(v: Views) -> DataFrame:
    return ingest.changed(_objects(v), _watermarks(v), F.lit(7), F.lit("2024-01-05").cast("timestamp_ntz"), 5000)


CHANGED_SQL = """
WITH listed AS (SELECT 'r/' || event_id || '.json' AS key, md5(CAST(event_id AS VARCHAR)) AS etag, ts AS modified_at, event_id FROM events WHERE event_id % 9 <> 0 AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts DESC, key LIMIT 5000)
SELECT key, etag, modified_at FROM listed WHERE NOT (event_id % 3 <> 0 AND event_id % 4 <> 0 AND event_id % 5 <> 0)"""


def due_scans(v: Views) -> DataFrame:
    """A part is bound to two stations, that may have no groups, and to one that isn't known (null)."""
    groups = v.table("events").groupBy(F.col("user_id").alias("station_id")).agg(F.sha2(F.concat_ws("|", F.min("event_id").cast("string"), F.max("event_id").cast("string")), 256).alias("fingerprint")).withColumn("group_key", F.concat(F.lit("g/"), F.col("station_id").cast("string")))
    bindings = v.table("part").select(F.col("p_partkey").alias("keyword_id"), F.array(F.col("p_partkey") % 150, F.col("p_size").cast("long"), F.lit(None).cast("long")).alias("station_ids"))
    done = groups.join(bindings.select("keyword_id", F.explode("station_ids").alias("station_id")).distinct(), "station_id").filter("keyword_id % 2 = 0").select("keyword_id", "group_key", F.when(F.col("keyword_id") % 6 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.lit(7).alias("revision"), F.when(F.col("keyword_id") % 10 == 0, "error").otherwise("ready").alias("status"))
    return ingest.scans_due(groups, bindings, done, F.lit(7)).select("keyword_id", "group_key")


def replaced_mentions(v: Views) -> DataFrame:
    """Lines are mentions of the result object that is their order; objects divisible by three were read again, with
    other lines."""
    rows = v.table("lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_orderkey").alias("object"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").alias("value"), F.col("l_shipdate").alias("created_at"))
    rows = rows.groupBy("source", "object", "line").agg(F.max("value").alias("value"), F.max("created_at").alias("created_at"))
    old = rows.filter("line <= 4")
    new = rows.filter("source % 3 = 0 AND line >= 2").withColumn("value", -F.col("value")).withColumn("created_at", F.lit("2030-01-01").cast("timestamp_ntz"))
    return ingest.replaced_by_source(old, new, new, "source", ["object", "line"], ("created_at",))


REPLACED_SQL = """
WITH rows AS (SELECT l_orderkey AS source, l_orderkey AS object, CAST(l_linenumber AS BIGINT) AS line, max(l_quantity) AS value, max(l_shipdate) AS created_at FROM lineitem GROUP BY ALL),
new AS (SELECT * FROM rows WHERE source % 3 = 0 AND line >= 2)
SELECT * FROM rows WHERE line <= 4 AND source NOT IN (SELECT source FROM new)
UNION ALL SELECT source, object, line, -value, CASE WHEN line <= 4 THEN created_at ELSE TIMESTAMP '2030-01-01' END FROM new"""


def scan_memos(v: Views) -> DataFrame:
    rows = v.table("lineitem").select(F.col("l_partkey").alias("keyword_id"), F.col("l_suppkey").alias("group_key"), F.col("l_shipdate").alias("scanned_at"), "l_returnflag")
    memo = lambda flags: rows.filter(F.col("l_returnflag").isin(*flags)).groupBy("keyword_id", "group_key").agg(F.max("scanned_at").alias("scanned_at")).withColumn("status", F.lit(flags[0]))
    return ingest.last_wins(memo(("A",)), memo(("N", "R")), ["keyword_id", "group_key"], "scanned_at")


MEMO_SQL = """
WITH m AS (SELECT l_partkey AS keyword_id, l_suppkey AS group_key, max(l_shipdate) AS scanned_at, CASE WHEN l_returnflag = 'A' THEN 'A' ELSE 'N' END AS status FROM lineitem GROUP BY ALL)
SELECT keyword_id, group_key, scanned_at, status FROM m QUALIFY row_number() OVER (PARTITION BY keyword_id, group_key ORDER BY scanned_at DESC, status DESC) = 1"""


def bound_mentions(v: Views) -> DataFrame:
    """A mention names an entity, or only a part's name and type."""
    mentions = v.table("lineitem").filter("l_linenumber = 1").select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("id"), (F.col("l_suppkey") % 20).alias("station_id"), F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("e"), (F.col("l_partkey") % 300).cast("string"))).alias("entity_id"), "l_partkey").distinct()
    named = mentions.join(v.table("part").select(F.col("p_partkey").alias("l_partkey"), F.array(F.lower("p_name"), F.lit("")).alias("names")), "l_partkey").drop("l_partkey")
    bindings = v.table("part").filter("p_partkey <= 120").select(F.col("p_partkey").alias("keyword_id"), (F.col("p_partkey") % 7).alias("campaign_id"), F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("entity_id"), F.array(F.lower("p_name"), F.lower("p_type")).alias("aliases"), F.array(F.col("p_partkey") % 20, (F.col("p_partkey") + 1) % 20).alias("station_ids"))
    return ingest.bound(named, bindings)


BOUND_SQL = """
WITH mentions AS (SELECT DISTINCT l_orderkey || ':' || l_suppkey || ':' || l_partkey AS id, l_suppkey % 20 AS station_id, CASE WHEN l_orderkey % 2 = 0 THEN 'e' || (l_partkey % 300) END AS entity_id, lower(p_name) AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1),
bindings AS (SELECT p_partkey AS keyword_id, p_partkey % 7 AS campaign_id, 'e' || p_partkey AS entity_id, [lower(p_name), lower(p_type)] AS aliases, [p_partkey % 20, (p_partkey + 1) % 20] AS station_ids FROM part WHERE p_partkey <= 120),
first AS (SELECT id, station_id, keyword_id, campaign_id, station_ids FROM mentions JOIN bindings USING (entity_id)),
second AS (SELECT id, station_id, keyword_id, campaign_id, station_ids FROM mentions m JOIN bindings b ON list_contains(b.aliases, m.name) WHERE id NOT IN (SELECT id FROM first))
SELECT id, station_id, keyword_id, min(campaign_id) AS campaign_id FROM (FROM first UNION ALL FROM second) WHERE list_contains(station_ids, station_id) GROUP BY id, station_id, keyword_id"""


def attributed_mentions(v: Views) -> DataFrame:
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    n = F.col("event_id")
    rows = v.table("events").select("event_id", F.when(n % 5 == 0, "soon").when(n % 5 == 1, F.concat(iso(F.col("ts")), F.lit("Z"))).otherwise(iso(F.col("ts"))).alias("start_text"), F.lit(None).cast("string").alias("end_text"), F.concat(iso(F.col("ts") + F.expr("INTERVAL 1 MINUTE")), F.lit("Z")).alias("clip_start_text"), F.when(n % 7 != 0, F.concat(iso(F.col("ts") + F.expr("INTERVAL 2 MINUTES")), F.lit("Z"))).alias("clip_end_text"), F.lit("2024-01-08T00:00:00Z").cast("timestamp").alias("monitor_from"), F.concat(F.when(n % 11 == 0, "s3://other/").otherwise("s3://radio/"), F.element_at(F.array(F.lit("audio/"), F.lit("clips/"), F.lit("raw/")), (n % 3 + 1).cast("int")), F.when(n % 13 != 0, n.cast("string")).otherwise("")).alias("audio_uri"), F.upper("event_type").alias("label"))
    kept = ingest.attributed(rows, BUCKET, PREFIXES)
    return kept.select("event_id", *[F.unix_micros(c).alias(c) for c in ("started_at", "clip_start", "clip_end")], "audio_key", "label", ingest.mention_ids(F.when(n % 2 == 0, F.concat(F.lit(" m"), n.cast("string"))), F.col("audio_key"), n).alias("mention_id"))


ATTRIBUTED_SQL = """
WITH rows AS (SELECT event_id AS n, date_trunc('second', ts) AS t, ['audio/', 'clips/', 'raw/'][event_id % 3 + 1] || CASE WHEN event_id % 13 <> 0 THEN CAST(event_id AS VARCHAR) ELSE '' END AS key FROM events),
timed AS (SELECT *, CASE WHEN n % 5 = 0 THEN t + INTERVAL 1 MINUTE ELSE t END AS s, t + INTERVAL 1 MINUTE AS a, CASE WHEN n % 7 <> 0 THEN t + INTERVAL 2 MINUTES END AS b FROM rows)
SELECT n AS event_id, epoch_us(s) AS started_at, epoch_us(a) AS clip_start, epoch_us(coalesce(b, s)) AS clip_end, key AS audio_key, 'neutral' AS label,
 CASE WHEN n % 2 = 0 THEN 'm' || n ELSE substr(sha256(key || '|' || n), 1, 32) END AS mention_id
FROM timed WHERE s >= TIMESTAMP '2024-01-08' AND coalesce(b, s) >= a AND n % 11 <> 0 AND n % 3 <> 2 AND n % 13 <> 0"""


def station_overlay(v: Views) -> DataFrame:
    mentions = v.table("documents").select("doc_id", (F.col("doc_id") % 130 + 1).cast("string").alias("station_id"), F.when(F.col("doc_id") % 2 == 0, "as told").alias("station_name"))
    stations = v.table("supplier").join(v.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey").select(F.col("s_suppkey").cast("string").alias("station_id"), F.col("s_name").alias("name"), F.substring("n_name", 1, 2).alias("country_code"), F.array(F.lower(F.substring("n_name", 1, 2))).alias("language_codes"))
    return ingest.overlaid(mentions, stations).withColumn("language_codes", F.array_join("language_codes", ","))


def published_indexes(v: Views) -> DataFrame:
    """Orders are index versions of their customer; the status is the fingerprint."""
    held = v.table("orders").select(F.col("o_custkey").alias("station_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("fingerprint"))
    return ingest.published(held, v.table("customer").select(F.col("c_custkey").alias("station_id"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("O").alias("fingerprint")))


QUERIES = {
    "changed_objects": (changed_objects, CHANGED_SQL),
    "due_scans": (due_scans, """WITH want AS (SELECT DISTINCT p_partkey AS keyword_id, unnest([p_partkey % 150, p_size]) AS station_id FROM part)
SELECT keyword_id, 'g/' || station_id AS group_key FROM want WHERE station_id IN (SELECT user_id FROM events) AND NOT (keyword_id % 2 = 0 AND keyword_id % 6 <> 0 AND keyword_id % 10 <> 0)"""),
    "replaced_mentions": (replaced_mentions, REPLACED_SQL),
    "scan_memos": (scan_memos, MEMO_SQL),
    "bound_mentions": (bound_mentions, BOUND_SQL),
    "attributed_mentions": (attributed_mentions, ATTRIBUTED_SQL),
    "station_overlay": (station_overlay, """SELECT doc_id, CAST(doc_id % 130 + 1 AS VARCHAR) AS station_id, coalesce(s_name, CASE WHEN doc_id % 2 = 0 THEN 'as told' END, CAST(doc_id % 130 + 1 AS VARCHAR)) AS station_name,
substr(n_name, 1, 2) AS country_code, coalesce(lower(substr(n_name, 1, 2)), '') AS language_codes FROM documents LEFT JOIN supplier ON s_suppkey = doc_id % 130 + 1 LEFT JOIN nation ON n_nationkey = s_nationkey"""),
    "published_indexes": (published_indexes, """SELECT c_custkey AS station_id, coalesce(v, 0) + 1 AS version, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS fingerprint FROM customer
LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS v, arg_max(o_orderstatus, o_orderkey) AS f FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey WHERE f IS DISTINCT FROM CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END"""),
}
