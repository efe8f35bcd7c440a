"""Queries of changes over several tables: orders are campaigns, mentions or jobs, their lines are bindings, suppliers are
stations, customers ask for new campaigns, events are reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators import audio as media
from murmur.operators import changes, ingest, tables
from murmur.sources import objects
from murmur.sources.views import Views


def _campaigns(v: Views) -> DataFrame:
    return v.table("orders").select(F.col("o_orderkey").cast("string").alias("campaign_id"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("paused").alias("status"), F.col("o_orderdate").alias("monitor_from"))


def _stations(v: Views) -> DataFrame:
    return v.table("lineitem").select(F.col("l_orderkey").cast("string").alias("campaign_id"), F.col("l_suppkey").alias("station_id")).distinct()


def _created(v: Views) -> dict[str, DataFrame]:
    """Customers ask for campaigns of their number: some exist already, some have no name."""
    words = F.array(*[F.struct(F.concat(F.col("c_mktsegment"), F.lit(f" {i}")).alias("value"), F.lit("tokens").alias("match_mode"), F.lit("topic").alias("keyword_type")) for i in (1, 2)])
    asked = v.table("customer").select((F.col("c_custkey") * 50).cast("string").alias("campaign_id"), F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.lit("2024-01-01").cast("timestamp_ntz").alias("monitor_from"), F.array(F.col("c_custkey") % 10, F.col("c_custkey") % 5, F.col("c_custkey") % 10).alias("station_ids"), words.alias("keywords"))
    none = v.spark.createDataFrame([], "keyword_id string, campaign_id string, entity_id string, value string, match_mode string, keyword_type string, enabled boolean")
    meta = v.table("nation").select(F.col("n_nationkey").cast("long").alias("revision"))
    return changes.created_campaigns(_campaigns(v), _stations(v), none, meta, asked)


def created_campaigns(v: Views) -> DataFrame:
    return _created(v)["campaigns"]


def created_children(v: Views) -> DataFrame:
    """Stations and keywords of all campaigns after the change, by campaign, with the new revision."""
    after = _created(v)
    n = after["campaign_stations"].groupBy("campaign_id").agg(F.count("*").alias("n_stations"), F.min("station_id").alias("first_station"))
    words = after["campaign_keywords"].groupBy("campaign_id").agg(F.count("*").alias("n_keywords"), F.min("value").alias("first_value"), F.count_distinct("keyword_id").alias("n_ids"))
    return n.join(words, "campaign_id", "left").join(after["meta"].hint("broadcast"), F.lit(True))  # one row


CREATED = """olds AS (SELECT CAST(o_orderkey AS VARCHAR) AS campaign_id, o_orderpriority AS name, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'paused' END AS status, o_orderdate AS monitor_from FROM orders),
news AS (SELECT CAST(c_custkey * 50 AS VARCHAR) AS campaign_id, c_name AS name, c_custkey, c_mktsegment FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey * 50 NOT IN (SELECT o_orderkey FROM orders))"""


def _updated(v: Views) -> dict[str, DataFrame]:
    k = F.col("o_orderkey")
    some = v.table("orders").filter(k % 3 == 0).select(k.cast("string").alias("campaign_id"), F.when(k % 2 == 0, F.concat(F.lit("n"), k.cast("string"))).alias("name"), F.when(k % 5 == 0, "stopped").alias("status"), F.when(k % 4 == 0, F.array(k % 10, F.lit(3).cast("long"))).when(k % 7 == 0, F.array().cast("array<bigint>")).alias("station_ids"))
    return changes.updated_campaigns(_campaigns(v), _stations(v), some)


def updated_campaigns(v: Views) -> DataFrame:
    after = _updated(v)
    n = after["campaign_stations"].groupBy("campaign_id").agg(F.count("*").alias("n_stations"), F.sum("station_id").alias("stations"))
    return after["campaigns"].join(n, "campaign_id", "left").select("campaign_id", "name", "status", F.coalesce("n_stations", F.lit(0)).alias("n_stations"), "stations")


UPDATED_SQL = """
WITH olds AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS campaign_id, o_orderpriority AS name, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'paused' END AS status FROM orders),
bound AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem),
after AS (SELECT k, s FROM bound WHERE k NOT IN (SELECT k FROM olds WHERE k % 3 = 0 AND (k % 4 = 0 OR k % 7 = 0))
 UNION ALL SELECT k, s FROM (SELECT DISTINCT k, unnest([k % 10, 3]) AS s FROM olds WHERE k % 12 = 0)),
counted AS (SELECT k, count(*) AS n, CAST(sum(s) AS BIGINT) AS t FROM after GROUP BY k)
SELECT campaign_id, CASE WHEN k % 6 = 0 THEN 'n' || campaign_id ELSE name END AS name, CASE WHEN k % 15 = 0 THEN 'stopped' ELSE status END AS status, coalesce(n, 0) AS n_stations, t AS stations FROM olds LEFT JOIN counted USING (k)"""


def deleted_campaigns(v: Views) -> DataFrame:
    """What is left after campaigns without an active state are deleted, with their children."""
    gone = _campaigns(v).filter("status <> 'active'")
    keywords = v.table("lineitem").select(F.col("l_orderkey").cast("string").alias("campaign_id"), F.col("l_partkey").alias("keyword_id"))
    after = changes.deleted_campaigns(_campaigns(v), {"campaign_stations": _stations(v), "campaign_keywords": keywords}, gone)
    parts = [rows.agg(F.count("*").alias("n"), F.count_distinct("campaign_id").alias("campaigns")).withColumn("table_name", F.lit(name)) for name, rows in after.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _statuses(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    u, e = F.col("user_id"), F.col("event_id")
    kinds = F.create_map(*[F.lit(x) for x in ("view", "streaming", "click", "reconnecting", "error", "failed", "purchase", "odd")])
    reports = v.table("events").select((u * 10 + e % 3).alias("session_id"), u.alias("station_id"), (e % 4).alias("generation"), F.try_element_at(kinds, F.col("event_type")).alias("status"), F.col("ts").alias("last_audio_at"), F.when(F.col("event_type") == "error", F.repeat(F.col("props"), 60)).alias("last_error"), F.col("ts").alias("started_at"), F.col("ts").alias("reported_at"))
    sessions = v.table("supplier").select((F.col("s_suppkey") * 10).alias("session_id"), F.col("s_suppkey").alias("station_id"), F.lit(0).cast("long").alias("generation"), F.lit("connecting").alias("status"), F.lit(None).cast("timestamp_ntz").alias("last_audio_at"), F.lit(None).cast("string").alias("last_error"), F.lit("2020-01-01").cast("timestamp_ntz").alias("started_at"))
    states = F.array(*map(F.lit, ("starting", "active", "degraded", "pending_capacity", "stopped")))
    subscriptions = v.table("supplier").select(F.col("s_suppkey").alias("station_id"), F.get(states, (F.col("s_suppkey") % 5).cast("int")).alias("state"), F.lit("old").alias("state_reason"))
    return sessions, subscriptions, reports


def session_states(v: Views) -> DataFrame:
    return changes.session_statuses(*_statuses(v))["sessions"].withColumn("last_error", F.length("last_error").cast("long"))


def subscription_steps(v: Views) -> DataFrame:
    return changes.session_statuses(*_statuses(v))["subscriptions"]


REPORTS = """reports AS (SELECT user_id * 10 + event_id % 3 AS session_id, user_id AS station_id, event_id % 4 AS generation, coalesce(map {'view': 'streaming', 'click': 'reconnecting', 'error': 'failed'}[event_type], 'connecting') AS status,
 ts, CASE WHEN event_type = 'error' THEN substr(repeat(props, 60), 1, 300) END AS last_error FROM events)"""


def refreshed_analyses(v: Views) -> DataFrame:
    """Orders are analyses; those of odd numbers, and some of no mention, have a new result."""
    old = v.table("orders").select(F.col("o_orderkey").alias("mention_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("result"), F.col("o_orderdate").alias("created_at"))
    new = v.table("orders").filter("o_orderkey % 2 = 1 OR o_orderkey % 10 = 0").select(F.when(F.col("o_orderkey") % 10 == 0, F.when(F.col("o_orderkey") % 20 == 0, -1 - F.col("o_orderkey"))).otherwise(F.col("o_orderkey")).alias("mention_id"), F.lit("ready").alias("status"), (-F.col("o_totalprice")).alias("result"), F.lit("2030-01-01").cast("timestamp_ntz").alias("created_at"))
    return changes.refreshed_analyses(old, new)["analyses"]


def stored_transcripts(v: Views) -> DataFrame:
    """Lines are results of segments in two passes, brought by messages; those of low numbers are stored already."""
    rows = v.table("lineitem").select(F.col("l_orderkey").alias("segment_id"), F.when(F.col("l_linenumber") % 2 == 0, "b").otherwise("a").alias("pass"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("message_id"))
    old = rows.filter("message_id % 10 <= 2").dropDuplicates(["segment_id", "pass"]).select("segment_id", "pass")
    inbox = rows.filter("message_id % 10 <= 2").select("message_id", F.lit("old").alias("reference"))
    after = changes.stored_transcripts(old, inbox, rows.filter("message_id % 10 >= 2"))
    parts = after["transcripts"].groupBy("segment_id").agg(F.count("*").alias("n_transcripts"))
    return after["inbox"].groupBy(F.floor(F.col("message_id") / 10).alias("segment_id")).agg(F.count("*").alias("n_messages"), F.max("reference").alias("last_reference")).join(parts, "segment_id")


def inserted_segments(v: Views) -> DataFrame:
    """Segments by session and sequence: a repeated one adds nothing."""
    rows = v.spread("lineitem", v.table("lineitem").select(F.col("l_suppkey").alias("session"), F.col("l_partkey").alias("sequence")), "session", "sequence")
    old = rows.filter("sequence % 2 = 0").dropDuplicates(["session", "sequence"])
    return tables.inserted(old, rows, ["session", "sequence"]).groupBy("session").agg(F.count("*").alias("n"), F.sum("sequence").alias("sequences"))


def replaced_bindings(v: Views) -> DataFrame:
    """Bindings of stations that were planned again are replaced as a whole."""
    rows = v.table("lineitem").select(F.col("l_suppkey").alias("station_id"), F.col("l_orderkey").alias("campaign_id")).distinct()
    new = rows.filter("station_id % 4 = 0 AND campaign_id % 2 = 0")
    return tables.children_replaced(rows, new, "station_id").groupBy("station_id").agg(F.count("*").alias("n"), F.max("campaign_id").alias("last_campaign"))


def finished_jobs(v: Views) -> DataFrame:
    """Orders are jobs: O runs, F is done; outcomes come for every third."""
    jobs = v.table("orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("timestamp_ntz").alias("finished_at"))
    outcomes = v.table("orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 2 == 0, "failed").otherwise("done").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.repeat(F.lit("error "), 100)).alias("error"), F.col("o_orderdate").alias("finished_at"))
    return changes.finished_jobs(jobs, outcomes).withColumn("error", F.length("error").cast("long"))


def recent_jobs(v: Views) -> DataFrame:
    return changes.recent_jobs(v.table("orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at")))


def failure_log(v: Views) -> DataFrame:
    failed = v.table("events").filter("event_type = 'error'").select(F.col("event_id").cast("string").alias("reference"), F.col("props").alias("error"), F.col("ts").alias("at"))
    return changes.failures(failed, "result_writer", "publish_failed", True)


def known_mentions(v: Views) -> DataFrame:
    lines = v.table("lineitem").select(F.col("l_partkey").alias("keyword_id"), F.col("l_suppkey").alias("transcript_key"), "l_returnflag").distinct()
    return changes.known_mentions(lines.filter("l_returnflag = 'A'").drop("l_returnflag"), lines.filter("l_returnflag = 'R'").drop("l_returnflag"))


def job_contexts(v: Views) -> DataFrame:
    """Orders are jobs of a conversation at a station that may be unknown; their lines' return flags are content types."""
    jobs = v.table("orders").select(F.col("o_orderkey").alias("conversation_id"), (F.col("o_custkey") % 200).alias("station_id"))
    stations = v.table("supplier").select(F.col("s_suppkey").alias("station_id"), F.col("s_name").alias("name"))
    kinds = v.table("lineitem").select(F.col("l_orderkey").alias("conversation_id"), F.col("l_returnflag").alias("content_type"))
    return changes.contexts(jobs, stations, kinds)


def semantic_ids(v: Views) -> DataFrame:
    rows = v.table("lineitem").join(v.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), changes.semantic_id(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.upper("p_name")).alias("id"))


def source_mention_ids(v: Views) -> DataFrame:
    """The source's own id where it gives one, else a hash of the fields."""
    given = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" m"), F.col("event_id").cast("string"))).when(F.col("event_id") % 3 == 1, " ")
    return v.table("events").select("event_id", ingest.mention_ids(given, F.col("user_id"), F.col("event_type"), F.col("props")).alias("id"))


def capacity_snapshot(v: Views) -> DataFrame:
    sessions, subscriptions, reports = _statuses(v)
    after = changes.session_statuses(sessions, subscriptions, reports)
    jobs = v.table("orders").select(F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"))
    return changes.capacity(after["subscriptions"], _stations(v), after["sessions"], jobs, 80)


def object_stations(v: Views) -> DataFrame:
    """Stations that have stored objects: the first part of the keys after the prefix."""
    keys = v.table("events").select(F.concat(F.when(F.col("event_id") % 5 == 0, "other/").otherwise("raw/"), F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("s"), F.col("user_id").cast("string"))), F.lit("/"), F.col("event_id").cast("string")).alias("key"))
    return objects.station_ids(keys, "raw/")


def mention_documents(v: Views) -> DataFrame:
    """Keys and hashes of the documents that orders as mentions are published in; their lines are segments."""
    lines = v.spread("lineitem", v.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_orderkey")
    lines = lines.groupBy(F.col("l_orderkey").alias("mention_id")).agg(F.array_sort(F.collect_set(F.struct(F.col("l_linenumber").cast("string").alias("segment_id"), F.col("l_shipdate").cast("string").alias("text")))).alias("segments"))
    rows = v.table("orders").select(F.col("o_orderkey").alias("mention_id"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("conversation_id"), F.col("o_custkey").cast("string").alias("station_id"), F.lit(None).cast("string").alias("station_name"), F.col("o_orderstatus").alias("content_type"), F.lit("en").alias("detected_language"), F.col("o_orderdate").alias("started_at"), (F.col("o_orderdate") + F.expr("INTERVAL 90 SECONDS")).alias("ended_at"), F.lit("silence").alias("close_reason"), F.array("o_custkey").alias("campaign_ids"), F.array(F.lit("k")).alias("keyword_ids"), F.lit(None).cast("string").alias("evidence_key"), F.col("o_orderpriority").alias("text"), F.array().cast("array<bigint>").alias("missing"), F.array().cast("array<struct<keyword_id:string>>").alias("matches"), F.lit('{"status":"ready"}').alias("analysis"))
    documents = v.spread("lineitem", objects.mention_documents(rows.join(lines, "mention_id", "left")), "key")
    return objects.keyed(documents).select("key", F.sha2("body", 256).alias("body_sha256"), F.length("body").cast("long").alias("size"))


DOCUMENTS_SQL = """
WITH lines AS (SELECT l_orderkey AS k, to_json(list(DISTINCT {'segment_id': CAST(l_linenumber AS VARCHAR), 'text': strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')} ORDER BY {'segment_id': CAST(l_linenumber AS VARCHAR), 'text': strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')})) AS segments FROM lineitem GROUP BY l_orderkey),
rows AS (SELECT *, 'mentions/' || strftime(o_orderdate, '%Y/%m/%d') || '/' || o_orderkey || '/' AS base, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS a, strftime(o_orderdate + INTERVAL 90 SECONDS, '%Y-%m-%dT%H:%M:%S.%fZ') AS b FROM orders LEFT JOIN lines ON k = o_orderkey),
docs AS (SELECT base || 'analysis.json' AS key, '{"status":"ready"}' AS body FROM rows
UNION ALL SELECT base || 'metadata.json', '{"broadcast_end_utc":"' || b || '","broadcast_start_utc":"' || a || '","campaign_ids":[' || o_custkey || '],"close_reason":"silence","content_type":"' || o_orderstatus || '","conversation_id":"c' || o_orderkey || '","detected_language":"en","duration_ms":90000,"evidence_storage_key":null,"keyword_ids":["k"],"mention_id":' || o_orderkey || ',"schema":"radio.mention.v1","station_id":"' || o_custkey || '","station_name":null}' FROM rows
UNION ALL SELECT base || 'transcript.json', '{"conversation_id":"c' || o_orderkey || '","detected_language":"en","ended_at_utc":"' || b || '","matches":[],"missing_sequences":[],"schema":"radio.transcript.v1","segments":' || coalesce(segments, 'null') || ',"started_at_utc":"' || a || '","station_id":"' || o_custkey || '","text":"' || o_orderpriority || '"}' FROM rows)
SELECT key, sha256(body) AS body_sha256, length(body) AS size FROM docs"""


def audit_keys(v: Views) -> DataFrame:
    scans = v.table("lineitem").select(F.col("l_partkey").alias("keyword_id"), F.concat(F.lit("g/"), F.col("l_orderkey").cast("string")).alias("group_key"), F.col("l_suppkey").alias("station_id"), F.col("l_shipdate").alias("scanned_at")).distinct()
    return objects.audit_documents(scans).groupBy("key").agg(F.count("*").alias("n"))


def chosen_evidence(v: Views) -> DataFrame:
    """Lines are transcripts of orders as conversations; parts are segments of some seconds. Of every fifth order the
    transcripts were never stamped, so its mention knows its own transcript only."""
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    transcripts = v.table("lineitem").select(line.alias("transcript_id"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_orderkey")).alias("conversation_id"), F.col("l_partkey").alias("segment_id"))
    segments = v.table("part").select(F.col("p_partkey").alias("segment_id"), F.col("p_retailprice").alias("started_at"), F.col("p_size").alias("duration_ms"), F.when(F.col("p_partkey") % 3 == 0, "deleted").alias("disposition"))
    mentions = v.table("orders").select(F.col("o_orderkey").alias("mention_id"), F.col("o_orderkey").alias("conversation_id"), (F.col("o_orderkey") * 10 + 1).alias("transcript_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey") % 60).alias("span_ms"))
    got = media.evidence(mentions, transcripts, segments)
    return got.select("mention_id", "basis", F.array_join("segment_ids", ",").alias("segments"))


EVIDENCE_SQL = """
WITH t AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS tid, l_orderkey AS k, l_partkey AS sid, p_retailprice AS t0, p_size AS ms FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 3 <> 0),
whole AS (SELECT k, string_agg(sid, ',' ORDER BY t0, sid) AS ids FROM (SELECT DISTINCT k, sid, t0 FROM t WHERE k % 5 <> 0) GROUP BY k),
own AS (SELECT tid, arg_min(sid, (t0, sid)) AS sid, arg_min(ms, (t0, sid)) AS ms FROM t GROUP BY tid),
m AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 0 AND o_custkey % 60 > 0 THEN o_custkey % 60 END AS span FROM orders)
SELECT m.k AS mention_id, CASE WHEN ids IS NOT NULL THEN 'conversation' WHEN sid IS NULL THEN 'missing' WHEN span IS NULL OR ms >= 0.9 * span THEN 'transcript' ELSE 'partial' END AS basis,
coalesce(ids, CASE WHEN span IS NULL OR ms >= 0.9 * span THEN CAST(sid AS VARCHAR) END, '') AS segments FROM m LEFT JOIN whole USING (k) LEFT JOIN own ON tid = m.k * 10 + 1"""

QUERIES = {
    "chosen_evidence": (chosen_evidence, EVIDENCE_SQL),
    "created_campaigns": (created_campaigns, f"WITH {CREATED} SELECT * FROM olds UNION ALL SELECT campaign_id, name, 'active', TIMESTAMP '2024-01-01' FROM news"),
    "created_children": (created_children, f"""WITH {CREATED}, bound AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS campaign_id, l_suppkey AS station_id FROM lineitem UNION ALL SELECT DISTINCT campaign_id, unnest([c_custkey % 10, c_custkey % 5]) FROM news)
SELECT campaign_id, count(*) AS n_stations, min(station_id) AS first_station, CASE WHEN max(n.name) IS NOT NULL THEN 2 END AS n_keywords, max(n.c_mktsegment) || ' 1' AS first_value, CASE WHEN max(n.name) IS NOT NULL THEN 2 END AS n_ids, (SELECT CAST(max(n_nationkey) + 1 AS BIGINT) FROM nation) AS revision FROM bound LEFT JOIN news n USING (campaign_id) GROUP BY campaign_id"""),
    "updated_campaigns": (updated_campaigns, UPDATED_SQL),
    "deleted_campaigns": (deleted_campaigns, """WITH kept AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')
SELECT 'campaigns' AS table_name, count(*) AS n, count(*) AS campaigns FROM kept UNION ALL SELECT 'campaign_stations', count(*), count(DISTINCT k) FROM (SELECT DISTINCT l_orderkey AS k, l_suppkey FROM lineitem WHERE l_orderkey IN (FROM kept)) UNION ALL SELECT 'campaign_keywords', count(*), count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey IN (FROM kept)"""),
    "session_states": (session_states, f"""WITH {REPORTS}, latest AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, session_id DESC) = 1),
olds AS (SELECT s_suppkey * 10 AS session_id, s_suppkey AS station_id, TIMESTAMP '2020-01-01' AS started_at FROM supplier)
SELECT coalesce(o.session_id, l.session_id) AS session_id, coalesce(o.station_id, l.station_id) AS station_id, coalesce(generation, 0) AS generation, coalesce(status, 'connecting') AS status, ts AS last_audio_at, length(last_error) AS last_error, coalesce(started_at, ts) AS started_at FROM olds o FULL JOIN latest l ON o.session_id = l.session_id"""),
    "subscription_steps": (subscription_steps, f"""WITH {REPORTS}, said AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY ts DESC, session_id DESC) = 1),
olds AS (SELECT s_suppkey AS station_id, ['starting', 'active', 'degraded', 'pending_capacity', 'stopped'][s_suppkey % 5 + 1] AS state FROM supplier)
SELECT station_id, CASE WHEN status = 'streaming' AND state IN ('starting', 'degraded', 'pending_capacity') THEN 'active' WHEN status IN ('reconnecting', 'failed') AND state IN ('starting', 'active') THEN 'degraded' ELSE state END AS state,
CASE WHEN status = 'streaming' AND state IN ('starting', 'degraded', 'pending_capacity') THEN NULL WHEN status IN ('reconnecting', 'failed') AND state IN ('starting', 'active') THEN coalesce(last_error, status) ELSE 'old' END AS state_reason FROM olds LEFT JOIN said USING (station_id)"""),
    "refreshed_analyses": (refreshed_analyses, "SELECT o_orderkey AS mention_id, CASE WHEN o_orderkey % 2 = 1 THEN 'ready' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 2 = 1 THEN -o_totalprice ELSE o_totalprice END AS result, o_orderdate AS created_at FROM orders"),
    "stored_transcripts": (stored_transcripts, """WITH rows AS (SELECT l_orderkey AS segment_id, CASE WHEN l_linenumber % 2 = 0 THEN 'b' ELSE 'a' END AS pass, l_orderkey * 10 + l_linenumber AS message_id FROM lineitem)
SELECT segment_id, n_messages, last_reference, n_transcripts FROM (SELECT CAST(floor(message_id / 10) AS BIGINT) AS segment_id, count(DISTINCT message_id) FILTER (message_id % 10 > 2) + count(*) FILTER (message_id % 10 <= 2) AS n_messages, max(CASE WHEN message_id % 10 <= 2 THEN 'old' ELSE segment_id || ':' || pass END) AS last_reference FROM rows GROUP BY 1) JOIN (SELECT segment_id, count(DISTINCT pass) AS n_transcripts FROM rows GROUP BY 1) USING (segment_id)"""),
    "inserted_segments": (inserted_segments, "SELECT l_suppkey AS session, count(DISTINCT l_partkey) AS n, CAST(sum(DISTINCT l_partkey) AS BIGINT) AS sequences FROM lineitem GROUP BY l_suppkey"),
    "replaced_bindings": (replaced_bindings, "SELECT l_suppkey AS station_id, count(DISTINCT l_orderkey) AS n, max(l_orderkey) AS last_campaign FROM lineitem l WHERE l_suppkey % 4 <> 0 OR l_orderkey % 2 = 0 OR l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey % 2 = 0) GROUP BY l_suppkey"),
    "finished_jobs": (finished_jobs, "SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'done' END WHEN o_orderstatus = 'O' THEN 'running' ELSE 'done' END AS status, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 6 = 0 THEN 500 END AS error, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN o_orderdate END AS finished_at FROM orders"),
    "recent_jobs": (recent_jobs, "SELECT o_orderkey AS job_id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50"),
    "failure_log": (failure_log, "SELECT 'result_writer' AS component, 'publish_failed' AS error_code, true AS retryable, CAST(event_id AS VARCHAR) AS reference, substr(props, 1, 2000) AS detail, ts AS created_at FROM events WHERE event_type = 'error'"),
    "known_mentions": (known_mentions, "SELECT l_partkey AS keyword_id, l_suppkey AS transcript_key FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'"),
    "job_contexts": (job_contexts, """WITH kinds AS (SELECT l_orderkey AS k, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY ALL), best AS (SELECT k, f FROM kinds QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, f) = 1)
SELECT o_orderkey AS conversation_id, o_custkey % 200 AS station_id, coalesce(s_name, CAST(o_custkey % 200 AS VARCHAR)) AS station_name, coalesce(f, 'unknown') AS content_type FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey % 200 LEFT JOIN best ON k = o_orderkey"""),
    "semantic_ids": (semantic_ids, "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, substr(sha256(l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || lower(p_name)), 1, 32) AS id FROM lineitem JOIN part ON p_partkey = l_partkey"),
    "source_mention_ids": (source_mention_ids, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'm' || event_id ELSE substr(sha256(user_id || '|' || event_type || '|' || coalesce(props, '')), 1, 32) END AS id FROM events"),
    "capacity_snapshot": (capacity_snapshot, f"""WITH {REPORTS}, said AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY ts DESC, session_id DESC) = 1),
latest AS (SELECT session_id, arg_max(station_id, ts) AS station_id, arg_max(status, ts) AS status FROM reports GROUP BY session_id),
subs AS (SELECT CASE WHEN status = 'streaming' AND s_suppkey % 5 IN (0, 2, 3) THEN 'active' WHEN status IN ('reconnecting', 'failed') AND s_suppkey % 5 IN (0, 1) THEN 'degraded' ELSE ['starting', 'active', 'degraded', 'pending_capacity', 'stopped'][s_suppkey % 5 + 1] END AS state FROM supplier LEFT JOIN said ON station_id = s_suppkey),
wanted AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_suppkey), w AS (SELECT count(*) AS requested_stations, count(*) FILTER (n > 1) AS shared_stations, CAST(sum(n) AS BIGINT) AS bindings FROM wanted),
s AS (SELECT count(*) FILTER (state IN ('starting', 'active', 'degraded')) AS admitted_stations, count(*) FILTER (state = 'pending_capacity') AS waiting_stations FROM subs)
SELECT w.*, s.*, (SELECT count(DISTINCT station_id) FROM latest WHERE status = 'streaming') AS streaming_stations, (SELECT count(*) FROM orders WHERE o_orderstatus IN ('O', 'P')) AS open_jobs, CAST(greatest(80 - admitted_stations, 0) AS BIGINT) AS free_slots, admitted_stations < 80 AS can_add FROM w, s"""),
    "object_stations": (object_stations, "SELECT DISTINCT 's' || user_id AS station_id FROM events WHERE event_id % 5 <> 0 AND event_id % 11 <> 0"),
    "mention_documents": (mention_documents, DOCUMENTS_SQL),
    "audit_keys": (audit_keys, "SELECT 'semantic/' || l_suppkey || '/' || strftime(l_shipdate, '%Y/%m/%d') || '/' || substr(sha256(l_partkey || '|g/' || l_orderkey), 1, 20) || '.semantic.json' AS key, count(DISTINCT l_shipdate) AS n FROM lineitem GROUP BY 1"),
}
