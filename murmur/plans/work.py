"""Queries of queues, jobs and retention: orders are events and jobs, suppliers workers and stations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators import tables, work
from murmur.sources.views import Views

NOW = "1999-06-15 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _events(v: Views) -> DataFrame:
    n = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("pending", "sending", "sent", "failed"))), (n % 4 + 1).cast("int"))
    lease = F.when(n % 4 == 1, F.col("o_orderdate") + F.expr("INTERVAL 2 HOURS"))
    return v.table("orders").select(n.alias("event_id"), status.alias("status"), (n % 11).alias("attempts"), F.col("o_orderdate").alias("available_at"), (F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")).alias("created_at"), lease.alias("lease_until"))


EVENTS = """events_out AS (SELECT o_orderkey AS event_id, ['pending', 'sending', 'sent', 'failed'][o_orderkey % 4 + 1] AS status, o_orderkey % 11 AS attempts, o_orderdate AS available_at,
 o_orderdate - INTERVAL 1 DAY AS created_at, CASE WHEN o_orderkey % 4 = 1 THEN o_orderdate + INTERVAL 2 HOURS END AS lease_until FROM orders)"""


def claimed_batch(v: Views) -> DataFrame:
    events = _events(v)
    return work.claimed(events, work.due(events, _now()), _now())


def after_sends(v: Views) -> DataFrame:
    events = _events(v)
    what = F.element_at(F.array(*map(F.lit, ("sent", "retry", "release", "refused"))), (F.col("event_id") % 5).cast("int"))
    return work.after_sends(events, events.filter("event_id % 5 BETWEEN 1 AND 4").select("event_id", what.alias("outcome")), _now())


AFTER_SQL = f"""
WITH {EVENTS}, told AS (SELECT *, CASE WHEN event_id % 5 BETWEEN 1 AND 4 THEN ['sent', 'retry', 'release', 'refused'][event_id % 5] END AS o FROM events_out),
judged AS (SELECT *, o = 'refused' OR (o = 'retry' AND attempts + 1 >= 10) AS spent, [2, 5, 15, 30, 60, 120, 300, 600, 900, 1800][CASE WHEN o = 'release' THEN 1 ELSE least(attempts, 9) + 1 END] AS wait FROM told)
SELECT event_id, CASE WHEN o = 'sent' THEN 'sent' WHEN spent THEN 'failed' WHEN o IN ('retry', 'release') THEN 'pending' ELSE status END AS status, CASE WHEN o = 'retry' THEN attempts + 1 ELSE attempts END AS attempts,
 CASE WHEN o IN ('retry', 'release') AND NOT spent THEN TIMESTAMP '{NOW}' + to_seconds(wait) ELSE available_at END AS available_at, created_at, CASE WHEN o IS NULL THEN lease_until END AS lease_until FROM judged"""


def reclaimed_events(v: Views) -> DataFrame:
    return work.reclaimed(_events(v), _now())


def _jobs(v: Views) -> DataFrame:
    n = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("pending", "running", "succeeded"))), (n % 3 + 1).cast("int"))
    return v.table("orders").select(n.alias("segment_id"), status.alias("status"), (n % 7).alias("attempts"), F.when(n % 3 == 1, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("lease_until"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("string").alias("error_code"))


JOBS = """jobs AS (SELECT o_orderkey AS segment_id, ['pending', 'running', 'succeeded'][o_orderkey % 3 + 1] AS status, o_orderkey % 7 AS attempts, CASE WHEN o_orderkey % 3 = 1 THEN o_orderdate + INTERVAL 1 DAY END AS lease_until, o_orderdate AS created_at FROM orders),
swept AS (SELECT segment_id, attempts, created_at, CASE WHEN lost THEN NULL ELSE lease_until END AS lease_until, CASE WHEN spent OR orphan THEN 'abandoned' WHEN lost THEN 'pending' ELSE status END AS status,
 CASE WHEN spent THEN 'lease_exhausted' WHEN orphan THEN 'message_retention_expired' END AS error_code FROM (SELECT *, lost AND attempts >= 5 AS spent FROM (SELECT *, coalesce(status = 'running' AND lease_until <= TIMESTAMP '1999-06-15 12:00:00', false) AS lost,
 status = 'pending' AND created_at <= TIMESTAMP '1999-06-15 12:00:00' - INTERVAL 96 HOURS AS orphan FROM jobs)))"""


def swept_jobs(v: Views) -> DataFrame:
    return work.swept(_jobs(v), _now())


def released_segments(v: Views) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("pending", "retained", "deleted", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return work.released(v.table("events").select(F.col("event_id").alias("segment_id"), kinds.alias("disposition")), work.swept(_jobs(v), _now()))


def stale_jobs(v: Views) -> DataFrame:
    return work.fresh_jobs(_jobs(v).select("segment_id", "created_at"), _now()).groupBy("stale").agg(F.count("*").alias("n"))


def _station_jobs(v: Views, running: bool) -> DataFrame:
    status = F.when(F.lit(running) & (F.col("o_orderkey") == 5), "running").when(F.col("o_orderstatus") == "P", "pending").otherwise("done")
    return v.table("orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("action"), status.alias("status"), F.lit(0).alias("attempts"), F.col("o_orderdate").alias("created_at"))


def next_job(v: Views) -> DataFrame:
    """One free queue, and one in which a job runs, so that none may start."""
    return work.next_job(_station_jobs(v, False)).unionByName(work.next_job(_station_jobs(v, True)))


def kept_events(v: Views) -> DataFrame:
    return work.pruned(_events(v), F.col("status") == "sent", "available_at", _now()).groupBy("status").agg(F.count("*").alias("n"), F.min("available_at").alias("oldest"))


def _beats(v: Views) -> DataFrame:
    n = F.col("s_suppkey")
    role = F.element_at(F.array(*map(F.lit, ("listener", "transcription", "analysis", "cleanup"))), (n % 4 + 1).cast("int"))
    return v.table("supplier").select(n.alias("worker_id"), role.alias("role"), F.when(n % 9 == 0, "stopped").otherwise("running").alias("status"), (_now() - F.make_dt_interval(secs=(n * 7 % 200).cast("decimal(18,6)"))).alias("seen_at"), F.concat(F.lit("w"), n.cast("string")).alias("detail"))


BEATS = f"""beats AS (SELECT s_suppkey AS worker_id, ['listener', 'transcription', 'analysis', 'cleanup'][s_suppkey % 4 + 1] AS role, CASE WHEN s_suppkey % 9 = 0 THEN 'stopped' ELSE 'running' END AS status,
 TIMESTAMP '{NOW}' - to_seconds(s_suppkey * 7 % 200) AS seen_at, 'w' || s_suppkey AS detail FROM supplier),
roles AS (SELECT role, count(*) AS total, count(*) FILTER (status <> 'stopped' AND seen_at >= TIMESTAMP '{NOW}' - INTERVAL 120 SECONDS) AS live, count(*) FILTER (status <> 'stopped' AND seen_at < TIMESTAMP '{NOW}' - INTERVAL 120 SECONDS) AS stale,
 arg_max(detail, (seen_at, worker_id)) AS newest_detail FROM beats GROUP BY role)"""


def worker_roles(v: Views) -> DataFrame:
    return work.roles(_beats(v), _now())


def readiness(v: Views) -> DataFrame:
    return work.ready(work.roles(_beats(v), _now()), work.pressure(F.lit(87)))


def pressure_bands(v: Views) -> DataFrame:
    return v.table("part").groupBy(work.pressure(F.col("p_size") * 2).alias("band")).agg(F.count("*").alias("n"))


def work_backlog(v: Views) -> DataFrame:
    return work.backlog(_jobs(v).select("status", F.col("created_at").alias("at")), _events(v).select("status", F.col("available_at").alias("at")))


def waiting_subscriptions(v: Views) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, ("active", "stopped", "starting"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    rows = v.table("supplier").select(F.col("s_suppkey").alias("station_id"), state.alias("state"))
    return work.waiting(rows, rows.filter("station_id % 2 = 0"), rows.filter("station_id % 5 = 0"))


def assigned_stations(v: Views) -> DataFrame:
    rows = v.table("customer").select(F.col("c_custkey").alias("station_id"), (F.col("c_custkey") % 8).alias("shard"), F.col("c_mktsegment").alias("state"))
    return work.assigned(rows, 3, ("BUILDING", "MACHINERY"))


def latest_probes(v: Views) -> DataFrame:
    rows = v.table("orders").select(F.col("o_custkey").alias("station_id"), F.col("o_orderkey").alias("probe_id"), F.col("o_orderdate").alias("probed_at"), F.col("o_orderstatus").alias("outcome"))
    return work.latest(rows, "station_id", ["probed_at", "probe_id"])


def station_turns(v: Views) -> DataFrame:
    """Suppliers up to sixty have a turn, the others wait for one of seventy slots."""
    n = F.col("s_suppkey")
    ago = lambda s: _now() - F.make_dt_interval(secs=s.cast("decimal(18,6)"))
    rows = v.table("supplier")
    held = rows.filter("s_suppkey <= 60").select(n.alias("station_id"), ago(n * 13 % 600).alias("started_at"), F.when(n % 3 == 0, ago(n * 11 % 400)).alias("hit_at"), F.when(n % 4 == 0, ago(n % 60)).alias("talk_at"))
    queue = rows.filter("s_suppkey > 60").select(n.alias("station_id"), F.when(n % 3 != 0, ago(n * 17 % 900)).alias("served_at"))
    return work.turns(held, queue, _now(), 70)


TURNS_SQL = """
WITH held AS (SELECT s_suppkey AS n, s_suppkey * 13 % 600 AS age, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 11 % 400 END AS hit, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey % 60 END AS talk FROM supplier WHERE s_suppkey <= 60),
judged AS (SELECT *, age >= 480 OR (age >= 120 AND NOT coalesce(hit <= age AND hit < 240, false) AND NOT coalesce(talk < 30, false)) AS over FROM held),
queue AS (SELECT s_suppkey AS n, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey * 17 % 900 END AS served FROM supplier WHERE s_suppkey > 60),
counts AS (SELECT greatest(70 - (SELECT count(*) FROM held), 0) AS free, (SELECT count(*) FROM queue) AS n_wait, (SELECT count(*) FROM judged WHERE over) AS n_over),
room AS (SELECT free, least(greatest(n_wait - free, 0), n_over) AS room FROM counts)
SELECT n AS station_id, CASE WHEN over AND place <= room THEN 'evict' ELSE 'keep' END AS turn FROM (SELECT *, row_number() OVER (ORDER BY over DESC, age DESC, n) AS place FROM judged), room
UNION ALL SELECT n, CASE WHEN place <= free + room THEN 'admit' ELSE 'wait' END FROM (SELECT *, row_number() OVER (ORDER BY served DESC NULLS FIRST, n) AS place FROM queue), room"""


def _conversations(v: Views) -> DataFrame:
    """Orders are conversations of their lines: a line is a match of its part for the supplier's campaign."""
    match = F.struct("l_linenumber", F.col("l_partkey").alias("keyword_id"), F.array(F.col("l_suppkey"), F.col("l_suppkey") % 10).alias("campaign_ids"), F.when(F.col("l_returnflag") == "R", "fuzzy").otherwise("exact").alias("level"))
    rows = v.table("lineitem").groupBy(F.col("l_orderkey").alias("conversation_id")).agg(F.array_sort(F.collect_set(match)).alias("matches"), F.array_sort(F.collect_set("l_linenumber")).alias("numbers"))
    return rows.select("conversation_id", F.when(F.col("conversation_id") % 3 == 0, "news").alias("flag"), "matches", F.transform("numbers", lambda i: F.col("conversation_id") * 10 + i).alias("segment_ids"))


def persisted_keywords(v: Views) -> DataFrame:
    stored = v.table("orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("conversation_id"))
    return work.persisted(_conversations(v), stored)[2].withColumn("ordinal", F.col("ordinal").cast("long"))


def persisted_campaigns(v: Views) -> DataFrame:
    stored = v.table("orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("conversation_id"))
    mentions, campaigns, _ = work.persisted(_conversations(v), stored)
    return campaigns.groupBy("conversation_id").agg(F.count("*").alias("n_campaigns")).join(mentions, "conversation_id")


def committed_transcripts(v: Views) -> DataFrame:
    lines = v.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber") * 2).alias("segment_id"), F.when(F.col("l_partkey") % 50 == 0, F.lit(-1).cast("long")).alias("conversation_id")).groupBy("segment_id").agg(F.min("conversation_id").alias("conversation_id"))
    return work.committed(lines, _conversations(v))


def updated_stations(v: Views) -> DataFrame:
    old = v.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("long").alias("nation"))
    new = old.filter("id % 2 = 0").select("id", F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("balance"), F.when(F.col("id") % 4 == 0, F.array(F.lit("name"))).alias("untouched"))
    return tables.sparse(old, new, "id")


QUERIES = {
    "claimed_batch": (claimed_batch, f"""WITH {EVENTS}, batch AS (SELECT event_id FROM events_out WHERE status = 'pending' AND available_at <= TIMESTAMP '{NOW}' ORDER BY available_at, created_at, event_id LIMIT 25)
SELECT event_id, CASE WHEN event_id IN (FROM batch) THEN 'sending' ELSE status END AS status, attempts, available_at, created_at, CASE WHEN event_id IN (FROM batch) THEN TIMESTAMP '{NOW}' + INTERVAL 120 SECONDS ELSE lease_until END AS lease_until FROM events_out"""),
    "after_sends": (after_sends, AFTER_SQL),
    "reclaimed_events": (reclaimed_events, f"""WITH {EVENTS} SELECT event_id, CASE WHEN status = 'sending' AND lease_until <= TIMESTAMP '{NOW}' THEN 'pending' ELSE status END AS status, attempts, available_at, created_at,
CASE WHEN status = 'sending' AND lease_until <= TIMESTAMP '{NOW}' THEN NULL ELSE lease_until END AS lease_until FROM events_out"""),
    "swept_jobs": (swept_jobs, f"WITH {JOBS} SELECT segment_id, status, attempts, lease_until, created_at, error_code FROM swept"),
    "released_segments": (released_segments, f"""WITH {JOBS} SELECT event_id AS segment_id, CASE WHEN event_id % 4 IN (0, 3) AND event_id IN (SELECT segment_id FROM swept WHERE error_code = 'message_retention_expired') THEN 'disposable'
ELSE ['pending', 'retained', 'deleted', 'failed'][event_id % 4 + 1] END AS disposition FROM events"""),
    "stale_jobs": (stale_jobs, f"SELECT o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 6 HOURS AS stale, count(*) AS n FROM orders GROUP BY stale"),
    "next_job": (next_job, "SELECT o_orderkey AS job_id, o_orderpriority AS action, 1 AS attempts FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 1"),
    "kept_events": (kept_events, f"""WITH {EVENTS} SELECT status, count(*) AS n, min(available_at) AS oldest FROM events_out WHERE NOT (status = 'sent' AND available_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAYS) GROUP BY status"""),
    "worker_roles": (worker_roles, f"WITH {BEATS} SELECT *, CASE WHEN live = 0 THEN 'down' WHEN stale > 0 THEN 'degraded' ELSE 'ok' END AS state FROM roles"),
    "readiness": (readiness, f"WITH {BEATS} SELECT bool_and(live > 0) AS roles_up, 'pause' AS pressure, bool_and(live > 0) AS ready FROM roles"),
    "pressure_bands": (pressure_bands, "SELECT CASE WHEN p_size * 2 >= 90 THEN 'emergency' WHEN p_size * 2 >= 85 THEN 'pause' WHEN p_size * 2 >= 70 THEN 'warning' ELSE 'normal' END AS band, count(*) AS n FROM part GROUP BY band"),
    "work_backlog": (work_backlog, f"""WITH {EVENTS}, {JOBS}, every AS (SELECT status, created_at AS at_ FROM jobs UNION ALL SELECT status, available_at FROM events_out)
SELECT count(*) FILTER (status = 'pending') AS n_pending, min(at_) FILTER (status = 'pending') AS oldest_pending, count(*) FILTER (status = 'running') AS n_running, min(at_) FILTER (status = 'running') AS oldest_running FROM every"""),
    "waiting_subscriptions": (waiting_subscriptions, """SELECT s_suppkey AS station_id, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 1 THEN 'pending_capacity' ELSE ['active', 'stopped', 'starting'][s_suppkey % 3 + 1] END AS state FROM supplier"""),
    "assigned_stations": (assigned_stations, "SELECT c_custkey AS station_id, c_custkey % 8 AS shard, c_mktsegment AS state FROM customer WHERE c_custkey % 8 = 3 AND c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "latest_probes": (latest_probes, """SELECT o_custkey AS station_id, o_orderkey AS probe_id, o_orderdate AS probed_at, o_orderstatus AS outcome FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""),
    "station_turns": (station_turns, TURNS_SQL),
    "persisted_keywords": (persisted_keywords, """WITH m AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'fuzzy' ELSE 'exact' END AS level FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0))
SELECT l_orderkey AS conversation_id, l_partkey AS keyword_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, level) - 1 AS ordinal, l_suppkey AS campaign_id, level <> 'fuzzy' AS confirmed FROM m"""),
    "persisted_campaigns": (persisted_campaigns, """WITH m AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'R' AS f FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0))
SELECT a.l_orderkey AS conversation_id, n_campaigns, n_matches FROM (SELECT l_orderkey, count(DISTINCT c) AS n_campaigns FROM (SELECT l_orderkey, unnest([l_suppkey, l_suppkey % 10]) AS c FROM m) GROUP BY l_orderkey) a JOIN (SELECT l_orderkey, count(*) AS n_matches FROM m GROUP BY l_orderkey) b USING (l_orderkey)"""),
    "committed_transcripts": (committed_transcripts, """WITH t AS (SELECT l_orderkey * 10 + l_linenumber * 2 AS segment_id, min(CASE WHEN l_partkey % 50 = 0 THEN -1 END) AS own FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey * 10 + l_linenumber AS segment_id, min(l_orderkey) AS c FROM lineitem GROUP BY 1)
SELECT segment_id, coalesce(own, c) AS conversation_id FROM t LEFT JOIN s USING (segment_id)"""),
    "updated_stations": (updated_stations, """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 <> 0 THEN NULL ELSE s_name END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE s_acctbal END AS balance, CAST(s_nationkey AS BIGINT) AS nation FROM supplier"""),
}
