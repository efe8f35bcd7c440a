"""Queues and jobs as tables: claims, rounds of sends, lease sweeps, retention, worker and capacity summaries, and the
writes of a closed conversation. Each change returns the table's next state or the rows to add.

Nulls: a row without the time that a rule compares isn't due, isn't stale and isn't deleted; null keys match nothing.
Running a change again on its own result changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds to wait after each failed attempt, and the limits of leases and retries.
BACKOFF = (2, 5, 15, 30, 60, 120, 300, 600, 900, 1800)
MOST_SENDS, MOST_ATTEMPTS, LEASE_S, ORPHAN_H, STALE_H = 10, 5, 120, 96, 6
DAYS_KEPT = 7


def later(at: Column, s: Column) -> Column:
    return at + F.make_dt_interval(secs=s.cast("decimal(18,6)"))


def backoff(attempts: Column, share: Column | None = None) -> Column:
    """Seconds until the next try; ``share`` (a random number, say) spreads them over the whole wait."""
    wait = F.element_at(F.array(*map(F.lit, BACKOFF)), F.least(F.coalesce(attempts, F.lit(0)), F.lit(len(BACKOFF) - 1)).cast("int") + 1)
    return wait.cast("double") * (share if share is not None else F.lit(1.0))


def due(events: DataFrame, now: Column, most: int = 25) -> DataFrame:
    """The next batch to send: pending and due, the longest available first."""
    return events.filter((F.col("status") == "pending") & (F.col("available_at") <= now)).orderBy("available_at", "created_at", "event_id").limit(most)


def claimed(events: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Events after a batch was claimed: sending, with a lease."""
    own = batch.select("event_id", F.lit(True).alias("mine"))
    both = events.join(own, "event_id", "left")
    return both.withColumns({"status": F.when(F.col("mine"), "sending").otherwise(F.col("status")), "lease_until": F.when(F.col("mine"), later(now, F.lit(LEASE_S))).otherwise(F.col("lease_until"))}).drop("mine")


def after_sends(events: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Events after a round of sends. outcomes: event_id, outcome (sent, retry, release or refused): a retry waits and
    counts, and fails at the tenth; a release waits and doesn't count; a refused one fails at once."""
    both = events.join(outcomes, "event_id", "left")
    o, n = F.col("outcome"), F.col("attempts")
    spent = (o == "refused") | ((o == "retry") & (n + 1 >= MOST_SENDS))
    waits = o.isin("retry", "release") & ~spent
    return both.withColumns({
        "status": F.when(o == "sent", "sent").when(spent, "failed").when(waits, "pending").otherwise(F.col("status")),
        "available_at": F.when(waits, later(now, backoff(F.when(o == "release", 0).otherwise(n)))).otherwise(F.col("available_at")),
        "lease_until": F.when(o.isNull(), F.col("lease_until")),
        "attempts": F.when(o == "retry", n + 1).otherwise(n),
    }).drop("outcome")


def reclaimed(events: DataFrame, now: Column) -> DataFrame:
    """Sending events whose lease ran out are pending again."""
    lost = F.coalesce((F.col("status") == "sending") & (F.col("lease_until") <= now), F.lit(False))
    return events.withColumns({"status": F.when(lost, "pending").otherwise(F.col("status")), "lease_until": F.when(~lost, F.col("lease_until"))})


def swept(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs after the sweep: running ones past their lease are pending again, or abandoned once their attempts are spent;
    pending ones older than the queue keeps messages are abandoned. jobs: status, lease_until, attempts, created_at."""
    lost = F.coalesce((F.col("status") == "running") & (F.col("lease_until") <= now), F.lit(False))
    spent = lost & (F.col("attempts") >= MOST_ATTEMPTS)
    orphan = F.coalesce((F.col("status") == "pending") & (F.col("created_at") <= later(now, F.lit(-ORPHAN_H * 3600))), F.lit(False))
    code = F.when(spent, "lease_exhausted").when(orphan, "message_retention_expired").otherwise(F.col("error_code"))
    return jobs.withColumns({"error_code": code, "status": F.when(spent | orphan, "abandoned").when(lost, "pending").otherwise(F.col("status")), "lease_until": F.when(~lost, F.col("lease_until"))})


def released(segments: DataFrame, jobs: DataFrame) -> DataFrame:
    """Segments of orphaned jobs may go, unless they are kept as evidence or gone."""
    orphans = jobs.filter("status = 'abandoned' AND error_code = 'message_retention_expired'").select("segment_id").distinct().withColumn("orphan", F.lit(True))
    both = segments.join(orphans, "segment_id", "left")
    free = F.col("orphan") & ~F.col("disposition").isin("retained", "deleted")
    return both.withColumn("disposition", F.when(free, "disposable").otherwise(F.col("disposition"))).drop("orphan")


def fresh_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs with whether they are too old to be worth the work: those are acknowledged and left."""
    return jobs.withColumn("stale", F.coalesce(F.col("created_at") < later(now, F.lit(-STALE_H * 3600)), F.lit(False)))


def next_job(jobs: DataFrame) -> DataFrame:
    """The job to start: the oldest pending one, and none while another runs."""
    busy = jobs.filter("status = 'running'").limit(1).select(F.lit(True).alias("busy"))
    first = jobs.filter("status = 'pending'").orderBy("created_at", "job_id").limit(1)
    return first.join(busy, F.lit(True), "left_anti").select("job_id", "action", (F.col("attempts") + 1).alias("attempts"))  # one row on either side


def pruned(rows: DataFrame, done: Column, at: str, now: Column, days: int = DAYS_KEPT) -> DataFrame:
    """Rows that stay: those not done, and those done within the last days."""
    gone = F.coalesce(done & (F.col(at) < later(now, F.lit(-days * 86_400))), F.lit(False))
    return rows.filter(~gone)


def pressure(used: Column) -> Column:
    """The band of a share of disk in percent."""
    return F.when(used >= 90, "emergency").when(used >= 85, "pause").when(used >= 70, "warning").otherwise("normal")


def roles(beats: DataFrame, now: Column, stale_s: int = 120) -> DataFrame:
    """Workers of each role: total, live, stale, and the newest one's detail. beats: worker_id, role, status, seen_at, detail."""
    live = (F.col("status") != "stopped") & (F.col("seen_at") >= later(now, F.lit(-stale_s)))
    n = beats.groupBy("role").agg(F.count("*").alias("total"), F.count(F.when(live, 1)).alias("live"), F.count(F.when((F.col("status") != "stopped") & ~live, 1)).alias("stale"), F.max_by("detail", F.struct("seen_at", "worker_id")).alias("newest_detail"))
    return n.withColumn("state", F.when(F.col("live") == 0, "down").when(F.col("stale") > 0, "degraded").otherwise("ok"))


def ready(role_rows: DataFrame, band: Column) -> DataFrame:
    """One row: whether every role is up and the disk isn't full."""
    return role_rows.agg(F.coalesce(F.bool_and(F.col("state") != "down"), F.lit(False)).alias("roles_up"), band.alias("pressure")).withColumn("ready", F.col("roles_up") & (F.col("pressure") != "emergency"))


def backlog(*tables: DataFrame) -> DataFrame:
    """One row over several tables of (status, at): pending rows, the oldest one's time, running rows, the oldest one's."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    of = lambda s: F.when(F.col("status") == s, F.col("at"))
    return rows.agg(F.count(of("pending")).alias("n_pending"), F.min(of("pending")).alias("oldest_pending"), F.count(of("running")).alias("n_running"), F.min(of("running")).alias("oldest_running"))


def waiting(subscriptions: DataFrame, planned: DataFrame, running: DataFrame) -> DataFrame:
    """Planned stations that aren't running wait for capacity."""
    idle = planned.select("station_id").distinct().join(running.select("station_id").distinct(), "station_id", "left_anti").withColumn("idle", F.lit(True))
    both = subscriptions.join(idle, "station_id", "left")
    return both.withColumn("state", F.when(F.col("idle") & F.col("state").isin("starting", "active"), "pending_capacity").otherwise(F.col("state"))).drop("idle")


def assigned(subscriptions: DataFrame, shard: int, states: tuple[str, ...]) -> DataFrame:
    return subscriptions.filter((F.col("shard") == shard) & F.col("state").isin(*states)).orderBy("station_id")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key, without a sort of the keys' rows."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("b")).select(key, "b.*")


def turns(sessions: DataFrame, waiting_stations: DataFrame, now: Column, slots: int, slice_s: int = 120, dwell_s: int = 240, grace_s: int = 30, ceiling_s: int = 480) -> DataFrame:
    """What each station does next: ``keep``, ``evict``, ``admit`` or ``wait``. A turn ends after its slice, but not while a
    keyword was heard within the dwell or talk within the grace, and never lasts beyond the ceiling. Turns are only ended
    for stations that wait, the oldest first; those that never had one go first, then those that wait longest.
    sessions: station_id, started_at, hit_at, talk_at; waiting_stations: station_id, served_at."""
    age = lambda c: F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    hit = F.coalesce((F.col("hit_at") >= F.col("started_at")) & (age("hit_at") < dwell_s), F.lit(False))
    talk = F.coalesce(age("talk_at") < grace_s, F.lit(False))
    over = (age("started_at") >= ceiling_s) | ((age("started_at") >= slice_s) & ~hit & ~talk)
    held = sessions.withColumn("over", over)
    counts = held.agg(F.count("*").alias("n"), F.count(F.when(F.col("over"), 1)).alias("n_over")).join(waiting_stations.agg(F.count("*").alias("n_wait")))  # single rows
    free = F.greatest(F.lit(slots) - F.col("n"), F.lit(0))
    room = F.least(F.greatest(F.col("n_wait") - free, F.lit(0)), F.col("n_over"))
    ranked = held.withColumn("place", F.row_number().over(Window.orderBy(F.desc("over"), "started_at", "station_id"))).join(F.broadcast(counts))  # a row a slot
    kept = ranked.select("station_id", F.when(F.col("over") & (F.col("place") <= room), "evict").otherwise("keep").alias("turn"))
    queue = waiting_stations.withColumn("place", F.row_number().over(Window.orderBy(F.col("served_at").asc_nulls_first(), "station_id"))).join(F.broadcast(counts))
    return kept.unionByName(queue.select("station_id", F.when(F.col("place") <= free + room, "admit").otherwise("wait").alias("turn")))


def committed(transcripts: DataFrame, conversations: DataFrame) -> DataFrame:
    """Transcripts with the conversation that holds their segment; one that has a conversation keeps it. conversations:
    conversation_id, segment_ids."""
    members = conversations.select("conversation_id", F.explode("segment_ids").alias("segment_id")).groupBy("segment_id").agg(F.min("conversation_id").alias("new"))
    return transcripts.join(members, "segment_id", "left").withColumn("conversation_id", F.coalesce("conversation_id", "new")).drop("new")


def persisted(conversations: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mentions, campaign rows and keyword rows to add for closed conversations that no stored mention has: one mention a
    conversation, a row for each campaign with the policy's verdict, a row for each match. conversations: conversation_id,
    flag, matches (keyword_id, campaign_ids, level); stored: conversation_id."""
    new = conversations.dropDuplicates(["conversation_id"]).join(stored.select("conversation_id").distinct(), "conversation_id", "left_anti")
    each = new.select("conversation_id", "flag", F.posexplode("matches").alias("ordinal", "m")).select("conversation_id", "flag", "ordinal", "m.*")
    mentions = each.groupBy("conversation_id").agg(F.count("*").alias("n_matches"))
    campaigns = each.select("conversation_id", "flag", F.explode("campaign_ids").alias("campaign_id")).distinct()
    confirmed = ~F.col("level").isin("fuzzy", "phonetic", "semantic")
    return mentions, campaigns, each.select("conversation_id", "keyword_id", "ordinal", F.get("campaign_ids", 0).alias("campaign_id"), confirmed.alias("confirmed"))
