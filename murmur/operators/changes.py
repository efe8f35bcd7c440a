"""Changes of several stored tables at once: each function gives the next states by table name, which ``Versions.commit``
makes visible together. And the bookkeeping of jobs, probes and failures.

Nulls: a request without an id or name, a status without a session, an analysis without a mention change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from murmur.functions.text import entity_id, keys
from murmur.operators import ingest, tables

SESSION_STATES = ("connecting", "streaming", "reconnecting", "stopped", "failed")
KEYWORD_COLUMNS = ["keyword_id", "campaign_id", "entity_id", "value", "match_mode", "keyword_type", "enabled"]


def created_campaigns(campaigns: DataFrame, stations: DataFrame, keywords: DataFrame, meta: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """campaigns, campaign_stations, campaign_keywords and meta after requests: campaign_id, name, monitor_from,
    station_ids, keywords (array of value, match_mode, keyword_type). A campaign that exists stays, its children too."""
    asked = requests.filter(F.col("campaign_id").isNotNull() & (F.coalesce(F.trim("name"), F.lit("")) != "")).dropDuplicates(["campaign_id"])
    new = asked.join(campaigns.select("campaign_id"), "campaign_id", "left_anti")
    rows = new.select("campaign_id", "name", F.lit("active").alias("status"), "monitor_from")
    bound = new.select("campaign_id", F.explode(F.array_distinct("station_ids")).alias("station_id"))
    words = new.select("campaign_id", F.posexplode("keywords").alias("place", "k")).select(
        F.sha2(F.concat_ws("|", "campaign_id", "place"), 256).substr(1, 32).alias("keyword_id"), "campaign_id", entity_id(F.col("k.value")).alias("entity_id"),
        F.col("k.value").alias("value"), F.col("k.match_mode").alias("match_mode"), F.col("k.keyword_type").alias("keyword_type"), F.lit(True).alias("enabled"),
    )
    return {"campaigns": campaigns.unionByName(rows), "campaign_stations": stations.unionByName(bound), "campaign_keywords": keywords.select(KEYWORD_COLUMNS).unionByName(words), "meta": ingest.next_revision(meta)}


def updated_campaigns(campaigns: DataFrame, stations: DataFrame, updates: DataFrame) -> dict[str, DataFrame]:
    """campaigns and campaign_stations after partial updates: campaign_id, name, status (null: as it was), station_ids (null:
    as they were, empty: none)."""
    named = campaigns.join(updates.select("campaign_id", F.col("name").alias("new_name"), F.col("status").alias("new_status")), "campaign_id", "left")
    rows = named.withColumns({"name": F.coalesce("new_name", "name"), "status": F.coalesce("new_status", "status")}).select(campaigns.columns)
    given = updates.join(campaigns.select("campaign_id"), "campaign_id", "left_semi").filter("station_ids IS NOT NULL")
    kept = stations.join(given.select("campaign_id"), "campaign_id", "left_anti")
    return {"campaigns": rows, "campaign_stations": kept.unionByName(given.select("campaign_id", F.explode(F.array_distinct("station_ids")).alias("station_id")))}


def deleted_campaigns(campaigns: DataFrame, children: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """campaigns and their children without those of ``gone``."""
    return {"campaigns": tables.cascaded(campaigns, gone, "campaign_id"), **{name: tables.cascaded(rows, gone, "campaign_id") for name, rows in children.items()}}


def session_statuses(sessions: DataFrame, subscriptions: DataFrame, statuses: DataFrame) -> dict[str, DataFrame]:
    """sessions and subscriptions after status reports: session_id, station_id, generation, status, last_audio_at,
    last_error, started_at, reported_at. The last report of a session counts; a session's station and start stay as first
    reported. A station that streams is active, one that reconnects or failed is degraded with the reason; only states from
    which that is a step change. Of a station's sessions the last report decides."""
    known = F.when(F.col("status").isin(*SESSION_STATES), F.col("status")).otherwise("connecting")
    valid = statuses.dropna(subset=["session_id"]).withColumn("status", known).withColumn("last_error", F.nullif(F.substring(F.coalesce("last_error", F.lit("")), 1, 300), F.lit("")))
    last = lambda key: valid.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("reported_at"), F.desc("session_id")))).filter("n = 1").drop("n")
    held = tables.upserted(sessions, last("session_id").select(sessions.columns), ["session_id"], ("station_id", "started_at"))
    says = last("station_id").select("station_id", F.col("status").alias("said"), F.col("last_error").alias("why"))
    both = subscriptions.join(says, "station_id", "left")
    up = (F.col("said") == "streaming") & F.col("state").isin("starting", "degraded", "pending_capacity")
    down = F.col("said").isin("reconnecting", "failed") & F.col("state").isin("starting", "active")
    state = F.when(up, "active").when(down, "degraded").otherwise(F.col("state"))
    reason = F.when(up, F.lit(None).cast("string")).when(down, F.coalesce("why", "said")).otherwise(F.col("state_reason"))
    return {"sessions": held, "subscriptions": both.withColumns({"state": state, "state_reason": reason}).select(subscriptions.columns)}


def refreshed_analyses(analyses: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """analyses after new results of mentions that have one, in place; a result for a mention without analysis is none.
    Safe to repeat: the same results give the same state."""
    own = results.dropna(subset=["mention_id"]).join(analyses.select("mention_id"), "mention_id", "left_semi")
    return {"analyses": tables.upserted(analyses, own.select(analyses.columns), ["mention_id"], ("created_at",))}


def stored_transcripts(transcripts: DataFrame, inbox: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """transcripts and inbox after results: once a segment and pass, and the message that brought it is marked processed
    with it, whether or not the transcript was new."""
    return {"transcripts": tables.inserted(transcripts, results.select(transcripts.columns), ["segment_id", "pass"]), "inbox": tables.inserted(inbox, results.select("message_id", F.concat_ws(":", F.col("segment_id").cast("string"), "pass").alias("reference")), ["message_id"])}


def finished_jobs(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """jobs with the status, error (cut to 500 characters) and finish time of outcomes (job_id, status, error,
    finished_at); only running ones finish."""
    both = jobs.join(outcomes.select("job_id", F.col("status").alias("s"), F.col("error").alias("e"), F.col("finished_at").alias("f")), "job_id", "left")
    ends = (F.col("status") == "running") & F.col("s").isNotNull()
    pick = lambda new, old: F.when(ends, new).otherwise(F.col(old)).alias(old)
    return both.select(*[pick(F.col("s"), c) if c == "status" else pick(F.substring("e", 1, 500), c) if c == "error" else pick(F.col("f"), c) if c == "finished_at" else F.col(c) for c in jobs.columns])


def recent_jobs(jobs: DataFrame, most: int = 50) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(most)


def failures(events: DataFrame, component: str, code: str, retryable: bool) -> DataFrame:
    """Rows of the failure log for events that failed: reference, error, at."""
    return events.select(F.lit(component).alias("component"), F.lit(code).alias("error_code"), F.lit(retryable).alias("retryable"), "reference", F.substring("error", 1, 2000).alias("detail"), F.col("at").alias("created_at"))


def known_mentions(candidates: DataFrame, mentions: DataFrame) -> DataFrame:
    """Candidates (keyword_id, transcript_key) that a mention already has."""
    return candidates.join(mentions.select("keyword_id", "transcript_key"), ["keyword_id", "transcript_key"], "left_semi")


def contexts(jobs: DataFrame, stations: DataFrame, segments: DataFrame) -> DataFrame:
    """jobs with the station's name (else its id) and the content type of the conversation: that of most of its segments, of
    equals the least. segments: conversation_id, content_type."""
    counted = segments.filter("content_type IS NOT NULL").groupBy("conversation_id", "content_type").agg(F.count("*").alias("n"))
    kind = counted.groupBy("conversation_id").agg(F.min_by("content_type", F.struct(-F.col("n"), "content_type")).alias("content_type"))
    named = jobs.join(stations.select("station_id", F.col("name").alias("station_name")), "station_id", "left").join(kind, "conversation_id", "left")
    return named.withColumn("station_name", F.coalesce("station_name", F.col("station_id").cast("string"))).withColumn("content_type", F.coalesce("content_type", F.lit("unknown")))


def semantic_id(campaign: Column, keyword: Column, group: Column, matched: Column) -> Column:
    """The id of a semantic mention: 32 digits of the hash of campaign, keyword, group and case-folded text."""
    return F.substring(F.sha2(F.concat_ws("|", campaign.cast("string"), keyword.cast("string"), group.cast("string"), keys(matched, "casefold")), 256), 1, 32)


def counted(rows: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """rows, and counters of them that the job which uses the rows fills in: no pass of their own."""
    seen = Observation(name)
    return rows.observe(seen, *[c.alias(n) for n, c in counters.items()]), seen


def synchronised(objects: DataFrame, watermarks: DataFrame, mentions: DataFrame, found: DataFrame, revision: Column, since: Column, source: str, ids: list[str], keep: tuple[str, ...]) -> tuple[DataFrame, dict[str, Observation]]:
    """The mentions after a round of ingest, and the counters of the round: objects scanned, objects loaded, mentions seen,
    mentions kept. found: the mentions in the objects, with their object's key."""
    scanned, n_scanned = counted(objects, "objects_scanned", n=F.count(F.lit(1)))
    fresh, n_loaded = counted(ingest.changed(scanned, watermarks, revision, since), "objects_loaded", n=F.count(F.lit(1)))
    seen, n_seen = counted(found.join(fresh.select(F.col("key").alias("object_key")), "object_key", "left_semi").drop("object_key"), "mentions_seen", n=F.count(F.lit(1)))
    after, n_kept = counted(ingest.replaced_by_source(mentions, seen, seen, source, ids, keep), "mentions", n=F.count(F.lit(1)))
    return after, {"objects_scanned": n_scanned, "objects_loaded": n_loaded, "mentions_seen": n_seen, "mentions": n_kept}


def capacity(subscriptions: DataFrame, bindings: DataFrame, sessions: DataFrame, jobs: DataFrame, slots: int) -> DataFrame:
    """One row of counters with distinct meanings: stations that campaigns want, that are shared by several, admitted,
    waiting, streaming; jobs open; free slots; and whether one more can be added."""
    wanted = bindings.groupBy("station_id").agg(F.count_distinct("campaign_id").alias("n")).agg(F.count("*").alias("requested_stations"), F.count(F.when(F.col("n") > 1, 1)).alias("shared_stations"), F.coalesce(F.sum("n"), F.lit(0)).alias("bindings"))
    state = F.col("state")
    states = subscriptions.agg(F.count(F.when(state.isin("starting", "active", "degraded"), 1)).alias("admitted_stations"), F.count(F.when(state == "pending_capacity", 1)).alias("waiting_stations"))
    live = sessions.agg(F.count_distinct(F.when(F.col("status") == "streaming", F.col("station_id"))).alias("streaming_stations"))
    open_ = jobs.agg(F.count(F.when(F.col("status").isin("pending", "running"), 1)).alias("open_jobs"))
    one = wanted.crossJoin(states).crossJoin(live).crossJoin(open_)  # four single rows
    free = F.greatest(F.lit(slots) - F.col("admitted_stations"), F.lit(0)).cast("long")
    return one.withColumn("free_slots", free).withColumn("can_add", free > 0)
