"""Named queries of the mention engine over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions import content
from murmur.operators import mentions, planning, reports, sessions, tables
from murmur.operators.matching import one_left_out
from murmur.plans import audio, catalogue, changes, config, feed, ingest, matching, records, transcripts, work
from murmur.sources.documents import parsed
from murmur.sources import mention_tables
from murmur.sources.storage import new_path
from murmur.sources.views import SQL, Views
from murmur.streaming import conversations as streams

POLICY = {"advertisement": True, "song_lyrics": False, "news": True, "long_form_singing": False}
GAP_S = 21_600


def _bound(v: Views) -> DataFrame:
    return planning.bindings(v.campaigns(), v.campaign_stations(), v.campaign_keywords())


BOUND = "bound AS (SELECT s.station_id, c.campaign_id, k.keyword_id, k.value, k.kind FROM campaigns c JOIN campaign_stations s USING (campaign_id) JOIN campaign_keywords k USING (campaign_id) WHERE c.status = 'active' AND k.enabled)"


def station_demand(v):
    return planning.station_demand(_bound(v))


def index_terms(v):
    return planning.index_terms(_bound(v))


def index_fingerprints(v):
    return planning.index_fingerprints(_bound(v))


def subscription_states(v):
    desired = _bound(v).groupBy("station_id").agg(F.countDistinct("campaign_id").alias("reference_count")).filter("station_id % 3 <> 0")
    supplier = v.table("supplier").select(F.col("s_suppkey").alias("station_id"))
    state = F.element_at(F.array(*map(F.lit, ("active", "stopped", "winding_down", "desired", "pending_capacity"))), (F.col("station_id") % 5 + 1).cast("int"))
    existing = supplier.select("station_id", state.alias("state"), F.when(F.col("station_id") % 5 == 2, (F.col("station_id") % 7 - 3) * 60).alias("deadline_s"))
    return planning.subscription_states(desired, existing)


def _legacy(v: Views) -> DataFrame:
    return v.segments().filter(F.col("class").isin("purchase", "click")).select(F.col("segment_id").alias("mention_id"), F.col("station_id").cast("string").alias("station"), F.when(F.col("value") > 50, "positive").otherwise("mixed").alias("label"))


FEED = """feed AS (SELECT 'pipeline' AS store, mention_id, station, CASE WHEN quality = 1 THEN 'positive' WHEN quality = 0 AND toxic = 1 THEN 'negative' ELSE 'neutral' END AS sentiment, CAST(coalesce(toxic, 1) AS BIGINT) AS needs_review, coalesce(lang, '') AS language FROM mentions
UNION ALL SELECT 'legacy', segment_id, CAST(station_id AS VARCHAR), CASE WHEN value > 50 THEN 'positive' ELSE 'neutral' END, 1, '' FROM segments WHERE class IN ('purchase', 'click'))"""


def _feed(v: Views) -> DataFrame:
    return mentions.feed(v.mentions(), _legacy(v))


def mention_feed(v):
    return _feed(v)


def feed_page(v):
    return mentions.page(mentions.filtered(_feed(v), sentiment="positive"), [F.desc("mention_id"), "store"], 50, 25)


def sentiment_counts(v):
    return mentions.sentiment_counts(_feed(v))


def sentiment_by_station(v):
    return _feed(v).groupBy("store", "station", "sentiment").agg(F.count("*").alias("n"))


def top_keyword(v):
    return mentions.top_by(_bound(v).select("campaign_id", "keyword_id", "kind"), ["campaign_id"], ["kind", "keyword_id"])


def best_pass(v):
    passes = v.segments().select((F.col("segment_id") % 5000).alias("segment_id"), F.when(F.col("segment_id") >= 5000, "b").otherwise("a").alias("pass"), F.col("segment_id").alias("transcript_id"))
    return mentions.best_pass(passes.groupBy("segment_id", "pass").agg(F.max("transcript_id").alias("transcript_id")))


def policy_fan_out(v):
    key = F.col("o_orderkey")
    flags = F.when(key % 5 == 0, "song_lyrics").when(key % 5 == 1, "advertisement").when(key % 5 == 2, "news")
    found = v.table("orders").select(key.alias("mention_id"), flags.alias("flag"))
    policy = F.when(F.col("campaign_id") % 3 == 0, F.create_map(F.lit("song_lyrics"), F.lit(True), F.lit("news"), F.lit(False)))
    return mentions.fan_out(found, mention_tables.mention_campaigns(v).select("mention_id", "campaign_id", policy.alias("policy")), POLICY, "mention_id")


def gap_sessions(v):
    return sessions.session_summary(sessions.gap_sessions(v.segments(), GAP_S))


def class_runs(v):
    return sessions.class_runs(v.segments())


def missing_sequences(v):
    rows = v.table("lineitem").select("l_suppkey", F.col("l_orderkey")).distinct()
    return sessions.missing_sequences(rows, "l_suppkey", "l_orderkey")


def accepted_segments(v):
    rows = v.segments().select("station_id", "segment_id", "started_at", (F.col("segment_id") % 997).alias("sequence"))
    return sessions.accepted(rows, "station_id", ["started_at", "segment_id"], "sequence")


def lookback(v):
    return sessions.lookback(v.segments(), F.col("class") == "purchase", 86_400).select("segment_id", "station_id", "n_before")


def conversation_text(v):
    return sessions.conversation_text(v.table("conversations"))


def turn_offsets(v):
    return sessions.turn_offsets(v.table("conversations"))


def dominant_language(v):
    return sessions.dominant(v.table("documents").select("doc_id", "lang", "source", "n_chars"), "source", "lang", "n_chars", "doc_id")


def latest_hit(v):
    return v.segments().groupBy("station_id").agg(F.max("started_at").alias("latest_at"), F.max_by("segment_id", F.struct("started_at", "segment_id")).alias("segment_id"))


def status_counts(v):
    return reports.status_counts(v.table("orders"), "o_orderstatus")


def shard_coverage(v):
    workers = v.table("customer").filter("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") * 7 % 64).alias("shard")).filter("shard % 5 <> 1")
    return reports.shard_coverage(workers, 64)


def deletable_segments(v):
    kinds = F.when(F.col("class") == "view", "disposable").when(F.col("class") == "click", "failed").otherwise("retained")
    found = v.segments().select("segment_id", kinds.alias("disposition"), (F.col("segment_id") * 37 % 100_000).alias("age_s"))
    jobs = v.table("orders").select(F.col("o_orderkey").alias("segment_id"), F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("running").alias("job_status"))
    return reports.deletable(found, jobs, v.table("labels").select(F.col("doc_id").alias("segment_id"))).select("segment_id", "disposition", "age_s")


def merged_catalogue(v):
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    rows = v.table("pages").select("page_id", host.alias("host")).withColumn("name", F.col("host"))
    hosts = rows.select("host").distinct()
    gone = hosts.filter(F.col("host").startswith("m."))
    named = hosts.filter(F.col("host").endswith(".org")).select("host", F.upper("host").alias("name"))
    return reports.merged_catalogue(rows, named, gone)


def repetition_loops(v):
    return reports.repetition_loops(v.table("documents"))


def reference_buckets(v):
    demand = planning.station_demand(_bound(v))
    n = F.col("reference_count")
    return demand.agg(F.count("*").alias("stations"), F.count(F.when(n > 1, 1)).alias("shared"), F.max(n).alias("most"), F.sum("binding_count").alias("bindings"))


def untracked_mentions(v):
    return v.table("documents").select("doc_id").join(v.table("labels").select("doc_id"), "doc_id", "left_anti")


def ranked_stations(v):
    votes = v.table("supplier").join(v.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country")), "s_nationkey")
    return mentions.running_rank(votes.select("country", "s_suppkey", "s_acctbal"), ["country"], [F.desc("s_acctbal"), "s_suppkey"]).filter("rank <= 3")


def near_terms(v):
    """Pairs of distinct part names one edit apart: they share a form with one character left out."""
    names = v.table("part").select(F.col("p_name").alias("name")).distinct()
    forms = names.select("name", F.explode(one_left_out(F.col("name"))).alias("form"))
    pairs = forms.join(forms.select(F.col("name").alias("other"), "form"), "form").filter(F.col("name") < F.col("other")).select("name", "other").distinct()
    return pairs.filter(F.levenshtein("name", "other", 1) >= 0)


def _with(body: str, *more: str) -> str:
    return "WITH " + ", ".join(x.strip() for x in (SQL, *more)) + " " + body


ORDER = "PARTITION BY station_id ORDER BY started_at, segment_id"


def conversation_stream(v):
    """Events replayed as segments: a purchase is a match, pauses are hours. A station's numbers lie far apart here, so what
    is missing is told by gaps (first, last), each number in one of them; ``streams.spelled`` lists the numbers."""
    events = v.table("events")
    arriving = v.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 64).parquet(f"{v.folder}/events.parquet*")  # a pattern: the table may be one file
    at = F.col("ts").cast("timestamp")
    segments = arriving.select(F.col("user_id").alias("station_id"), F.lit("s").alias("session_id"), F.col("event_id").alias("sequence"), at.alias("started_at"), (at + F.expr("INTERVAL 5 SECONDS")).alias("ended_at"), F.col("event_type").alias("class"), (F.col("event_type") == "purchase").cast("long").alias("n_matches"), F.col("event_type").alias("text"))
    limits = streams.Limits(pause_s=2 * GAP_S, before_s=2 * GAP_S, longest_s=20 * GAP_S)
    return streams.drained(streams.closed(segments, limits), new_path(v.spark, "conversation-stream"))


def content_types(v):
    kinds = F.array(*map(F.lit, ("speech", "speech_over_music", "singing", "speech")))
    return content.classified(v.table("documents").select("doc_id", "text", F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("audio_class"))).drop("text")


def upserted_orders(v):
    orders = v.table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    old = orders.filter("o_orderkey % 3 <> 0")
    new = orders.filter("o_orderkey % 3 = 0 OR o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("U")).withColumn("o_totalprice", F.lit(0.0))
    return tables.upserted(old, new, ["o_orderkey"], keep=("o_totalprice",))


def enqueued_jobs(v):
    orders = v.table("orders")
    jobs = orders.select(F.col("o_custkey").alias("station_id"), F.col("o_orderpriority").alias("action"), F.col("o_orderstatus").alias("status"))
    wanted = v.table("customer").select(F.col("c_custkey").alias("station_id"), F.explode(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("action"))
    return tables.enqueued(jobs, wanted, ["station_id", "action"], F.col("status").isin("O", "P"))


def refused_messages(v):
    got = parsed(v.table("events").select("event_id", "event_type", "props"), "props", "k string", ["k"])
    return got.groupBy("event_type", F.coalesce("refused", F.lit("none")).alias("refused")).agg(F.count("*").alias("n"))


QUERIES: dict[str, tuple[Callable, str | None]] = {
    "station_demand": (station_demand, _with("SELECT station_id, count(DISTINCT campaign_id) AS reference_count, count(DISTINCT keyword_id) AS keyword_count, count(*) AS binding_count FROM bound GROUP BY station_id", BOUND)),
    "index_terms": (index_terms, _with("SELECT station_id, trim(lower(value)) AS term, min(value) AS display, array_to_string(list_sort(list(DISTINCT keyword_id)), ',') AS keyword_ids, CAST(length(trim(lower(any_value(value)))) AS BIGINT) AS length FROM bound WHERE trim(lower(value)) <> '' GROUP BY station_id, trim(lower(value))", BOUND)),
    "index_fingerprints": (index_fingerprints, _with("SELECT station_id, sha256(CAST(station_id AS VARCHAR) || chr(0) || string_agg(entry || chr(0), '' ORDER BY entry)) AS fingerprint FROM (SELECT DISTINCT station_id, lpad(CAST(keyword_id AS VARCHAR), 12, '0') || '|' || lpad(CAST(campaign_id AS VARCHAR), 12, '0') || '|' || value AS entry FROM bound) GROUP BY station_id", BOUND)),
    "subscription_states": (subscription_states, _with("""SELECT coalesce(d.station_id, e.station_id) AS station_id, CAST(coalesce(reference_count, 0) AS BIGINT) AS reference_count,
CASE WHEN coalesce(reference_count, 0) > 0 THEN CASE WHEN state IS NULL OR state IN ('stopped', 'desired', 'winding_down') THEN 'pending_capacity' ELSE state END
 WHEN deadline_s IS NULL THEN CASE WHEN state = 'stopped' THEN 'stopped' ELSE 'winding_down' END WHEN deadline_s <= 0 THEN 'stopped' ELSE 'winding_down' END AS state,
CASE WHEN coalesce(reference_count, 0) > 0 THEN NULL WHEN deadline_s IS NULL AND state <> 'stopped' THEN 300 WHEN deadline_s > 0 THEN deadline_s END AS deadline_s
FROM (SELECT station_id, count(DISTINCT campaign_id) AS reference_count FROM bound WHERE station_id % 3 <> 0 GROUP BY station_id) d FULL JOIN
(SELECT s_suppkey AS station_id, ['active', 'stopped', 'winding_down', 'desired', 'pending_capacity'][s_suppkey % 5 + 1] AS state, CASE WHEN s_suppkey % 5 = 2 THEN (s_suppkey % 7 - 3) * 60 END AS deadline_s FROM supplier) e ON d.station_id = e.station_id""", BOUND)),
    "mention_feed": (mention_feed, _with("SELECT * FROM feed", FEED)),
    "feed_page": (feed_page, _with("SELECT * FROM feed WHERE sentiment = 'positive' ORDER BY mention_id DESC, store LIMIT 50 OFFSET 25", FEED)),
    "sentiment_counts": (sentiment_counts, _with("SELECT count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative, count(*) AS total, CAST(sum(needs_review) AS BIGINT) AS needs_review FROM feed", FEED)),
    "sentiment_by_station": (sentiment_by_station, _with("SELECT store, station, sentiment, count(*) AS n FROM feed GROUP BY ALL", FEED)),
    "top_keyword": (top_keyword, _with("SELECT campaign_id, keyword_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY kind, keyword_id) AS r FROM bound) WHERE r = 1", BOUND)),
    "best_pass": (best_pass, _with("SELECT segment_id, pass, max(transcript_id) AS transcript_id FROM (SELECT segment_id % 5000 AS segment_id, CASE WHEN segment_id >= 5000 THEN 'b' ELSE 'a' END AS pass, segment_id AS transcript_id FROM segments) t GROUP BY segment_id, pass QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY pass DESC) = 1")),
    "policy_fan_out": (policy_fan_out, """SELECT mention_id, campaign_id, coalesce(flag IS NULL OR allowed, true) AS included, CASE WHEN NOT coalesce(flag IS NULL OR allowed, true) THEN 'excluded by ' || flag END AS reason FROM (
SELECT o_orderkey AS mention_id, l_suppkey AS campaign_id, flag, CASE WHEN l_suppkey % 3 = 0 AND flag = 'song_lyrics' THEN true WHEN l_suppkey % 3 = 0 AND flag = 'news' THEN false WHEN flag = 'song_lyrics' THEN false ELSE true END AS allowed
FROM (SELECT *, ['song_lyrics', 'advertisement', 'news'][o_orderkey % 5 + 1] AS flag FROM orders) JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey)"""),
    "gap_sessions": (gap_sessions, _with(f"""SELECT station_id, session, count(*) AS n_segments, min(started_at) AS first_at, max(started_at) AS last_at, count(DISTINCT class) AS n_classes FROM (SELECT *, CAST(sum(opens) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, CASE WHEN epoch_us(started_at) - lag(epoch_us(started_at)) OVER ({ORDER}) >= {GAP_S}000000 THEN 1 ELSE 0 END AS opens FROM segments)) GROUP BY station_id, session""")),
    "class_runs": (class_runs, _with(f"""SELECT station_id, run, min(class) AS class, count(*) AS length, round(avg(value), 4) AS mean_value FROM (SELECT *, CAST(sum(c) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (SELECT *, CASE WHEN class <> lag(class) OVER ({ORDER}) THEN 1 ELSE 0 END AS c FROM segments)) GROUP BY station_id, run""")),
    "missing_sequences": (missing_sequences, "SELECT l_suppkey, b + 1 AS first_missing, l_orderkey - 1 AS last_missing, l_orderkey - b - 1 AS n_missing FROM (SELECT *, lag(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS b FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)) WHERE l_orderkey > b + 1"),
    "accepted_segments": (accepted_segments, _with(f"SELECT station_id, segment_id, started_at, sequence FROM (SELECT *, max(sequence) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT station_id, segment_id, started_at, segment_id % 997 AS sequence FROM segments)) WHERE seen IS NULL OR sequence > seen")),
    "lookback": (lookback, _with("""SELECT a.segment_id, a.station_id, count(b.segment_id) AS n_before FROM segments a LEFT JOIN segments b ON a.station_id = b.station_id AND b.started_at < a.started_at AND b.started_at >= a.started_at - INTERVAL 86400 SECONDS
WHERE a.class = 'purchase' GROUP BY a.segment_id, a.station_id""")),
    "conversation_text": (conversation_text, "SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_turns, sha256(string_agg(trim(text, ' '), ' ' ORDER BY turn, trim(text, ' '))) AS text_sha256 FROM conversations WHERE trim(text, ' ') <> '' GROUP BY conv_id"),
    "turn_offsets": (turn_offsets, "SELECT conv_id, turn, s AS start_char, s + n AS end_char FROM (SELECT *, CAST(coalesce(sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM (SELECT conv_id, turn, CAST(length(trim(text, ' ')) AS BIGINT) AS n FROM conversations) WHERE n > 0)"),
    "dominant_language": (dominant_language, "SELECT source, lang, weight FROM (SELECT source, lang, CAST(sum(n_chars) AS BIGINT) AS weight, row_number() OVER (PARTITION BY source ORDER BY sum(n_chars) DESC, min(doc_id)) AS r FROM documents GROUP BY source, lang) WHERE r = 1"),
    "latest_hit": (latest_hit, _with("SELECT station_id, started_at AS latest_at, segment_id FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY started_at DESC, segment_id DESC) AS r FROM segments) WHERE r = 1")),
    "status_counts": (status_counts, "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1"),
    "shard_coverage": (shard_coverage, "SELECT shard, coalesce(n, 0) AS n_workers, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'single' ELSE 'duplicated' END AS state FROM (SELECT unnest(range(64)) AS shard) LEFT JOIN (SELECT c_custkey * 7 % 64 AS shard, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) USING (shard) WHERE shard % 5 <> 1 UNION ALL SELECT s, 0, 'missing' FROM (SELECT unnest(range(64)) AS s) WHERE s % 5 = 1"),
    "deletable_segments": (deletable_segments, _with("""SELECT segment_id, disposition, age_s FROM (SELECT segment_id, CASE class WHEN 'view' THEN 'disposable' WHEN 'click' THEN 'failed' ELSE 'retained' END AS disposition, segment_id * 37 % 100000 AS age_s FROM segments) s LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'succeeded' ELSE 'running' END AS job_status FROM orders) j ON j.o_orderkey = s.segment_id
WHERE ((disposition = 'disposable' AND age_s > 600 AND job_status = 'succeeded') OR (disposition = 'failed' AND age_s > 86400)) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = s.segment_id)""")),
    "merged_catalogue": (merged_catalogue, "SELECT host, page_id, CASE WHEN ends_with(host, '.org') THEN upper(host) ELSE host END AS name FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages) WHERE NOT starts_with(host, 'm.')"),
    "repetition_loops": (repetition_loops, "SELECT doc_id, n_words, n_distinct, n_words >= 12 AND n_distinct < 0.2 * n_words AS loops FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents))"),
    "reference_buckets": (reference_buckets, _with("SELECT count(*) AS stations, count(*) FILTER (n > 1) AS shared, max(n) AS most, CAST(sum(b) AS BIGINT) AS bindings FROM (SELECT count(DISTINCT campaign_id) AS n, count(*) AS b FROM bound GROUP BY station_id)", BOUND)),
    "untracked_mentions": (untracked_mentions, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "ranked_stations": (ranked_stations, "SELECT country, s_suppkey, s_acctbal, rank FROM (SELECT n_name AS country, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier JOIN nation ON n_nationkey = s_nationkey) WHERE rank <= 3"),
    "near_terms": (near_terms, "WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT a.name AS name, b.name AS other FROM n a JOIN n b ON a.name < b.name AND levenshtein(a.name, b.name) <= 1"),
    "conversation_stream": (conversation_stream, None),
    "content_types": (content_types, None),
    "upserted_orders": (upserted_orders, "SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN o.o_orderstatus ELSE 'U' END AS o_orderstatus, coalesce(o.o_totalprice, 0.0) AS o_totalprice, coalesce(n.o_orderpriority, o.o_orderpriority) AS o_orderpriority FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) o FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0) n ON o.o_orderkey = n.o_orderkey"),
    "enqueued_jobs": (enqueued_jobs, "SELECT c_custkey AS station_id, action FROM customer CROSS JOIN (SELECT unnest(['1-URGENT', '2-HIGH']) AS action) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = action AND o_orderstatus IN ('O', 'P'))"),
    "refused_messages": (refused_messages, "SELECT event_type, CASE WHEN props IS NULL THEN 'empty' WHEN json_extract_string(props, '$.k') IS NULL THEN 'no k' ELSE 'none' END AS refused, count(*) AS n FROM events GROUP BY ALL"),
}


for _module in (audio, config, matching, feed, records, transcripts, ingest, catalogue, work, changes):
    QUERIES |= _module.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
