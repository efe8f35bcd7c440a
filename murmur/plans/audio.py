"""Queries of audio: texts' bytes are samples, events are classified windows of three seconds, lines are stored segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions import audio as measures
from murmur.operators import audio
from murmur.sources.views import Views

CLASSES = ("speech", "music", "silence", "singing", "speech_over_music", "unknown", "music", "music")
PER = 3000


def audio_windows(v: Views) -> DataFrame:
    """Every whole text's bytes as one window, with a voice probability for some."""
    rows = v.table("documents").select("doc_id", F.encode("text", "UTF-8").alias("pcm"), F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 10) / 10).alias("voice"))
    out = measures.classified(rows, "pcm", "voice").drop("pcm")
    return out.select("doc_id", "frame_count", *[F.round(c, 5).alias(c) for c in ("mean_dbfs", "peak_dbfs", "silence_ratio", "low_energy_ratio", "zcr_mean", "zcr_variance", "energy_variance", "confidence")], "audio_class")


def _windows(v: Views) -> DataFrame:
    """Events in order as contiguous windows; a class holds for several of them."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = v.table("events").withColumn("n", F.row_number().over(order) - 1)
    kind = F.element_at(F.array(*map(F.lit, CLASSES)), (F.pmod(F.floor(F.col("n") / 5) + F.col("user_id"), F.lit(len(CLASSES))) + 1).cast("int"))
    return rows.select(F.col("user_id").alias("station_id"), (F.col("n") * PER).cast("long").alias("start_ms"), (F.col("n") * PER + PER).cast("long").alias("end_ms"), kind.alias("audio_class"), ((F.col("event_id") % 10) / 10).alias("confidence"))


WINDOWS = f"""
windows AS (SELECT user_id AS station_id, n * {PER} AS start_ms, n * {PER} + {PER} AS end_ms, {list(CLASSES)!r}[(n // 5 + user_id) % {len(CLASSES)} + 1] AS audio_class, event_id % 10 / 10 AS confidence
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)),
numbered AS (SELECT *, sum(c) OVER (PARTITION BY station_id ORDER BY start_ms ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN audio_class <> lag(audio_class) OVER (PARTITION BY station_id ORDER BY start_ms) THEN 1 ELSE 0 END AS c FROM windows)),
runs AS (SELECT *, count(*) OVER r * {PER} AS run_ms, avg(confidence) OVER r AS run_confidence,
 max(CASE WHEN audio_class IN ('speech', 'speech_over_music', 'jingle') THEN end_ms END) OVER (PARTITION BY station_id ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spoken
 FROM numbered WINDOW r AS (PARTITION BY station_id, run ORDER BY start_ms ROWS UNBOUNDED PRECEDING)),
kept AS (SELECT station_id, start_ms, end_ms, audio_class, confidence, run_ms, CASE WHEN audio_class IN ('speech', 'speech_over_music', 'unknown') THEN true WHEN audio_class = 'silence' THEN run_ms < 12000
 ELSE run_ms < 8000 OR run_confidence < 0.55 OR coalesce(run_ms <= 30000 AND end_ms - run_ms - spoken BETWEEN 0 AND 60000, false) END AS keep FROM runs)"""


def kept_windows(v: Views) -> DataFrame:
    return audio.kept(_windows(v)).select("station_id", "start_ms", "audio_class", "run_ms", "keep")


def audio_segments(v: Views) -> DataFrame:
    return audio.segments(audio.kept(_windows(v)), PER)


SEGMENTS_SQL = f"""
WITH {WINDOWS.strip()},
stretched AS (SELECT *, sum(o) OVER (PARTITION BY station_id ORDER BY start_ms ROWS UNBOUNDED PRECEDING) AS stretch FROM (SELECT *, CASE WHEN keep <> lag(keep) OVER (PARTITION BY station_id ORDER BY start_ms) THEN 1 ELSE 0 END AS o FROM kept)),
cut AS (SELECT *, (row_number() OVER (PARTITION BY station_id, stretch ORDER BY start_ms) - 1) // 7 AS piece FROM stretched WHERE keep),
pieces AS (SELECT station_id, greatest(min(start_ms) - 1000, 0) AS start_ms, max(end_ms) AS end_ms, CASE WHEN bool_or(audio_class = 'speech_over_music') THEN 'speech_over_music' ELSE arg_min(audio_class, start_ms) END AS audio_class, min(confidence) AS confidence FROM cut GROUP BY station_id, stretch, piece)
SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY start_ms) AS sequence FROM pieces"""


def evidence_clips(v: Views) -> DataFrame:
    """Lines are a document's segments, on record with digest and size; some records are wrong."""
    lines = v.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    data = F.encode("line", "UTF-8")
    stored = lines.select(F.col("doc_id").alias("clip_id"), "place", data.alias("bytes"), F.when((F.col("doc_id") + F.col("place")) % 9 == 0, "0").otherwise(F.upper(F.sha2(data, 256))).alias("sha256"), (F.octet_length("line") + F.when(F.col("doc_id") % 17 == 0, 1).otherwise(0)).alias("size"))
    spans = lines.groupBy(F.col("doc_id").alias("clip_id")).agg(F.sum(F.octet_length("line")).alias("span_ms"))
    return audio.clips(audio.intact(stored), spans, F.lit(1)).select("clip_id", "n_parts", F.sha2("bytes", 256).alias("bytes_sha256"), F.octet_length(measures.wav(F.col("bytes"))).cast("long").alias("wav_size"))


CLIPS_SQL = """
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents),
spans AS (SELECT doc_id, sum(strlen(line)) AS span FROM lines GROUP BY doc_id),
good AS (SELECT doc_id, count(*) AS n_parts, sum(strlen(line)) AS size, string_agg(line, '' ORDER BY place) AS whole FROM lines WHERE (doc_id + place) % 9 <> 0 AND doc_id % 17 <> 0 GROUP BY doc_id)
SELECT doc_id AS clip_id, n_parts, sha256(whole) AS bytes_sha256, CAST(size + 44 AS BIGINT) AS wav_size FROM good JOIN spans USING (doc_id) WHERE size >= 0.9 * span"""


QUERIES = {
    "audio_windows": (audio_windows, None),
    "kept_windows": (kept_windows, f"WITH {WINDOWS.strip()} SELECT station_id, start_ms, audio_class, CAST(run_ms AS BIGINT) AS run_ms, keep FROM kept"),
    "audio_segments": (audio_segments, SEGMENTS_SQL),
    "evidence_clips": (evidence_clips, CLIPS_SQL),
}
