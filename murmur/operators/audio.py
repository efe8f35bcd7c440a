"""Classified audio windows to kept stretches and segments, and evidence clips from stored segments.

Windows of one station are contiguous and of one length. Nulls: a null class is unknown; a null confidence counts as 0;
a segment without bytes, or whose digest or size differs from what is on record, isn't used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SILENCE_MS, MUSIC_MS, SURE = 12_000, 8_000, 0.55
JINGLE_MS, ADJACENT_MS = 30_000, 60_000
LEAD_MS, CHUNK_MS, OVERLAP_MS = 1_000, 20_000, 1_000
WHOLE = 0.9


def runs(windows: DataFrame) -> DataFrame:
    """Windows with the run of one class that they are in, and, up to each window, the run's length and mean confidence.
    windows: station_id, start_ms, end_ms, audio_class, confidence."""
    order = Window.partitionBy("station_id").orderBy("start_ms")
    rows = windows.withColumns({"audio_class": F.coalesce("audio_class", F.lit("unknown")), "confidence": F.coalesce("confidence", F.lit(0.0))})
    change = F.coalesce((F.col("audio_class") != F.lag("audio_class").over(order)).cast("long"), F.lit(0))
    upto = Window.partitionBy("station_id", "run").orderBy("start_ms").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("change", change).withColumn("run", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("change")
    return rows.withColumns({"run_ms": F.sum(F.col("end_ms") - F.col("start_ms")).over(upto), "run_confidence": F.avg("confidence").over(upto)})


def kept(windows: DataFrame, over_music: bool = True, uncertain: bool = True, jingles: bool = True, long_singing: bool = False) -> DataFrame:
    """Windows with ``keep``: speech always, short silences and short or doubtful music, music close behind speech as long
    as it may be a jingle; the rest by the flags."""
    rows = runs(windows)
    before = Window.partitionBy("station_id").orderBy("start_ms").rowsBetween(Window.unboundedPreceding, -1)
    spoken = F.last(F.when(F.col("audio_class").isin("speech", "speech_over_music", "jingle"), F.col("end_ms")), ignorenulls=True).over(before)
    gap = F.col("end_ms") - F.col("run_ms") - spoken
    jingle = F.lit(jingles) & (F.col("run_ms") <= JINGLE_MS) & F.coalesce((gap >= 0) & (gap <= ADJACENT_MS), F.lit(False))
    kind = F.col("audio_class")
    musical = (F.col("run_ms") < MUSIC_MS) | (F.col("run_confidence") < SURE) | jingle | (F.lit(long_singing) & (kind == "singing"))
    keep = F.when(kind.isin("speech", "jingle"), True).when(kind == "speech_over_music", over_music).when(kind == "unknown", uncertain).when(kind == "silence", F.col("run_ms") < SILENCE_MS).otherwise(musical)
    return rows.withColumn("keep", keep)


def segments(windows: DataFrame, window_ms: int) -> DataFrame:
    """Segments of kept windows: a stretch begins a second early, and is cut where it is 20 seconds long or more; the next
    piece begins a second before the cut. A piece is speech over music if any of its windows is, else of its first one's
    class, and as sure as its least sure one. Pieces are numbered by station."""
    order = Window.partitionBy("station_id").orderBy("start_ms")
    rows = windows.withColumn("opens", F.coalesce((F.col("keep") != F.lag("keep").over(order)).cast("long"), F.lit(0)))
    rows = rows.withColumn("stretch", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("keep")
    inside = Window.partitionBy("station_id", "stretch").orderBy("start_ms")
    per = -(-(CHUNK_MS - OVERLAP_MS) // window_ms)  # windows until a piece with its second before is long enough
    rows = rows.withColumn("piece", F.floor((F.row_number().over(inside) - 1) / per))
    first = F.min_by("audio_class", "start_ms")
    pieces = rows.groupBy("station_id", "stretch", "piece").agg(
        F.greatest(F.min("start_ms") - LEAD_MS, F.lit(0)).alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.when(F.max((F.col("audio_class") == "speech_over_music").cast("int")) == 1, "speech_over_music").otherwise(first).alias("audio_class"), F.min("confidence").alias("confidence"),
    )
    return pieces.withColumn("sequence", F.row_number().over(order).cast("long")).drop("stretch", "piece")


def intact(stored: DataFrame) -> DataFrame:
    """Stored segments whose bytes are those on record. stored: bytes, sha256, size."""
    return stored.filter((F.sha2("bytes", 256) == F.lower("sha256")) & (F.octet_length("bytes") == F.col("size")))


def clips(parts: DataFrame, spans: DataFrame, per_ms: Column) -> DataFrame:
    """The bytes of each clip, its parts in order, where they cover nine tenths of its span or more. A clip's parts are
    bounded by its span. parts: clip_id, place, bytes; spans: clip_id, span_ms; per_ms: bytes of a millisecond."""
    joined = F.expr("listagg(bytes) WITHIN GROUP (ORDER BY place)")
    whole = parts.groupBy("clip_id").agg(joined.alias("bytes"), F.count("*").alias("n_parts")).join(spans, "clip_id")
    enough = F.octet_length("bytes") >= WHOLE * F.col("span_ms") * per_ms
    return whole.filter(enough).select("clip_id", "bytes", "n_parts")


def evidence(mentions: DataFrame, transcripts: DataFrame, segments: DataFrame) -> DataFrame:
    """mention_id, basis, segment_ids (the oldest first) of the audio that shows each mention: its conversation's segments
    that aren't deleted (``conversation``); where there is none, its transcript's own segment, if that covers nine tenths
    of the mention's span or no span is known (``transcript``); a segment that covers less is refused (``partial``), and
    without any there is none (``missing``). mentions: mention_id, conversation_id, transcript_id, span_ms; transcripts:
    transcript_id, conversation_id, segment_id; segments: segment_id, started_at, duration_ms, disposition."""
    held = segments.filter(F.coalesce("disposition", F.lit("")) != "deleted").select("segment_id", "started_at", "duration_ms")
    known = transcripts.join(held, "segment_id")
    in_order = F.transform(F.array_sort(F.collect_set(F.struct("started_at", "segment_id"))), lambda x: x["segment_id"])
    whole = known.filter("conversation_id IS NOT NULL").groupBy("conversation_id").agg(in_order.alias("all_ids"))
    last = known.groupBy("transcript_id").agg(F.min_by("segment_id", F.struct("started_at", "segment_id")).alias("last_id"), F.min_by("duration_ms", F.struct("started_at", "segment_id")).alias("last_ms"))
    both = mentions.join(whole, "conversation_id", "left").join(last, "transcript_id", "left")
    span = F.when(F.col("span_ms") > 0, F.col("span_ms"))
    covers = span.isNull() | (F.coalesce(F.nullif("last_ms", F.lit(0)), F.lit(0)) >= WHOLE * span)
    basis = F.when(F.col("all_ids").isNotNull(), "conversation").when(F.col("last_id").isNull(), "missing").when(covers, "transcript").otherwise("partial")
    none = F.array().cast(both.schema["all_ids"].dataType)
    return both.select("mention_id", basis.alias("basis"), F.when(basis == "conversation", F.col("all_ids")).when(basis == "transcript", F.array("last_id")).otherwise(none).alias("segment_ids"))
