"""Ordered operators on each station's segments: runs, gap sessions, missing sequences, look-back, conversations.

The windows sort one station's rows at a time: a station's stream must fit a task's sort, which spills to disk.
Nulls: a row without time sorts first and opens nothing; a null class is no change of class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(key: str, *order):
    return Window.partitionBy(key).orderBy(*order)


def seconds(ts: Column) -> Column:
    """Whole and fractional seconds of a zone-free or zoned time."""
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def gap_sessions(segments: DataFrame, gap_s: float, key: str = "station_id") -> DataFrame:
    """Segments with ``session`` (from 0): a new one begins when gap_s or more passed since the last one ended (where
    segments have no ``ended_at``, since it began)."""
    order = _by(key, "started_at", "segment_id")
    at, end = (seconds(F.col(c)) for c in ("started_at", "ended_at" if "ended_at" in segments.columns else "started_at"))
    opens = F.coalesce((at - F.lag(end).over(order) >= gap_s).cast("long"), F.lit(0))
    return segments.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def session_summary(sessioned: DataFrame, key: str = "station_id") -> DataFrame:
    return sessioned.groupBy(key, "session").agg(F.count("*").alias("n_segments"), F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at"), F.countDistinct("class").alias("n_classes"))


def class_runs(segments: DataFrame, key: str = "station_id") -> DataFrame:
    """Runs of one class: number, length and mean value."""
    order = _by(key, "started_at", "segment_id")
    change = F.coalesce((F.col("class") != F.lag("class").over(order)).cast("long"), F.lit(0))
    runs = segments.withColumn("_c", change).withColumn("run", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.first("class").alias("class"), F.count("*").alias("length"), F.round(F.avg("value"), 4).alias("mean_value"))


def missing_sequences(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """Gaps in an ascending sequence: the numbers between each row and the one before."""
    before = F.lag(sequence).over(_by(key, sequence))
    gaps = rows.withColumn("_b", before).filter(F.col(sequence) > F.col("_b") + 1)
    return gaps.select(key, (F.col("_b") + 1).alias("first_missing"), (F.col(sequence) - 1).alias("last_missing"), (F.col(sequence) - F.col("_b") - 1).alias("n_missing"))


def accepted(rows: DataFrame, key: str, arrival: list, sequence: str) -> DataFrame:
    """Rows whose sequence exceeds every earlier arrival's of the same key: duplicates and late ones go."""
    seen = F.max(sequence).over(_by(key, *arrival).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_seen", seen).filter(F.col("_seen").isNull() | (F.col(sequence) > F.col("_seen"))).drop("_seen")


def lookback(segments: DataFrame, opener: Column, span_s: int, key: str = "station_id") -> DataFrame:
    """For each opener, the number of earlier segments that end (where there is no ``ended_at``: begin) within span_s before
    it begins."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    frame = Window.partitionBy(key).orderBy("_end").rangeBetween(-span_s * 1_000_000, -1)
    rows = segments.withColumn("_end", micros("ended_at" if "ended_at" in segments.columns else "started_at")).withColumn("_at", micros("started_at"))
    # openers as points of their own among the others' ends
    points = rows.select(*segments.columns, F.col("_end"), F.lit(False).alias("_opens")).unionByName(rows.filter(opener).select(*segments.columns, F.col("_at").alias("_end"), F.lit(True).alias("_opens")))
    counted = points.withColumn("n_before", F.count(F.when(~F.col("_opens"), 1)).over(frame))
    return counted.filter("_opens").drop("_end", "_opens")


def conversation_text(turns: DataFrame) -> DataFrame:
    """Text of each conversation: stripped, non-blank turns in order, joined by spaces, with their bounds."""
    clean = turns.select("conv_id", "turn", F.trim("text").alias("text")).filter(F.col("text") != "")
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    out = clean.groupBy("conv_id").agg(parts.alias("p"))
    return out.select("conv_id", F.col("p")[0]["turn"].alias("first_turn"), F.element_at("p", -1)["turn"].alias("last_turn"), F.size("p").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("p", lambda x: x["text"]), " "), 256).alias("text_sha256"))


def turn_offsets(turns: DataFrame) -> DataFrame:
    """Where each turn's stripped text begins in its conversation's text."""
    clean = turns.select("conv_id", "turn", F.char_length(F.trim("text")).cast("long").alias("n")).filter("n > 0")
    before = F.sum(F.col("n") + 1).over(_by("conv_id", "turn").rowsBetween(Window.unboundedPreceding, -1))
    return clean.withColumn("start_char", F.coalesce(before, F.lit(0))).withColumn("end_char", F.col("start_char") + F.col("n")).drop("n")


def dominant(rows: DataFrame, key: str, value: str, weight: str, order: str) -> DataFrame:
    """The value with the most weight of each key; the first seen wins a tie."""
    sums = rows.groupBy(key, value).agg(F.sum(weight).alias("w"), F.min(order).alias("o"))
    return sums.groupBy(key).agg(F.min_by(value, F.struct(-F.col("w"), F.col("o"))).alias(value), F.max("w").alias("weight"))
