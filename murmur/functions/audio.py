"""Audio windows of signed 16-bit mono samples: frame features, the class of a window, WAV headers.

A null or odd-sized binary is read as far as it holds whole samples; a window shorter than a frame has no frames and an
unknown class.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The measures' thresholds.
RATE, FRAME_MS, QUIET, SILENT = 16_000, 32, -120.0, -50.0
LOW_ENERGY, ZCR_VARIANCE, ENERGY_VARIANCE, LOUDNESS = (0.14, 0.22), 0.0035, 12.0, (-45.0, -30.0)
FLOOR, VOICE = 0.25, 0.5
MEASURES = ("mean_dbfs", "peak_dbfs", "silence_ratio", "low_energy_ratio", "zcr_mean", "zcr_variance", "energy_variance")
SIGNALS = T.StructType([T.StructField("frame_count", T.LongType()), *[T.StructField(m, T.DoubleType()) for m in MEASURES]])


def window_signals(pcm: bytes, rate: int = RATE, frame_ms: int = FRAME_MS) -> tuple:
    """The measures of one window; variances are those of a sample."""
    size = max(1, rate * frame_ms // 1000)
    x = np.frombuffer(pcm, dtype="<i2", count=len(pcm) // 2).astype(np.float64)
    n = len(x) // size
    if not n:
        return 0, QUIET, QUIET, 1.0, 0.0, 0.0, 0.0, 0.0
    frames = x[: n * size].reshape(n, size)
    rms = np.sqrt((frames**2).mean(axis=1)) / 32768.0
    dbfs = np.where(rms > 1e-9, 20 * np.log10(np.maximum(rms, 1e-9)), QUIET)
    up = frames >= 0
    crossings = (up[:, 1:] != up[:, :-1]).sum(axis=1) / max(1, size - 1)
    spread = (lambda v: float(v.var(ddof=1))) if n > 1 else (lambda v: 0.0)
    return n, dbfs.mean(), dbfs.max(), float((dbfs <= SILENT).mean()), float((rms < 0.5 * rms.mean()).mean()), crossings.mean(), spread(crossings), spread(dbfs)


@F.pandas_udf(SIGNALS)
def signals(pcm: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([window_signals(b) for b in pcm], columns=SIGNALS.names)


# For each measure, where its evidence begins and is full, and its weight for speech and for music. For
# music, all but the loudness count by what is missing to full evidence.
EVIDENCE = {
    "low_energy_ratio": (*LOW_ENERGY, 0.45, 0.4),
    "zcr_variance": (0.4 * ZCR_VARIANCE, ZCR_VARIANCE, 0.3, 0.25),
    "energy_variance": (0.4 * ENERGY_VARIANCE, ENERGY_VARIANCE, 0.25, 0.25),
    "mean_dbfs": (*LOUDNESS, 0.0, 0.1),
}
# A score counts from here on; the share of a voice's vote in the score of speech; and for each class the
# largest certainty, the certainty that it begins with, and what a unit of its measure adds.
COUNTS, VOTE = 0.5, 0.4
CERTAINTY = {"silence": (0.99, 0.6, 0.4), "speech_over_music": (0.9, 0.45, 1.0), "speech": (0.95, 0.5, 0.5), "singing": (0.8, 0.4, 0.5), "music": (0.9, 0.45, 0.5)}


def _scores(voice: str | None) -> dict[str, Column]:
    """speech_score and music_score: weighted evidence of the measures."""
    speech, music = F.lit(0.0), F.lit(0.0)
    for measure, (begins, full, for_speech, for_music) in EVIDENCE.items():
        share = F.least(F.greatest((F.col(measure) - begins) / (full - begins), F.lit(0.0)), F.lit(1.0))
        speech = speech + for_speech * share
        music = music + for_music * (share if measure == "mean_dbfs" else 1 - share)
    if voice:
        heard = (F.col(voice) >= VOICE).cast("double")
        speech = F.when(F.col(voice).isNull(), speech).otherwise((1 - VOTE) * speech + VOTE * heard)
    return {"speech_score": speech, "music_score": music}


def _first_that_holds(rules: list[tuple[Column, str, Column]], otherwise: Column) -> Column:
    """kind and sure of the first rule (condition, class, measure) that holds; sure by the class's certainty."""
    out = F.struct(F.lit("unknown").alias("kind"), otherwise.alias("sure"))
    for holds, kind, measure in reversed(rules):
        most, base, slope = CERTAINTY.get(kind, (0.0, 0.0, 0.0))
        out = F.when(holds, F.struct(F.lit(kind).alias("kind"), F.least(F.lit(most), base + slope * measure).alias("sure"))).otherwise(out)
    return out


def classified(windows: DataFrame, pcm: str = "pcm", voice: str | None = None) -> DataFrame:
    """Windows with their measures, audio_class and confidence. ``voice``: a column with the probability of a voice."""
    rows = windows.withColumn("s", signals(F.coalesce(F.col(pcm), F.lit(b"")))).select("*", "s.*").drop("s").withColumns(_scores(voice))
    vote = F.coalesce(F.col(voice) >= VOICE, F.lit(False)) if voice else F.lit(False)
    talk, tune = F.col("speech_score"), F.col("music_score")
    has_music, apart = tune >= COUNTS, F.abs(talk - tune)
    has_speech = (talk >= COUNTS) | (has_music & ((talk >= FLOOR) | vote))
    still = (F.col("silence_ratio") >= 0.95) | (F.col("peak_dbfs") <= SILENT)
    rules = [
        (F.col("frame_count") == 0, "unknown", F.lit(0.0)),
        (still, "silence", F.col("silence_ratio")),
        (has_speech & has_music, "speech_over_music", apart),
        (has_speech, "speech", talk),
        (has_music & (vote | (F.col("zcr_variance") >= ZCR_VARIANCE / 2)), "singing", tune),
        (has_music, "music", tune),
    ]
    decided = rows.withColumn("d", _first_that_holds(rules, F.greatest(F.lit(0.1), 0.5 - apart)))
    return decided.withColumns({"audio_class": F.col("d.kind"), "confidence": F.col("d.sure")}).drop("d")


def wav(pcm: Column, rate: int = RATE) -> Column:
    """Samples with a WAV header before them."""

    @F.pandas_udf(T.BinaryType())
    def headed(data: pd.Series) -> pd.Series:
        head = lambda n: b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", n)
        return pd.Series([head(len(b)) + b for b in data], dtype=object)

    return F.when(pcm.isNotNull(), headed(F.coalesce(pcm, F.lit(b""))))
