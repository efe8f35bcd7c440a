"""Audio measures against plain ones, made-up samples by class, and document sessions grown step by step."""

import datetime as dt
import math
import statistics
import struct

import numpy as np
import pytest

from murmur.functions import audio
from murmur.operators import transcripts


def plain_signals(samples, size):
    frames = [samples[i : i + size] for i in range(0, len(samples) - size + 1, size)]
    if not frames:
        return 0, -120.0, -120.0, 1.0, 0.0, 0.0, 0.0, 0.0
    rms = [math.sqrt(sum(v * v for v in f) / size) / 32768 for f in frames]
    db = [20 * math.log10(r) if r > 1e-9 else -120.0 for r in rms]
    zcr = [sum((a >= 0) != (b >= 0) for a, b in zip(f, f[1:], strict=False)) / (size - 1) for f in frames]
    var = lambda v: statistics.variance(v) if len(v) > 1 else 0.0
    mean = sum(rms) / len(rms)
    return len(frames), sum(db) / len(db), max(db), sum(d <= -50 for d in db) / len(db), sum(r < 0.5 * mean for r in rms) / len(rms), sum(zcr) / len(zcr), var(zcr), var(db)


@pytest.mark.parametrize("n", [0, 100, 512, 5000])
def test_signals(n):
    samples = np.random.default_rng(n).integers(-20000, 20000, n).tolist()
    got = audio.window_signals(struct.pack(f"<{n}h", *samples) + b"x")
    assert got == pytest.approx(plain_signals(samples, 512))


def test_classes(spark):
    t = np.arange(48_000) / 16_000
    rng = np.random.default_rng(1)
    tone = 8000 * np.sin(2 * np.pi * 440 * t)
    bursts = np.where((t * 4).astype(int) % 2 == 0, rng.normal(0, 6000, len(t)), 20 * np.sin(2 * np.pi * 100 * t))
    rows = [("tone", tone), ("bursts", bursts), ("quiet", 0 * t), ("short", t[:10])]
    df = spark.createDataFrame([(k, x.astype("<i2").tobytes()) for k, x in rows] + [("none", None)], "name string, pcm binary")
    got = {r.name: r.audio_class for r in audio.classified(df).collect()}
    assert got == {"tone": "music", "bursts": "speech", "quiet": "silence", "short": "unknown", "none": "unknown"}


def test_wav(spark):
    df = spark.createDataFrame([(b"\x01\x00\x02\x00",), (None,)], "pcm binary")
    (a, b) = [r[0] for r in df.select(audio.wav(df.pcm)).collect()]
    assert bytes(a[:4]) == b"RIFF" and len(a) == 48 and struct.unpack("<I", a[40:44])[0] == 4 and b is None


def test_sessions_around_an_anchor(spark):
    rng = np.random.default_rng(3)
    t0 = dt.datetime(2024, 1, 1)
    rows, at = [], 0
    for i in range(300):
        at += int(rng.choice([5, 20, 30, 31, 90], p=[0.4, 0.3, 0.1, 0.1, 0.1]))
        length = int(rng.integers(20, 200))
        rows.append(("s", i, t0 + dt.timedelta(seconds=at), t0 + dt.timedelta(seconds=at + length)))
        at += length
    docs = spark.createDataFrame([*rows, ("s", 900, None, None)], "station_id string, key long, started_at timestamp, ended_at timestamp")
    anchors = list(range(0, 300, 7))
    got = {}
    for r in transcripts.around(docs, spark.createDataFrame([(a,) for a in [*anchors, 900, 901]], "key long")).collect():
        got.setdefault(r.anchor, []).append(r.key)
    seconds = lambda a, b: (b - a).total_seconds()
    for a in anchors:
        lo = hi = a
        while lo > 0 and seconds(rows[lo - 1][3], rows[lo][2]) <= 30 and seconds(rows[lo - 1][2], rows[hi][3]) <= 1800:
            lo -= 1
        while hi + 1 < len(rows) and seconds(rows[hi][3], rows[hi + 1][2]) <= 30 and seconds(rows[lo][2], rows[hi + 1][3]) <= 1800:
            hi += 1
        assert sorted(got[a]) == list(range(lo, hi + 1)), a
    assert 900 not in got and 901 not in got
