"""Interval joins against all pairs, and in time linear in a document of 100,000 intervals a side."""

import random
import time

import compare
import pytest
from pyspark.sql import functions as F

from murmur.operators import intervals, matching, transcripts
from murmur.plans import registry

SIDE = "k string, i long, a double, b double"


def some(rng, n, longest, wide):
    rows = []
    for i in range(n):
        a = rng.choice([rng.uniform(0, wide), rng.uniform(0, wide / 100), float(rng.randrange(int(wide)))])
        rows.append((rng.choice(["x", "x", "y", None]), i, a if rng.random() > 0.02 else None, a + rng.choice([0, rng.uniform(0, longest), -1 if rng.random() < 0.1 else 1])))
    return rows


@pytest.mark.parametrize("closed", [False, True])
def test_overlaps_against_all_pairs(spark, closed, monkeypatch):
    rng = random.Random(3)
    for cell, longest in ((4, 3), (4, 900), (64, 40)):
        monkeypatch.setattr(intervals, "PER_CELL", cell)
        left, right = some(rng, 150, longest, 1000), some(rng, 220, longest, 1000)
        ok = lambda r: None not in r and r[2] <= r[3]
        want = {(x[1], y[1]) for x in left if ok(x) for y in right if ok(y) and x[0] == y[0] and (x[2] <= y[3] and y[2] <= x[3] if closed else x[2] < y[3] and y[2] < x[3])}
        got = intervals.overlapping(spark.createDataFrame(left, SIDE), spark.createDataFrame(right, SIDE), "k", ("a", "a"), ("b", "b"), closed).select("l.i", F.col("r.i").alias("j")).collect()
        assert len(got) == len(set(got)) and set(map(tuple, got)) == want and want
    nothing = spark.createDataFrame([], SIDE)
    assert intervals.overlapping(nothing, spark.createDataFrame(right, SIDE), "k", ("a", "a"), ("b", "b")).count() == 0
    assert intervals.overlapping(spark.createDataFrame(left, SIDE), nothing, "k", ("a", "a"), ("b", "b")).count() == 0


def test_points_in_intervals(spark):
    rng = random.Random(4)
    ends = sorted(rng.sample(range(2000), 200))
    held = [("x", n, float(a), float(b)) for n, (a, b) in enumerate(zip(ends[::2], ends[1::2], strict=True))]
    points = [(rng.choice(["x", "z"]), i, float(rng.randrange(-5, 2005)), 0.0) for i in range(300)] + [("x", 999, None, 0.0)]
    got = intervals.holding(spark.createDataFrame(points, SIDE).select("k", F.col("i").alias("p"), "a"), spark.createDataFrame(held, SIDE), "k", "a", "a", "b", "i").collect()
    want = {p[1]: next((n for k, n, a, b in held if k == p[0] and p[2] is not None and a <= p[2] < b), None) for p in points}
    assert {r.p: r.i for r in got} == want and len(got) == len(points)


@pytest.mark.parametrize("name", ["segments_at", "word_highlights", "neighbour_transcripts", "anchored_sessions"])
def test_queries_as_before(spark, name):
    got, want = compare.both(spark, registry.queries()[name], registry.oracle_sql()[name], "/root/testdata/sf0.01")
    assert got == want and got


def test_one_document_of_many_intervals(spark):
    """200,000 intervals a side take a few times what 50,000 take, not sixteen times."""

    def taken(n):
        found = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(2).alias("keyword_id"), (F.col("id") * 7 % (7 * n)).alias("start"), (F.col("id") * 7 % (7 * n) + 5).alias("end"))
        lines = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") * 7 + 3).alias("start_char"), (F.col("id") * 7 + 9).alias("end_char"), (F.col("id") * 10).alias("start_ms"), (F.col("id") * 10 + 9).alias("end_ms"))
        began = time.time()
        rows = matching.timed(found, lines).agg(F.count("start_ms").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("s")).head()
        assert rows.n == n and rows.s == (n - 1) * 19 + 9
        return time.time() - began

    taken(1000)
    small = taken(50_000)
    assert taken(200_000) < 8 * small + 5


def test_a_day_of_many_recordings(spark):
    """One run of 100,000 recordings with an anchor each tenth: sessions are joined, runs are not."""
    n = 100_000
    docs = spark.range(n).select(F.lit("a").alias("station_id"), F.col("id").alias("key"), F.timestamp_seconds(F.col("id") * 10).alias("started_at"), F.timestamp_seconds(F.col("id") * 10 + 8).alias("ended_at"))
    anchors = docs.filter("key % 10 = 0").select("key")
    got = transcripts.around(docs, anchors, 30, 300).groupBy("anchor").agg(F.count("*").alias("n"), F.min("key").alias("lo")).agg(F.count("*"), F.min("n"), F.max("n"), F.min(F.col("anchor") - F.col("lo"))).head()
    assert tuple(got)[:3] == (n // 10, 30, 30)
