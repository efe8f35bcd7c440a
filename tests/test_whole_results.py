"""Results that must stay whole without growing faster than the input."""

import os
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from murmur.functions import text
from murmur.operators import matching
from murmur.plans import matching as plans
from murmur.plans import registry
from murmur.sources.views import Views
from murmur.streaming import conversations as streams

SOURCE = "/root/testdata/sf0.001"


def test_conversations_of_far_numbers_tell_gaps(spark, tmp_path):
    """Numbers 10,000 apart: the lists of what is missing took 8 bytes a number, gaps take two numbers each."""
    far = 10_000
    spark.read.parquet(f"{SOURCE}/events.parquet").withColumn("event_id", F.col("event_id") * far).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()["conversation_stream"](spark, str(tmp_path))
    near = {(r.station_id, r.first_sequence): r for r in registry.queries()["conversation_stream"](spark, SOURCE).collect()}
    rows = got.collect()
    assert len(rows) == len(near) > 5
    for r in rows:
        assert len(r.gaps) <= r.n_segments
        # between numbers a and b of a station that were neighbours a + 1 to b - 1 are missing, however far apart
        less = near[r.station_id, r.first_sequence // far]
        wide = [(g.first, g.last) for g in r.gaps]
        assert all(a % far == 1 and b % far == far - 1 for a, b in wide)
        assert [(a // far, b // far + 1) for a, b in wide if b - a > far] == [(g.first - 1, g.last + 1) for g in less.gaps]
    got.coalesce(1).write.parquet(f"{tmp_path}/out")
    assert sum(f.stat().st_size for f in os.scandir(f"{tmp_path}/out") if f.name.endswith(".parquet")) < 1_000_000


def test_gaps_of_conversations_hold_each_missing_number(spark):
    """Spelled out, gaps are the numbers between a conversation's segments that another station has."""
    folder = "/root/testdata/sf0.01"
    by: dict = {}
    for r in spark.read.parquet(f"{folder}/events.parquet").orderBy("event_id").select("user_id", "event_id", "event_type").collect():
        by.setdefault(str(r.user_id), []).append((r.event_id, r.event_type == "purchase"))
    rows = streams.spelled(registry.queries()["conversation_stream"](spark, folder)).collect()
    for r in rows:
        numbers = [n for n, _ in by[r.station_id]]
        opener = next(n for n, match in by[r.station_id] if n >= r.first_sequence and match)
        heard = [n for n in numbers if opener <= n <= r.last_sequence]
        since = max((n for n in numbers if n < opener), default=opener)
        assert r.missing == [n for n in range(since + 1, r.last_sequence) if n not in set(heard)]
    assert len(rows) > 100 and sum(len(r.missing) for r in rows) > 10_000


def test_timed_matches_are_not_shuffled(spark):
    """Times are looked up where a document is scanned: 2,707 MB were shuffled at 0.1 GB before."""
    found = plans.timed_matches(Views(spark, SOURCE))
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_times_in_the_scan_and_by_joins(spark, monkeypatch):
    """Entries in any order, over each other, empty, broken or without times; texts and timelines that are null."""
    rng, docs, want = random.Random(3), [], {}
    for i in range(60):
        said = " ".join("".join(rng.choice("ab") for _ in range(rng.choice([3, 7, 30]))) for _ in range(12))
        cuts = [0, *sorted(rng.sample(range(len(said)), 5)), len(said)]
        lines = [(a, b, a * 80, b * 80) for a, b in zip(cuts, cuts[1:], strict=False)]
        odd = [(a, a + rng.choice([-2, 0, 1, 40]), rng.choice([None, 7 * a]), rng.choice([None, 9 * a])) for a in rng.sample(range(len(said)), 6)]
        shown = [None, [], lines, [(0, len(said), 5, 6), *lines], odd, [(None, 4, 1, 2), (3, None, 1, 2), (-5, 9, 3, 4)]][i % 6]
        docs.append((i, "s", None if i == 8 else said, rng.sample(shown, len(shown)) if shown else shown))
    kind = "doc_id long, station_id string, text string, timeline array<struct<start_char:int,end_char:int,start_ms:long,end_ms:long>>"
    words = spark.createDataFrame([(0, k, w, "phrase", "substring", "[]") for k, w in enumerate(("ab", "ba", "aab", "bb a", "abab"))], "campaign_id long, keyword_id long, canonical_value string, keyword_type string, match_mode string, aliases string")
    bound = spark.createDataFrame([(0, "s")], "campaign_id long, station_id string")
    terms, owners = matching.index_terms(matching.surface_forms(words), bound), matching.entries(words, bound)
    frame = spark.createDataFrame(docs, kind)
    plain = matching.matches(frame.drop("timeline"), terms, owners).select("doc_id", "keyword_id", "start", "end").collect()
    for d, k, a, b in plain:
        over = [e for e in docs[d][3] or [] if None not in e[:2] and e[0] <= e[1] and e[0] < b and a < e[1]]
        want[d, k, a, b] = min((e[2] for e in over if e[2] is not None), default=None), max((e[3] for e in over if e[3] is not None), default=None)
    assert len(want) == len(plain) > 1000
    for most in (100_000, 2):  # of which the second takes the way by joins
        rows = matching.matches(frame, terms, owners, bound=most).collect()
        assert {(r.doc_id, r.keyword_id, r.start, r.end): (r.start_ms, r.end_ms) for r in rows} == want and len(rows) == len(want)
    # few pairs at a time
    monkeypatch.setattr(matching, "MOST_PAIRS", 3)
    lists = pa.array([None if d[3] is None else [dict(zip(("start_char", "end_char", "start_ms", "end_ms"), e, strict=True)) for e in d[3]] for d in docs], pa.list_(pa.struct([(c, pa.int64()) for c in ("start_char", "end_char", "start_ms", "end_ms")])))
    for begin in (0, 20):  # a slice of a longer column too
        hits = [h for h in want if h[0] >= begin]
        got = matching.times_of(lists[begin:], *(np.array(x) for x in ([h[0] - begin for h in hits], [h[2] for h in hits], [h[3] for h in hits])))
        assert list(zip(*(x.to_pylist() for x in got), strict=True)) == [want[h] for h in hits]


def test_lines_laid_out(spark):
    rows = spark.createDataFrame([(1, "ab\n\nc😀"), (2, None), (3, ""), (4, "\n"), (5, "x")], "id int, text string").coalesce(1)
    got = rows.select("id", text.laid_out(F.transform(F.split("text", "\n"), F.char_length)).alias("at")).collect()
    assert [[tuple(x) for x in r["at"]] for r in got] == [[(0, 2), (3, 3), (4, 6)], [], [(0, 0)], [(0, 0), (1, 1)], [(0, 1)]]
