"""Changes of several tables under one version, and counters that come with the work."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from murmur.operators import changes
from murmur.sources.versions import Versions

T0 = dt.datetime(2024, 5, 1)
REQUEST = "campaign_id string, name string, monitor_from timestamp_ntz, station_ids array<bigint>, keywords array<struct<value:string,match_mode:string,keyword_type:string>>"


def store(spark, tmp_path):
    held = Versions(spark, f"{tmp_path}/store")
    held.commit({
        "campaigns": spark.createDataFrame([("a", "A", "active", T0)], "campaign_id string, name string, status string, monitor_from timestamp_ntz"),
        "campaign_stations": spark.createDataFrame([("a", 1)], "campaign_id string, station_id long"),
        "campaign_keywords": spark.createDataFrame([], "keyword_id string, campaign_id string, entity_id string, value string, match_mode string, keyword_type string, enabled boolean"),
        "meta": spark.createDataFrame([(4,)], "revision long"),
    })
    return held


def create(held, requests):
    return changes.created_campaigns(held.read("campaigns"), held.read("campaign_stations"), held.read("campaign_keywords"), held.read("meta"), requests)


def test_a_campaign_appears_whole_or_not_at_all(spark, tmp_path):
    held = store(spark, tmp_path)
    requests = spark.createDataFrame([("b", "B", T0, [2, 2, 3], [("Café", "tokens", "topic")]), ("b", "B", T0, [2, 2, 3], [("Café", "tokens", "topic")]), ("a", "new", T0, [9], []), (None, "x", T0, [], []), ("c", " ", T0, [], [])], REQUEST)
    after = create(held, requests)
    broken = after | {"campaign_keywords": after["campaign_keywords"].withColumn("value", F.raise_error(F.lit("disk full")).cast("string"))}
    with pytest.raises(Exception, match="disk full"):
        held.commit(broken)
    assert held.latest() == 1 and held.read("campaigns").count() == 1 and held.read("meta").head().revision == 4
    held.commit(after)
    assert sorted(tuple(r)[:3] for r in held.read("campaigns").collect()) == [("a", "A", "active"), ("b", "B", "active")]
    assert sorted(map(tuple, held.read("campaign_stations").collect())) == [("a", 1), ("b", 2), ("b", 3)]
    (word,) = held.read("campaign_keywords").collect()
    assert (word.campaign_id, word.value, word.enabled) == ("b", "Café", True) and held.read("meta").head().revision == 5
    held.commit(create(held, requests))  # repeated: nothing new but the revision
    assert held.read("campaigns").count() == 2 and held.read("campaign_keywords").count() == 1
    held.commit({k: v for k, v in changes.deleted_campaigns(held.read("campaigns"), {n: held.read(n) for n in ("campaign_stations", "campaign_keywords")}, spark.createDataFrame([("b",)], "campaign_id string")).items()})
    assert [held.read(n).count() for n in ("campaigns", "campaign_stations", "campaign_keywords")] == [1, 1, 0]


def test_statuses_of_sessions(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    sessions = spark.createDataFrame([(1, "x", 0, "connecting", None, None, T0)], "session_id long, station_id string, generation long, status string, last_audio_at timestamp_ntz, last_error string, started_at timestamp_ntz")
    subs = spark.createDataFrame([("x", "starting", None), ("y", "active", None), ("z", "stopped", "by hand"), ("w", "pending_capacity", None)], "station_id string, state string, state_reason string")
    reports = [(1, "x", 1, "failed", None, "boom", at(9), at(1)), (1, "x", 2, "streaming", at(2), None, at(9), at(2)), (2, "y", 0, "reconnecting", None, "", at(0), at(5)), (3, "z", 0, "streaming", None, None, at(0), at(5)), (4, "w", 0, "what", None, "e" * 400, at(0), at(5)), (None, "q", 0, "failed", None, None, at(0), at(0))]
    given = spark.createDataFrame(reports, "session_id long, station_id string, generation long, status string, last_audio_at timestamp_ntz, last_error string, started_at timestamp_ntz, reported_at timestamp_ntz")
    after = changes.session_statuses(sessions, subs, given)
    got = {r.session_id: (r.station_id, r.generation, r.status, r.last_error and len(r.last_error), r.started_at) for r in after["sessions"].collect()}
    assert got == {1: ("x", 2, "streaming", None, T0), 2: ("y", 0, "reconnecting", None, T0), 3: ("z", 0, "streaming", None, T0), 4: ("w", 0, "connecting", 300, T0)}
    assert {r.station_id: (r.state, r.state_reason) for r in after["subscriptions"].collect()} == {"x": ("active", None), "y": ("degraded", "reconnecting"), "z": ("stopped", "by hand"), "w": ("pending_capacity", None)}


def test_counters_of_a_sync_round(spark, tmp_path):
    objects = spark.createDataFrame([(f"r/{i}.json", f"e{i}", T0 + dt.timedelta(days=i)) for i in range(10)] + [("r/x.tmp", "e", T0)], "key string, etag string, modified_at timestamp_ntz")
    marks = spark.createDataFrame([("r/9.json", "e9", 7), ("r/8.json", "old", 7), ("r/7.json", "e7", 6)], "key string, etag string, revision long")
    found = spark.createDataFrame([(f"r/{i}.json", f"r/{i}.json", n, i * 1.0, T0) for i in range(10) for n in range(3)], "object_key string, source string, line long, value double, created_at timestamp_ntz")
    old = spark.createDataFrame([("r/8.json", 0, 0.0, T0), ("r/1.json", 5, 1.0, T0)], "source string, line long, value double, created_at timestamp_ntz")
    after, counters = changes.synchronised(objects, marks, old, found, F.lit(7), F.lit(T0 + dt.timedelta(days=5)), "source", ["source", "line"], ("created_at",))
    after.write.parquet(f"{tmp_path}/after")
    got = {n: o.get["n"] for n, o in counters.items()}
    # five days' objects, one of them current; three mentions each
    assert got["objects_scanned"] == 11 and got["objects_loaded"] == 4 and got["mentions_seen"] == 12 and got["mentions"] == 13
    assert spark.read.parquet(f"{tmp_path}/after").count() == 13
