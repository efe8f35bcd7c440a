"""Timers, late rows, index versions, outbox, healing and versioned tables, with restarts and broken batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_streaming import SCHEMA, T0, run, seg

from murmur.operators import matching
from murmur.sources.versions import Conflict, Versions
from murmur.streaming import batches, timed
from murmur.streaming import conversations as streams


@pytest.fixture
def rocks(spark):
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timed.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in held.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def arrive(spark, tmp_path, name, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")


def stream(spark, tmp_path, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def plain_timed(rows, watermarks, idle_s=60):
    """Conversations of one station by plain rules: the stream's, and idle ones once a batch's watermark allows it."""
    station, out = streams.Station(streams.Limits(), None), []
    for batch, mark in zip(rows, watermarks, strict=True):
        for r in sorted(batch, key=lambda r: (r[3], r[2])):
            us = lambda t: int((t - T0).total_seconds() * 1e6)
            out += [(x[1], x[2], x[3], x[4]) for x in station.observe(r[0], r[1], r[5] or "", [r[2], us(r[3]), us(r[4]), r[6] or 0, r[7] or ""])]
        if station.members and station.end / 1e6 + idle_s <= mark:
            out += [(x[1], x[2], x[3], x[4]) for x in station.close("a", "idle")]
    return out


@pytest.mark.usefixtures("rocks")
def test_idle_conversations_close_and_restart(spark, tmp_path):
    first = [seg("a", "s", 1, 0, 1), seg("a", "s", 2, 6), seg("b", "r", 1, 3, 1)]
    second = [seg("b", "r", n, 3 + 6 * (n - 1)) for n in range(2, 30)]  # only b goes on
    third = [seg("a", "s", 3, 200, 2), seg("a", "s", 2, 201)]
    fourth = [seg("c", "q", 1, 2000, 0)]
    path = f"{tmp_path}/out"
    arrive(spark, tmp_path, 0, first)
    assert streams.drained(timed.timed_conversations(stream(spark, tmp_path)), path).count() == 0
    arrive(spark, tmp_path, 1, second)
    got = streams.drained(timed.timed_conversations(stream(spark, tmp_path)), path).collect()
    assert [(r.station_id, r.close_reason, r.n_segments) for r in got] == [("a", "idle", 2)]
    arrive(spark, tmp_path, 2, third)
    arrive(spark, tmp_path, 3, fourth)
    got = streams.drained(timed.timed_conversations(stream(spark, tmp_path)), path).collect()
    assert sorted((r.station_id, r.session_id, r.close_reason, r.first_sequence, r.last_sequence) for r in got) == [("a", "s", "idle", 1, 2), ("a", "s", "idle", 3, 3), ("b", "r", "idle", 1, 29)]
    marks = [-49, 116, 1945, 1945]
    rows_a = [[r for r in b if r[0] == "a"] for b in (first, second, third, fourth)]
    assert sorted((r.session_id, r.close_reason, r.first_sequence, r.last_sequence) for r in got if r.station_id == "a") == sorted(plain_timed(rows_a, marks))
    # one run over all, from nothing, gives the same ids
    again = streams.drained(timed.timed_conversations(stream(spark, tmp_path)), f"{tmp_path}/again").collect()
    assert {r.conversation_id for r in again} == {r.conversation_id for r in got}


@pytest.mark.usefixtures("rocks")
def test_state_of_silent_stations_goes(spark, tmp_path):
    path = f"{tmp_path}/out"
    make = lambda: timed.timed_conversations(stream(spark, tmp_path), keep_s=100)
    arrive(spark, tmp_path, 0, [seg("a", "s", 5, 0)])
    arrive(spark, tmp_path, 1, [seg("b", "r", 1, 1000)])
    streams.drained(make(), path)
    # a's numbers are forgotten, so an old number counts again and opens a conversation, which idles out in turn
    arrive(spark, tmp_path, 2, [seg("a", "s", 4, 1010, 1), seg("b", "r", 2, 1011)])
    arrive(spark, tmp_path, 3, [seg("b", "r", 3, 3000)])
    got = streams.drained(make(), path).collect()
    assert [(r.station_id, r.first_sequence, r.close_reason) for r in got] == [("a", 4, "idle")]


@pytest.mark.usefixtures("rocks")
def test_windows_of_a_stream(spark, tmp_path):
    arrive(spark, tmp_path, 0, [seg("a", "s", n, n, n % 2, "music" if n > 4 else "speech") for n in range(9)])
    arrive(spark, tmp_path, 1, [seg("a", "s", 99, 500)])
    got = streams.drained(timed.class_windows(stream(spark, tmp_path)), f"{tmp_path}/out").collect()
    at = {(r["class"], int((r.from_at.replace(tzinfo=dt.UTC) - T0).total_seconds())): (r.n_segments, r.n_matches) for r in got}
    assert at == {("speech", 0): (3, 1), ("speech", 3): (2, 1), ("music", 3): (1, 1), ("music", 6): (3, 1)}


def test_the_stream_without_timers_is_as_before(spark, tmp_path):
    assert run(spark, tmp_path, [[seg("a", "s", 1, 0, 1)]]) == []


QUEUED = SCHEMA + ", queued_at timestamp"


def test_late_rows_are_put_aside(spark, tmp_path):
    now = T0 + dt.timedelta(hours=10)
    q = lambda row, hours=0.0: (*row, now - dt.timedelta(hours=hours))
    data = [
        [q(seg("a", "s", 1, 100)), q(seg("a", "s", 2, 0))],  # nothing is late in the first batch
        [q(seg("a", "s", 3, 130)), q(seg("a", "s", 4, 39)), q(seg("a", "s", 5, 41)), q(seg("a", "s", 6, 131), 7), q(seg("a", "s", 7, 1), 7)],
        [q((*seg("a", "s", 8, 0)[:3], None, None, "speech", 0, "x"))],
        [q(seg("a", "s", 9, 71)), q(seg("a", "s", 10, 69)), q(seg("a", "s", 11, 72), 5.9)],
    ]
    for i, rows in enumerate(data):
        arrive(spark, tmp_path, i, rows, QUEUED)
    sink = batches.Sink(spark, f"{tmp_path}/out")
    source = stream(spark, tmp_path, QUEUED)
    sink.run(source, batches.admitted(sink, "started_at", 60, "queued_at", now=F.lit(now)))
    want, latest = {}, None
    for rows in data:
        for r in rows:
            age = None if r[3] is None else (r[3] - T0).total_seconds()
            want[r[2]] = "untimed" if age is None else "late" if latest is not None and age < latest - 60 else "stale" if (now - r[8]).total_seconds() > 6 * 3600 else None
        latest = max([x for x in [latest, *((r[3] - T0).total_seconds() for r in rows if r[3] is not None)] if x is not None])
    accepted = sink.read("accepted", source.schema).collect()
    dead = sink.read("dead_letters", source.schema.add("reason", "string")).collect()
    assert {r.sequence: None for r in accepted} | {r.sequence: r.reason for r in dead} == want and len(accepted) + len(dead) == len(want)
    counts = sink.ledger.finished().values()
    assert sum(c["accepted"] for c in counts) == len(accepted) and sum(c["late"] + c["stale"] + c["untimed"] for c in counts) == len(dead)
    assert set(want.values()) == {None, "late", "stale", "untimed"}


def test_batches_that_break_off(spark, tmp_path):
    """The second batch breaks after its writes, and again after the restart; its rows and decision stay single."""
    for i in range(3):
        arrive(spark, tmp_path, i, [seg("a", "s", i, 10 * i), seg("a", "s", i, 10 * i), seg("b", "s", 0, 5)])
    sink = batches.Sink(spark, f"{tmp_path}/out")
    source, real, broken = stream(spark, tmp_path), batches.outbox(sink, ["station_id", "sequence"]), []

    def each(rows, batch):
        facts = real(rows, batch)
        if batch == 1 and len(broken) < 2:
            broken.append(batch)
            raise RuntimeError("broken off")
        return facts

    for _ in range(2):
        with pytest.raises(Exception, match="broken off"):
            sink.run(source, each)
        assert {(r.station_id, r.sequence) for r in sink.read("outbox", source.schema).collect()} == {("a", 0), ("b", 0)}
    sink.run(source, each)
    got = sink.read("outbox", source.schema).collect()
    assert sorted((r.station_id, r.sequence, r.batch_id) for r in got) == [("a", 0, 0), ("a", 1, 1), ("a", 2, 2), ("b", 0, 0)]
    assert {b: f["n"] for b, f in sink.ledger.finished().items()} == {0: 2, 1: 1, 2: 1} and len(broken) == 2


TEXTS = "doc_id long, station_id string, text string"


def _index(spark, words):
    keywords = spark.createDataFrame([(1, i, w, "brand", "tokens", None) for i, w in enumerate(words)], "campaign_id long, keyword_id long, canonical_value string, keyword_type string, match_mode string, aliases string")
    stations = spark.createDataFrame([(1, "a")], "campaign_id long, station_id string")
    return {"terms": matching.index_terms(matching.surface_forms(keywords), stations), "owners": matching.entries(keywords, stations)}


def test_index_versions_change_between_batches(spark, tmp_path):
    index = Versions(spark, f"{tmp_path}/index")
    sink = batches.Sink(spark, f"{tmp_path}/out")
    source, real, seen = stream(spark, tmp_path, TEXTS), batches.hot_matches(sink, index), []
    for i in range(3):
        arrive(spark, tmp_path, i, [(i, "a", "blue moon over red river")], TEXTS)

    def each(rows, batch):
        """Another job commits a version while the query runs; batch 1 breaks off once, after a newer version is there."""
        facts = real(rows, batch)
        seen.append((batch, facts["version"]))
        if batch == 0:
            index.commit(_index(spark, ["red river"]))
        if seen.count((1, 2)) == 1 and batch == 1:
            index.commit(_index(spark, ["moon over"]))
            raise RuntimeError("broken off")
        return facts

    index.commit(_index(spark, ["blue moon"]))
    with pytest.raises(Exception, match="broken off"):
        sink.run(source, each)
    sink.run(source, each)
    assert seen == [(0, 1), (1, 2), (1, 2), (2, 3)]
    schema = sink.spark.read.parquet(f"{tmp_path}/out/matches/batch_id=0").schema
    got = sink.read("matches", schema).collect()
    assert sorted((r.batch_id, r.version, r.matched) for r in got) == [(0, 1, "blue moon"), (1, 2, "red river"), (2, 3, "moon over")]


def test_versions_are_all_or_nothing(spark, tmp_path):
    store = Versions(spark, f"{tmp_path}/store")
    assert store.latest() == 0 and store.tables() == {}
    one = lambda x: spark.createDataFrame([(x,)], "v long")
    assert store.commit({"p": one(1), "q": one(1)}) == 1
    boom = one(2).select(F.raise_error(F.lit("no")).cast("long").alias("v"))
    with pytest.raises(Exception, match="no"):
        store.commit({"p": one(2), "q": boom})
    assert store.latest() == 1 and [store.read(t).head().v for t in "pq"] == [1, 1]
    store.commit({"p": store.read("p").withColumn("v", F.col("v") + 1)})
    assert [store.read(t).head().v for t in "pq"] == [2, 1] and store.read("p", 1).head().v == 1
    with pytest.raises(Conflict):
        store.commit({"q": one(9)}, based_on=1)
    assert [store.read(t).head().v for t in "pq"] == [2, 1]
    store.forget(2)
    assert [store.read(t).head().v for t in "pq"] == [2, 1]
    with pytest.raises(LookupError):
        store.tables(1)
    assert len(list((tmp_path / "store" / "tables").iterdir())) == 2


def test_backlog_heals(spark, tmp_path):
    store = Versions(spark, f"{tmp_path}/store")
    mentions = [(i, T0 + dt.timedelta(days=i), "" if i == 5 else f"text {i}", None if i % 3 else f"k{i}") for i in range(8)]
    analyses = [(i, "fallback" if i != 2 else "ready", 0, "grey") for i in range(8)]
    store.commit({"mentions": spark.createDataFrame(mentions, "mention_id long, created_at timestamp, transcript string, result_key string"), "analyses": spark.createDataFrame(analyses, "mention_id long, status string, n_tries int, result string")})
    for i in range(4):
        arrive(spark, tmp_path, i, [(i,)], "tick long")
    answer = lambda page: page.select("mention_id", F.when(F.col("mention_id") == 7, "fallback").otherwise("ready").alias("status"), F.concat(F.lit("about "), "transcript").alias("result"))
    sink, broken = batches.Sink(spark, f"{tmp_path}/out"), []
    real = batches.healed(sink, store, answer, most=2, tries=2)

    def each(rows, batch):
        facts = real(rows, batch)
        if batch == 1 and not broken:
            broken.append(store.latest())
            raise RuntimeError("broken off")
        return facts

    source = stream(spark, tmp_path, "tick long")
    with pytest.raises(Exception, match="broken off"):
        sink.run(source, each)
    sink.run(source, each)
    assert store.latest() == 5 and broken == [3]  # the batch that broke off after its commit made no second one
    got = {r.mention_id: (r.status, r.n_tries, r.result) for r in store.read("analyses").collect()}
    assert got[7] == ("fallback", 2, "grey") and got[5] == ("fallback", 0, "grey") and got[2] == ("ready", 0, "grey")
    assert all(got[i] == ("ready", 1, f"about text {i}") for i in (6, 4, 3, 1, 0))
    keys = {r.mention_id: r.result_key for r in store.read("mentions").collect()}
    assert keys == {i: f"k{i}" if i % 3 == 0 else f"mentions/2024/05/{1 + i:02d}/{i}/metadata.json" for i in range(8)}
    assert sum(f["healed"] for f in sink.ledger.finished().values()) == 5
