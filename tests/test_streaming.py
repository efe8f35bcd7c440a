"""Stream conversations against worked cases, keyed table changes, messages and documents."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from murmur.operators import tables
from murmur.plans import registry
from murmur.sources import documents
from murmur.streaming import conversations as streams

SCHEMA = "station_id string, session_id string, sequence long, started_at timestamp, ended_at timestamp, class string, n_matches long, text string"
T0 = dt.datetime(2024, 5, 1, tzinfo=dt.UTC)


def seg(station, session, n, start, matches=0, kind="speech", text=None, length=5):
    at = T0 + dt.timedelta(seconds=start)
    return (station, session, n, at, at + dt.timedelta(seconds=length), kind, matches, text if text is not None else f"t{n}")


def run(spark, tmp_path, batches, limits=None):
    limits = limits or streams.Limits()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    return streams.drained(streams.conversations(stream, limits), f"{tmp_path}/out").orderBy("station_id", "started_us").collect()


def test_closing_and_look_back(spark, tmp_path):
    first = [seg("a", "s", 1, 0), seg("a", "s", 2, 40), seg("a", "s", 3, 46, 1), seg("a", "s", 5, 52, text="  "), seg("a", "s", 5, 52)]
    second = [seg("a", "s", 6, 69, kind="music"), seg("a", "s", 7, 75, 2), seg("a", "r", 1, 81, 1, text=None), seg("a", "r", 2, 98), (None, "r", 3, T0, T0, None, 1, None)]
    got = run(spark, tmp_path, [first, second])
    short = [(r.session_id, r.close_reason, r.first_sequence, r.last_sequence, r.n_segments, r.n_matches, r.missing, r.text) for r in got]
    assert short == [
        ("s", "music", 2, 5, 3, 1, [4], "t2 t3"),
        ("s", "disconnect", 6, 7, 2, 2, [], "t6 t7"),
        ("r", "silence", 1, 1, 1, 1, [], "t1"),
    ]
    assert [r.conversation_id for r in got] == [str(uuid.uuid5(uuid.UUID(streams.NAMESPACE), f"{r.session_id}:{r.first_sequence}")) for r in got]


def test_longest(spark, tmp_path):
    rows = [seg("a", "s", n, 6 * n, 1 if n == 0 else 0) for n in range(6)]
    assert [(r.close_reason, r.n_segments) for r in run(spark, tmp_path, [rows], streams.Limits(most_segments=4))] == [("max_duration", 4)]


def test_wide_gaps(spark, tmp_path):
    """Numbers far apart are a gap in state and sink, not a list of 2,000,000,000,000 (executor memory ran out)."""
    far = 1_000_000_000_000
    rows = [seg("a", "s", 1, 0, 1), seg("a", "s", 3, 6), seg("a", "s", far, 12), seg("a", "s", 2 * far, 18), seg("a", "s", 2 * far + 1, 60)]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = streams.drained(streams.closed(stream), f"{tmp_path}/out")
    assert [[tuple(g) for g in r.gaps] for r in got.collect()] == [[(2, 2), (4, far - 1), (far + 1, 2 * far - 1)]]
    assert streams.Station(streams.Limits(), ("s", 7, 9, "[3, 5]", "[]", "[]")).missing == [[3, 3], [5, 5]]
    few = spark.createDataFrame([([(2, 2), (4, 6)],), ([],)], "gaps array<struct<first:long,last:long>>")
    assert [r.missing for r in streams.spelled(few).collect()] == [[2, 4, 5, 6], []]


def test_conversation_stream_query(spark):
    folder = "/root/testdata/sf0.01"
    got = {(int(r.station_id), r.first_sequence): (r.last_sequence, r.close_reason, r.n_segments, r.n_matches) for r in registry.queries()["conversation_stream"](spark, folder).collect()}
    gap, wanted, by = 2 * registry.GAP_S, {}, {}
    for r in spark.read.parquet(f"{folder}/events.parquet").orderBy("event_id").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).collect():
        by.setdefault(r.user_id, []).append((r.event_id, r.us / 1e6, r.event_type == "purchase"))
    for user, rows in by.items():
        free = 0  # the first row that no conversation holds
        while (opener := next((i for i in range(free, len(rows)) if rows[i][2]), None)) is not None:
            a = min([j for j in range(max(free, opener - 40), opener) if rows[j][1] + 5 >= rows[opener][1] - gap], default=opener)
            long = next((j for j in range(opener, len(rows)) if rows[j][1] + 5 - rows[a][1] >= 10 * 2 * registry.GAP_S or j - a + 1 >= 200), len(rows))
            pause = next((j for j in range(opener, len(rows) - 1) if rows[j + 1][1] - rows[j][1] - 5 >= gap), len(rows))
            b = min(long, pause)
            if b == len(rows):
                break
            wanted[(user, rows[a][0])] = (rows[b][0], "max_duration" if long <= pause else "silence", b - a + 1, sum(m for _, _, m in rows[a : b + 1]))
            free = b + 1
    assert wanted and got == wanted


def test_tables(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k long, v string, made long")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 9)], "k long, v string, made long")
    assert sorted(map(tuple, tables.upserted(old, new, ["k"], ("made",)).collect())) == [(1, "a", 5), (2, None, 6), (3, "c", 9)]
    assert sorted(map(tuple, tables.inserted(old, new.union(new), ["k"]).collect())) == [(1, "a", 5), (2, "b", 6), (3, "c", 9)]
    assert sorted(r.k for r in tables.cascaded(old, new, "k").collect()) == [1]
    assert sorted(map(tuple, tables.children_replaced(old, new, "k").collect()), key=repr) == [(1, "a", 5), (2, None, 9), (3, "c", 9)]
    sends = spark.createDataFrame([(1, 9, "pending"), (2, 0, "pending"), (3, 0, "pending")], "k long, n_attempts long, status string")
    outcome = spark.createDataFrame([(1, False), (2, True)], "k long, sent boolean")
    assert sorted(map(tuple, tables.attempts(sends, outcome, "k").collect())) == [(1, 10, "failed"), (2, 1, "sent"), (3, 0, "pending")]


def test_messages_and_documents(spark, tmp_path):
    bodies = ['{"schema": "job.v1", "id": "7"}', '{"schema": "other", "id": "7"}', '{"schema": "job.v1"}', "[1]", "broken", None, '{"schema": "job.v1", "id": "' + "x" * 70_000 + '"}']
    got = documents.parsed(spark.createDataFrame([(b,) for b in bodies], "body string"), "body", "schema string, id string", ["id"], ("job.v1",)).collect()
    assert [r.refused for r in got] == [None, "unknown schema", "no id", "not an object", "not an object", "empty", "too large"]
    assert got[0].message.id == "7" and got[1].message is None
    rows = spark.createDataFrame([(1, T0), (2, T0 + dt.timedelta(days=1))], "id long, at timestamp")
    documents.write_documents(rows, F.col("at"), f"{tmp_path}/docs")
    documents.write_documents(rows.filter("id = 2").withColumn("id", F.lit(3).cast("long")), F.col("at"), f"{tmp_path}/docs")
    (tmp_path / "docs" / "bad.json").write_text("{ nothing")
    from pyspark.sql import types as T

    read = documents.json_documents(spark, f"{tmp_path}/docs", T.StructType([T.StructField("id", T.LongType())]))
    assert sorted(r.id for r in read.collect()) == [1, 3]


def test_send_once(spark, tmp_path):
    rows = spark.createDataFrame([("q", "a", T0), ("q", "a", T0 + dt.timedelta(seconds=10)), ("q", "b", T0)], "queue string, dedup_id string, sent_at timestamp")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = streams.drained(streams.send_once(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out")
    assert sorted(r.dedup_id for r in got.collect()) == ["a", "b"]
