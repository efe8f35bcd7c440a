"""Listings against a plain walk, documents put twice and by failing tasks, archives good and broken."""

import datetime as dt
import hashlib
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from murmur.sources import archive, objects

T0 = dt.datetime(2024, 5, 1, 12, tzinfo=dt.UTC)


def tree(root):
    for i, key in enumerate(["top.json", "a/one.json", "a/x/two.json", "a/x/y/z/three.json", "a/x/y/z/skip.txt", "b/four.json", "b/x/five.json", "raw/s1/k.wav", "raw/s2/d/k.json", "a/_part/no.json", "_book/no.json"]):
        at = root / key
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x" * i)
        os.utime(at, (T0.timestamp() + 60 * i, T0.timestamp() + 60 * i))


def walk(root):
    for folder, _, names in os.walk(root):
        for n in names:
            key = os.path.relpath(os.path.join(folder, n), root)
            if not any(p.startswith("_") for p in key.split("/")):
                yield key, os.path.getsize(os.path.join(root, key)), dt.datetime.fromtimestamp(os.path.getmtime(os.path.join(root, key)), dt.UTC)


def test_listing_against_a_walk(spark, tmp_path):
    tree(tmp_path)
    listed = objects.listing(spark, str(tmp_path))
    every = sorted(walk(tmp_path))
    utc = lambda r: (r.key, r.size, r.modified_at.replace(tzinfo=dt.UTC))
    assert sorted(utc(r) for r in listed.collect()) == every and len(every) == 9
    late = T0 + dt.timedelta(minutes=2)
    cases = [
        (F.col("key").endswith(".json"), lambda k, s, t: k.endswith(".json")),
        (F.col("key").startswith("a/x"), lambda k, s, t: k.startswith("a/x")),
        (F.col("key") == "b/x/five.json", lambda k, s, t: k == "b/x/five.json"),
        (F.col("modified_at") >= F.lit(late), lambda k, s, t: t >= late),
        (F.col("key").startswith("a/") & F.col("key").endswith(".json") & (F.col("modified_at") < F.lit(late)) & (F.col("size") > 0), lambda k, s, t: k.startswith("a/") and k.endswith(".json") and t < late and s > 0),
    ]
    for condition, plain in cases:
        assert sorted(utc(r) for r in listed.filter(condition).collect()) == [r for r in every if plain(*r)], condition
    assert objects.listing(spark, str(tmp_path / "absent")).count() == 0
    newest = objects.result_objects(listed, "a/", F.lit(T0), 2).collect()
    assert [r.key for r in newest] == ["a/x/y/z/three.json", "a/x/two.json"]
    assert sorted(r.station_id for r in objects.station_ids(listed, "raw/").collect()) == ["s1", "s2"]


def test_filters_reach_the_listing(spark, tmp_path):
    tree(tmp_path)
    rows = objects.listing(spark, str(tmp_path)).filter(F.col("key").startswith("b/") & F.col("key").endswith(".json"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan objects" in plan and not any(x in plan for x in ("StartsWith", "EndsWith", "LIKE", "Filter ")), plan  # nothing is left to filter
    rows = objects.listing(spark, str(tmp_path)).filter((F.col("modified_at") >= F.lit(T0)) & (F.col("size") > 3))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "size" in plan.split("Filter")[1].split("\n")[0] and ">= " not in plan.split("Filter")[1].split("\n")[0], plan
    reader = objects._Listing(str(tmp_path))
    left = list(reader.pushFilters([objects.StringStartsWith(("key",), "b/"), objects.StringEndsWith(("key",), ".json"), objects.GreaterThan(("size",), 3)]))
    assert len(left) == 1
    assert {os.path.relpath(p.path, tmp_path) for p in reader.partitions()} == {".", "b", "b/x"}


def rows_of(spark, n):
    return spark.range(n).select(F.concat(F.lit("m/"), F.col("id") % 7, F.lit("/"), "id", F.lit(".json")).alias("key"), F.to_json(F.struct("id")).alias("body")).repartition(4)


def held(root):
    return {k: (root / k).read_text() for k, _, _ in walk(root)}


def test_documents_are_put_once(spark, tmp_path):
    rows = rows_of(spark, 100).unionByName(spark.createDataFrame([(None, "x"), ("m/none", None)], "key string, body string"))
    want = {f"m/{i % 7}/{i}.json": json.dumps({"id": i}, separators=(",", ":")) for i in range(100)}
    for _ in range(2):  # a rerun puts the same bytes at the same keys
        objects.publish(rows, str(tmp_path))
        assert held(tmp_path) == want
    known = {r.key: r.sha256 for r in objects.published(spark, str(tmp_path)).collect()}
    assert known == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
    assert objects.published(spark, str(tmp_path)).count() == 100


def test_a_write_that_fails(spark, tmp_path):
    """A task that fails part of the way leaves no half documents and no known ones; the rerun leaves exactly all."""
    objects.publish(rows_of(spark, 3), str(tmp_path))
    bad = rows_of(spark, 100).coalesce(1).withColumn("body", F.when(F.col("key") == "m/6/55.json", F.raise_error(F.lit("no such body"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="no such body"):
        objects.publish(bad, str(tmp_path))
    whole = {f"m/{i % 7}/{i}.json": json.dumps({"id": i}, separators=(",", ":")) for i in range(100)}
    assert all(whole[k] == v for k, v in held(tmp_path).items())
    assert objects.published(spark, str(tmp_path)).count() == 3
    objects.publish(rows_of(spark, 100), str(tmp_path))
    assert held(tmp_path) == whole and objects.published(spark, str(tmp_path)).count() == 100
    for key in ("../out.json", "/abs.json", "a/../../b", "_documents/lists/x.json"):
        with pytest.raises(Exception, match="no key under the root"):
            objects.publish(spark.createDataFrame([(key, "x")], "key string, body string"), str(tmp_path))


def test_mention_and_audit_documents(spark, tmp_path):
    schema = "mention_id string, conversation_id string, station_id string, station_name string, content_type string, detected_language string, started_at timestamp, ended_at timestamp, close_reason string, campaign_ids array<long>, keyword_ids array<string>, evidence_key string, text string, missing array<long>, segments array<struct<segment_id:string,text:string>>, matches array<struct<keyword_id:string,start_char:int>>, analysis string"
    one = ("m1", "c1", "s", "Köln", "news", None, T0, T0 + dt.timedelta(seconds=90), "silence", [2, 1], ["k"], None, "ein Wort", [4], [("g", "ein Wort")], [("k", 4)], '{"status": "ready"}')
    rows = spark.createDataFrame([one, one], schema)
    objects.publish(objects.keyed(objects.mention_documents(rows)), str(tmp_path))
    got = {k: json.loads(v) for k, v in held(tmp_path).items()}
    base = "mentions/2024/05/01/m1/"
    assert sorted(got) == [base + n for n in ("analysis.json", "metadata.json", "transcript.json")]
    meta = got[base + "metadata.json"]
    assert list(meta) == sorted(meta) and meta["duration_ms"] == 90_000 and meta["evidence_storage_key"] is None and meta["station_name"] == "Köln" and meta["broadcast_start_utc"] == "2024-05-01T12:00:00.000000Z" and meta["campaign_ids"] == [2, 1]
    assert got[base + "transcript.json"]["segments"] == [{"segment_id": "g", "text": "ein Wort"}] and got[base + "transcript.json"]["missing_sequences"] == [4]
    scans = spark.createDataFrame([(7, "g/1", "s", T0, "yes")], "keyword_id long, group_key string, station_id string, scanned_at timestamp, verdict string")
    (audit,) = objects.audit_documents(scans).collect()
    assert audit.key == f"semantic/s/2024/05/01/{hashlib.sha256(b'7|g/1').hexdigest()[:20]}.semantic.json" and json.loads(audit.body)["verdict"] == "yes"


def packed(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members:
            z.writestr(name, body)


def station(n, **more):
    return {"stationuuid": f"0000000{n}-0000-4000-8000-00000000000{n}", "name": f"N{n}", "url": "http://x.org/s", "countrycode": "de", "tags": "Pop, ,Rock", "languagecodes": "DE,en"} | more


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_archives(spark, tmp_path):
    top = "radio-database-main/"
    packed(tmp_path / "a.zip", [
        (top + "src/one.json", json.dumps([station(2), station(1, homepage="ftp://no", geo_lat=1.5, iso_3166_2=" DE-BY "), station(2, name="again"), 5, station(3, name=" "), station(4, url="file:///x"), station(5, countrycode="deu")])),
        (top + "src/x/two.json", json.dumps([{"stationuuid": "{00000009-0000-4000-8000-000000000009}", "delete": True}, {"stationuuid": "Odd", "delete": "TRUE"}, {"stationuuid": "z", "delete": "no"}, {"delete": True}, station(6, geo_long="west")])),
        (top + "src/broken.json", "[{"),
        (top + "src/object.json", "{}"),
        (top + "src/large.json", "[" + " " * 5000 + "]"),
        (top + "doc/other.json", "[1]"),
    ])
    packed(tmp_path / "evil.zip", [("ok/src/a.json", json.dumps([station(7)])), ("../src/b.json", "[]")])
    packed(tmp_path / "twice.zip", [("t/src/a.json", json.dumps([station(8)])), ("t/src/a.json", json.dumps([station(8)]))])
    (tmp_path / "no.zip").write_bytes(b"PK nothing")
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("r/src/a.json", json.dumps([station(8)]))
    data = bytearray(whole.getvalue())
    data[60] ^= 255  # the member's checksum is wrong now
    (tmp_path / "torn.zip").write_bytes(bytes(data))
    rows = archive.records(spark, str(tmp_path), most=3000)
    overrides, deletions, refused = archive.overlay(rows)
    got = overrides.collect()
    assert [(r.name, r.country_code, r.tags, r.language_codes, r.homepage, r.geo_lat, r.iso_3166_2) for r in got] == [("N1", "DE", ["Pop", "Rock"], ["de", "en"], "", 1.5, "DE-BY"), ("N2", "DE", ["Pop", "Rock"], ["de", "en"], "", None, None), ("N8", "DE", ["Pop", "Rock"], ["de", "en"], "", None, None)]
    assert [r.station_uuid for r in deletions.collect()] == ["00000009-0000-4000-8000-000000000009", "odd"]
    why = sorted((os.path.basename(r.archive), r.refused) for r in refused.collect())
    assert why == sorted([("a.zip", x) for x in ("repeated station", "not an object", "no name", "no address", "no country", "unclear delete", "no station", "no coordinate", "broken member", "not an array", "too large")] + [("evil.zip", "unsafe name"), ("twice.zip", "repeated member"), ("torn.zip", "broken member"), ("no.zip", "no archive: File is not a zip file")])
    refs = {os.path.basename(r.archive): r.ref for r in archive.snapshot_ref(rows).collect()}
    assert refs["a.zip"] == "main" and refs["twice.zip"] is None
