from murmur.functions.content import classified
from murmur.plans import registry

CASES = [
    (None, "speech", "unknown", 0.0),
    ("", None, "unknown", 0.0),
    ("Take shelter: tornado warning!", "music", "emergency_alert", 0.9),
    ("Call now and save 20% today", "singing", "advertisement", 0.75),
    ("la la la la la la la la la la la la", "singing", "song_lyrics", 0.75),
    ("a quiet song", "music", "song_lyrics", 0.55),
    ("Radio 98.3", "speech", "station_identification", 0.6),
    ("hello there", "speech", "unknown", 0.2),
    ("officials said that according to nobody", "speech", "news", 0.74),
    ("this is what happened when the two of us went down to the old river bank", "speech", "discussion", 0.4),
    ("Amazon is a river in Peru", "speech", "unknown", 0.25),
    ("word " * 60, None, "discussion", 0.35),
    ("headlines and my guest are coming", "speech", "news", 0.62),
    ("आज ही खबर पढ़ें मित्रों", "speech", "advertisement", 0.62),
    ("it costs $ 5 only here", "speech_over_music", "advertisement", 0.74),
]


def test_ladder(spark):
    rows = spark.createDataFrame([(i, t, a) for i, (t, a, _, _) in enumerate(CASES)], "i long, text string, audio_class string")
    got = [(r.content_type, r.confidence) for r in classified(rows).orderBy("i").collect()]
    assert got == [(k, p) for _, _, k, p in CASES]


def test_query(spark):
    got = registry.queries()["content_types"](spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "audio_class", "content_type", "confidence"]
    assert got.count() == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
