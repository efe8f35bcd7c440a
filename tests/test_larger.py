"""What shows on larger tables only: rows of odd keys, texts and sizes made small."""

import random
import shutil
import time

import compare
from pyspark.sql import functions as F

from murmur.functions import text
from murmur.operators import matching, records, transcripts
from murmur.plans import matching as plans
from murmur.plans import registry
from murmur.sources.views import Views

SOURCE = "/root/testdata/sf0.001"


def folder_with(spark, at, name, rows):
    """The small tables, one of them with other rows."""
    shutil.copytree(SOURCE, at)
    made = spark.read.parquet(f"{SOURCE}/{name}.parquet")
    rows(made).toPandas().to_parquet(f"{at}/{name}.parquet", index=False, coerce_timestamps="us")
    return str(at)


def held(spark, name, folder):
    got, want = compare.both(spark, registry.queries()[name], registry.oracle_sql()[name], folder)
    assert got == want and got


def test_sessions_of_very_many_runs(spark):
    """20,000 runs: a call of Python a run took minutes (325 s for those of sf0.1)."""
    n = 60_000
    docs = spark.range(n).select((F.col("id") % 100).alias("station_id"), F.col("id").alias("key"), F.timestamp_seconds((F.col("id") / 300).cast("long") * 10_000 + F.col("id") % 300 / 100).alias("started_at")).withColumn("ended_at", F.col("started_at") + F.expr("INTERVAL 5 SECONDS"))
    began = time.time()
    got = transcripts.limits(docs, docs.select("key"), 100, 1000)
    assert got.filter("n = 3 AND hi - lo = 2").count() == n
    assert time.time() - began < 30


def test_sessions_against_plain_growth(spark):
    """Documents of all lengths, runs across batches of the task: limits and what is told of a session."""
    rng, rows = random.Random(5), []
    for i in range(3000):
        a = rng.randrange(20_000)
        rows.append((rng.choice(["x", "y", None]), f"k{i:05}" if i % 3 else f"a{i}", a, a + rng.choice([1, 5, 40, 900])))
    rows.append(("x", "late", 900_000, 900_001))
    docs = spark.createDataFrame(rows, "station_id string, key string, s long, e long").select("station_id", "key", F.timestamp_seconds("s").alias("started_at"), F.timestamp_seconds("e").alias("ended_at"))
    want = {}
    for station in ("x", "y"):
        run, runs = [], []
        for r in sorted((r for r in rows if r[0] == station), key=lambda r: (r[2], r[1])):
            if run and r[2] - run[-1][3] > 3:
                runs.append(run)
                run = []
            run.append(r)
        for run in [*runs, run]:
            for at, r in enumerate(run):
                lo, hi = at, at
                while lo > 0 and r[3] - run[lo - 1][2] <= 600:
                    lo -= 1
                while hi + 1 < len(run) and run[hi + 1][3] - run[lo][2] <= 600:
                    hi += 1
                want[r[1]] = [x[1] for x in run[lo : hi + 1]], max(x[3] for x in run[lo : hi + 1])
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        told = transcripts.limits(docs, docs.select("key"), 3, 600).select("anchor", "n", "first_key", F.unix_seconds("last_at").alias("last")).collect()
        members = transcripts.around(docs, docs.select("key").limit(200), 3, 600).groupBy("anchor").agg(F.array_sort(F.collect_list("key")).alias("keys")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert {r.anchor: (r.n, r.first_key, r["last"]) for r in told} == {k: (len(v), min(v), e) for k, (v, e) in want.items()}
    assert members and all(r["keys"] == sorted(want[r.anchor][0]) for r in members)


def test_due_scans_with_a_station_of_every_number(spark, tmp_path):
    """A station 9999 exists in larger tables; the bindings to an unknown one must not meet it."""
    held(spark, "due_scans", folder_with(spark, tmp_path / "t", "events", lambda t: t.withColumn("user_id", F.when(F.col("event_id") % 50 == 0, 9999).otherwise(F.col("user_id")).cast("long"))))


def test_verdicts_of_words_whose_capitals_are_longer(spark, tmp_path):
    """A sharp s has a capital of its own in SQL; it meets the small one and its double."""
    words = F.element_at(F.array(*map(F.lit, ("große Worte", "GROẞE Worte", "ﬁne words", "ŉ abc", "übermäßig ß", "plain"))), (F.col("doc_id") % 6 + 1).cast("int"))
    held(spark, "match_verdicts", folder_with(spark, tmp_path / "t", "documents", lambda t: t.withColumn("text", words)))
    one = spark.range(1).select(*[F.contains(records.folded(F.lit("Die große Straße")), records.folded(F.lit(x))).alias(x) for x in ("GROẞE", "grosse", "STRASSE")]).head()
    assert all(one)


def test_matches_are_not_shuffled(spark):
    """A document's matches are decided where it is scanned; the way for large indexes shuffles each hit and more."""
    found = plans.keyword_matches(Views(spark, SOURCE))
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_matches_decided_in_the_scan_and_by_joins(spark):
    """Forms of two letters that overlap and repeat, and words one edit away, found both ways."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    aliases = lambda: "[" + ",".join(f'{{"value": "{word(rng.choice([2, 3, 7]))}", "kind": "{rng.choice([*matching.LEVELS, "odd"])}", "language": "{rng.choice(["", "de", "fr"])}"}}' for _ in range(4)) + "]"
    words = spark.createDataFrame([(k % 3, k, word(rng.choice([2, 4, 7])), rng.choice(plans.KINDS), rng.choice(["tokens", "substring"]), aliases()) for k in range(12)], "campaign_id long, keyword_id long, canonical_value string, keyword_type string, match_mode string, aliases string")
    bound = spark.createDataFrame([(0, "s"), (1, "s"), (1, "t"), (2, "t")], "campaign_id long, station_id string")
    docs = spark.createDataFrame([(i, rng.choice(["s", "t", "none", None]), " ".join(word(rng.choice([3, 7, 30])) for _ in range(12))) for i in range(80)] + [(99, "s", None)], "doc_id long, station_id string, text string")
    terms, owners = matching.index_terms(matching.surface_forms(words), bound), matching.entries(words, bound)
    for fuzzy in (False, True):
        rows = [sorted(map(repr, matching.matches(docs, terms, owners, fuzzy, bound=b).collect())) for b in (100_000, 60)]
        assert rows[0] == rows[1] and len(rows[0]) > 500 and (not fuzzy or any("fuzzy" in r for r in rows[0]))


def test_spans_take_one_text_of_a_batch_at_a_time(spark):
    """Arrow functions (250), not pandas ones (200), which make strings of all texts of a batch; nulls and wide characters."""
    rows = spark.createDataFrame([("One 😀 two. Big Words here! Last", "big words"), (None, "x"), ("none here", "zz"), ("a", None)], "text string, phrase string")
    found = rows.select("text", *[text.spans(F.col("text"), F.col("phrase"), how).alias(how) for how in ("exact", "normal", "highlight")])
    found = found.select("exact", "normal", "highlight", text.sentences(F.col("text"), F.col("highlight.start"), F.col("highlight.end")).alias("sentence"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "], 250" in plan and "], 200" not in plan
    got = [tuple(r) for r in found.collect()]
    none = (None,) * 4
    assert got == [((11, 20), (11, 20), (11, 20), "Big Words here!"), none, ((None, None), (None, None), (None, None), None), none]


def test_word_highlights_move_texts_and_few_words(spark):
    """Documents are shuffled, not a row a word; only words near a span are paired (173 MB at sf0.1 before, 21 after)."""
    docs, n = 40, 5000
    words = spark.range(docs * n).select((F.col("id") / n).cast("long").alias("doc_id"), (F.col("id") % n * 5).alias("start_char"), (F.col("id") % n * 5 + 4).alias("end_char"), (F.col("id") % n * 300).alias("started_at"), F.when(F.col("id") % 7 != 0, F.col("id") % n * 300 + 300).alias("ended_at"))
    spans = spark.range(docs).select(F.col("id").alias("doc_id"), F.explode(F.array(F.struct(F.lit(0).alias("span_id"), F.lit(2000).alias("from_at"), F.lit(5000).alias("to_at")), F.struct(F.lit(1).alias("span_id"), F.lit(901).alias("from_at"), F.lit(None).cast("int").alias("to_at")))).alias("s")).select("doc_id", "s.*")
    got = {(r.doc_id, r.span_id): tuple(r)[2:] for r in transcripts.words_of_span(words, spans).collect()}
    want = {}
    for r in words.collect():
        end = r.started_at if r.ended_at is None else r.ended_at
        for span, a, b in ((0, 2000, 5000), (1, 901, 901)):
            if end >= a and r.started_at <= b:
                s, e, k = want.get((r.doc_id, span), (r.start_char, r.end_char, 0))
                want[r.doc_id, span] = min(s, r.start_char), max(e, r.end_char), k + 1
    assert got == want and len(want) > docs
    plan = registry.queries()["word_highlights"](spark, SOURCE)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan and "_least" in plan
