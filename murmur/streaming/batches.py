"""Micro-batches with an effect that happens once: ledgers, keyed sinks, late rows, index versions, healing.

A streaming query may run a batch twice: the rows are the same, but clocks, newest versions and tables outside the query
may not be. So what a batch decides on is put into its ledger first, one small file a batch, and read from there when
the batch runs again; what it writes goes to the batch's own folder, replaced as a whole; and readers take the folders
of finished batches only. A batch that breaks off between writing and finishing is therefore invisible and harmless.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.operators import matching
from murmur.sources import storage
from murmur.sources.versions import Conflict, Versions

MOST_HOURS = 6


class Ledger:
    """What each batch of a query has decided and finished."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def decided(self, batch: int, decide: Callable[[], dict]) -> dict:
        """The batch's decision: the one on file, else the one made now."""
        at = f"{self.path}/decided/{batch:012d}.json"
        text = storage.read_text(self.spark, at)
        if text is None:
            facts = decide()
            if storage.create_text(self.spark, at, json.dumps(facts)):
                return facts
            text = storage.read_text(self.spark, at)
        return json.loads(text)

    def before(self, batch: int) -> dict:
        """The decision of the newest batch before one; empty before the first."""
        older = [n for n in storage.names(self.spark, f"{self.path}/decided") if n.endswith(".json") and int(n[:-5]) < batch]
        return json.loads(storage.read_text(self.spark, f"{self.path}/decided/{older[-1]}")) if older else {}

    def finish(self, batch: int, facts: dict) -> None:
        storage.create_text(self.spark, f"{self.path}/finished/{batch:012d}.json", json.dumps(facts))

    def finished(self) -> dict[int, dict]:
        return {int(n[:-5]): json.loads(storage.read_text(self.spark, f"{self.path}/finished/{n}")) for n in storage.names(self.spark, f"{self.path}/finished") if n.endswith(".json")}


class Sink:
    """Tables of a query, one folder a batch each: ``write`` replaces the batch's, ``read`` gives finished batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.ledger = Ledger(spark, f"{self.path}/ledger")

    def write(self, name: str, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch_id={batch}")

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """The rows of finished batches, with batch_id."""
        folders = [f"{self.path}/{name}/batch_id={b}" for b in self.ledger.finished()]
        whole = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
        if not folders:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/{name}").parquet(*folders)

    def run(self, stream: DataFrame, each: Callable[[DataFrame, int], dict], **trigger):
        """Starts the query: ``each`` writes a batch's tables and returns what its ledger entry says at the end."""

        def step(rows: DataFrame, batch: int) -> None:
            self.ledger.finish(batch, each(rows, batch))

        query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.path}/log").trigger(**(trigger or {"availableNow": True})).start()
        if not trigger:
            query.awaitTermination()
        return query


def admitted(sink: Sink, at: str, delay_s: float, queued_at: str | None = None, most_hours: float = MOST_HOURS, now: Column | None = None) -> Callable[[DataFrame, int], dict]:
    """Splits batches into the tables ``accepted`` and ``dead_letters`` (with ``reason``), counting both.

    Late is a row whose time ``at`` is more than ``delay_s`` before the latest time of the batches before, as it would be
    for a watermark, which drops such rows unseen. Stale is one that waited in a queue since ``queued_at`` for over
    ``most_hours``. Untimed is one without the time. The first reason that holds is given."""

    def each(rows: DataFrame, batch: int) -> dict:
        micros = F.unix_micros(F.col(at).cast("timestamp"))

        def decide() -> dict:
            latest = rows.agg(F.max(micros).alias("latest"), F.unix_micros(F.max(now if now is not None else F.current_timestamp())).alias("now")).head()
            bound = sink.ledger.before(batch).get("latest")
            known = [x for x in (latest["latest"], bound) if x is not None]
            return {"bound": bound, "latest": max(known, default=None), "now": latest["now"]}

        facts = sink.ledger.decided(batch, decide)
        reason = F.when(micros.isNull(), "untimed")
        if facts["bound"] is not None:
            reason = reason.when(micros < facts["bound"] - int(delay_s * 1e6), "late")
        if queued_at is not None and facts["now"] is not None:
            reason = reason.when(F.unix_micros(F.col(queued_at).cast("timestamp")) < facts["now"] - int(most_hours * 3600e6), "stale")
        judged = rows.withColumn("reason", reason)
        taken, refused = _counted("accepted"), _counted("refused")  # counts come with the writes, not from another pass
        sink.write("accepted", batch, judged.filter("reason IS NULL").drop("reason").observe(taken, F.count(F.lit(1)).alias("n")))
        sink.write("dead_letters", batch, judged.filter("reason IS NOT NULL").observe(refused, *[F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in ("untimed", "late", "stale")]))
        return {"accepted": taken.get["n"], **refused.get}

    return each


def _counted(name: str):
    from pyspark.sql import Observation

    return Observation(name)


def hot_matches(sink: Sink, index: Versions) -> Callable[[DataFrame, int], dict]:
    """Matches of each batch with the newest committed version of the keyword index (tables ``terms`` and ``owners``), into
    the table ``matches`` with that version. A new version is taken up by the next batch, without a restart; a batch that
    runs again takes the version that it took before."""

    def each(rows: DataFrame, batch: int) -> dict:
        version = sink.ledger.decided(batch, lambda: {"version": index.latest()})["version"]
        if not version:
            return {"version": 0, "n": 0}
        found = matching.matches(rows, index.read("terms", version), index.read("owners", version)).withColumn("version", F.lit(version).cast("long"))
        n = _counted("matches")
        sink.write("matches", batch, found.observe(n, F.count(F.lit(1)).alias("n")))
        return {"version": version, **n.get}

    return each


def outbox(sink: Sink, keys: list[str]) -> Callable[[DataFrame, int], dict]:
    """Messages to the table ``outbox``, each key once over all batches: a batch leaves out the keys that earlier finished
    batches hold, and repeats within it. A batch that runs twice, or broke off after its write, leaves one row a key."""

    def each(rows: DataFrame, batch: int) -> dict:
        sent = sink.read("outbox", rows.schema).filter(F.col("batch_id") < batch).select(*keys)
        n = _counted("outbox")
        sink.write("outbox", batch, rows.dropna(subset=keys).dropDuplicates(keys).join(sent, keys, "left_anti").observe(n, F.count(F.lit(1)).alias("n")))
        return n.get

    return each


def healed(sink: Sink, store: Versions, analyse: Callable[[DataFrame], DataFrame], most: int = 1000, tries: int = 10) -> Callable[[DataFrame, int], dict]:
    """Takes up what was left undone: each batch (of any stream that ticks) gives the newest ``most`` fallback analyses of
    ``store`` to ``analyse`` and replaces those that come back ready, and marks the mentions without a published key that
    it writes to the table ``published``. Analyses and mentions change in one version.

    Tables of the store: analyses (mention_id, status, n_tries, result), mentions (mention_id, created_at, transcript,
    result_key). ``analyse`` takes mention_id, transcript and gives mention_id, status, result. Mentions without
    transcript never heal and aren't tried; one that fails ``tries`` times isn't tried again, so it starves no other.
    A commit that another one forestalls is made again on the newer version."""

    def each(rows: DataFrame, batch: int) -> dict:
        del rows  # the tick only
        based = sink.ledger.decided(batch, lambda: {"version": store.latest()})["version"]
        if (done := _commit_of(store, sink.path, batch)) is not None:
            return done
        while True:
            analyses, mentions = store.read("analyses", based), store.read("mentions", based)
            open_ = analyses.filter((F.col("status") == "fallback") & (F.col("n_tries") < tries)).join(mentions.filter(F.trim("transcript") != ""), "mention_id")
            page = open_.orderBy(F.desc("created_at"), "mention_id").limit(most).select("mention_id", "transcript")
            # a table of its own: the answers are used twice and need not come out the same again
            sink.write("answers", batch, analyse(page))
            answers = rows_of(sink, "answers", batch)
            ready = answers.filter("status = 'ready'").select("mention_id", F.col("result").alias("new_result"))
            tried = answers.select("mention_id", F.lit(1).alias("tried"))
            next_ = analyses.join(ready, "mention_id", "left").join(tried, "mention_id", "left").select(
                "mention_id", F.when(F.col("new_result").isNotNull(), "ready").otherwise(F.col("status")).alias("status"),
                (F.col("n_tries") + F.coalesce("tried", F.lit(0))).alias("n_tries"), F.coalesce("new_result", "result").alias("result"),
            )
            unpublished = mentions.filter("result_key IS NULL").orderBy("created_at", "mention_id").limit(most)
            sink.write("published", batch, unpublished.select("mention_id", document_key("mention_id", "created_at", "metadata").alias("result_key"), "transcript"))
            keys = rows_of(sink, "published", batch).select("mention_id", F.col("result_key").alias("new_key"))
            marked = mentions.join(keys, "mention_id", "left").withColumn("result_key", F.coalesce("new_key", "result_key")).drop("new_key")
            facts = {"healed": ready.count(), "tried": answers.count(), "published": keys.count()}
            try:
                store.commit({"analyses": next_, "mentions": marked}, based, json.dumps({"sink": sink.path, "batch": batch, "facts": facts}))
            except Conflict:
                based = store.latest()
                continue
            return facts

    return each


def rows_of(sink: Sink, name: str, batch: int) -> DataFrame:
    """What a batch that goes on has written."""
    return sink.spark.read.parquet(f"{sink.path}/{name}/batch_id={batch}")


def _commit_of(store: Versions, path: str, batch: int) -> dict | None:
    """What the store's version of this batch says, if the batch got as far as its commit before it broke off."""
    for version in range(store.latest(), 0, -1):
        note = store.note(version)
        if note.get("sink") == path and note["batch"] <= batch:
            return note["facts"] if note["batch"] == batch else None
    return None


def document_key(mention_id: str, at: str, kind: str, prefix: str = "mentions/") -> Column:
    """The key of a mention's document: by day, then mention."""
    return F.concat(F.lit(prefix), F.date_format(F.col(at), "yyyy/MM/dd"), F.lit("/"), F.col(mention_id).cast("string"), F.lit(f"/{kind}.json"))
