"""Incremental ingest of result objects: what changed, what a new result replaces, which bindings a mention belongs to.

Nulls: an object without key is no object; a mention without a readable time, or without a binding, is not attributed;
an etag that is null differs from every stored one, so its object is read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("positive", "neutral", "negative")


def changed(objects: DataFrame, watermarks: DataFrame, revision: Column, since: Column, most: int = 1000) -> DataFrame:
    """JSON objects since a time that no watermark covers, the newest first, ``most`` at most. objects: key, etag,
    modified_at; watermarks: key, etag, revision."""
    current = watermarks.filter(F.col("revision") == revision).select("key", "etag")
    fresh = objects.filter(F.col("key").endswith(".json") & (F.col("modified_at") >= since)).orderBy(F.desc("modified_at"), "key").limit(most)
    return fresh.join(current, ["key", "etag"], "left_anti")


def scans_due(groups: DataFrame, bindings: DataFrame, done: DataFrame, revision: Column) -> DataFrame:
    """Keywords and groups to scan: none with the same fingerprint and revision that didn't end in an error. groups:
    group_key, station_id, fingerprint; bindings: keyword_id, station_ids; done: keyword_id, group_key, fingerprint,
    revision, status."""
    wanted = bindings.select("keyword_id", F.explode("station_ids").alias("station_id")).distinct().join(groups, "station_id")
    kept = done.filter((F.col("status") != "error") & (F.col("revision") == revision)).select("keyword_id", "group_key", "fingerprint")
    return wanted.join(kept, ["keyword_id", "group_key", "fingerprint"], "left_anti")


def replaced_by_source(old: DataFrame, new: DataFrame, sources: DataFrame, source: str, keys: list[str], keep: tuple[str, ...]) -> DataFrame:
    """``old`` without the rows of the sources that were read again, and their ``new`` rows; ``keep`` columns of a row whose
    keys were there before stay as they were."""
    first = old.groupBy(*keys).agg(*[F.min(c).alias(f"was_{c}") for c in keep])
    read = new.dropDuplicates(keys).join(first, keys, "left")
    read = read.withColumns({c: F.coalesce(f"was_{c}", c) for c in keep}).select(old.columns)
    rest = old.join(sources.select(source).distinct(), source, "left_anti")
    return rest.join(read.select(*keys), keys, "left_anti").select(old.columns).unionByName(read)


def last_wins(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Memos by key: the latest by ``order`` stays, of equals the new one."""
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*old.columns), F.struct(order, "is_new")).alias("b"))
    return best.select("b.*")


def object_key(uri: Column, bucket: str) -> Column:
    """The key of an object address in the bucket; null for another bucket, scheme or a bare bucket."""
    key = F.regexp_extract(uri, rf"^s3://{bucket}/(.+)$", 1)
    return F.nullif(key, F.lit(""))


def allowed_audio(key: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a key lies under one of the prefixes and is no directory."""
    under = F.lit(False)
    for p in prefixes:
        under = under | key.startswith(p)
    return F.coalesce(under & ~key.endswith("/"), F.lit(False))


def instant(text: Column) -> Column:
    """An ISO time: with zone, or UTC where none is given; null if it can't be read."""
    zoned = F.trim(text).rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(zoned, F.try_to_timestamp(F.trim(text))).otherwise(F.try_to_timestamp(F.concat(F.trim(text), F.lit("Z"))))


def mention_ids(given: Column, *parts: Column) -> Column:
    """The source's own id, else 32 digits of a hash of the parts."""
    made = F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), made)


def bound(mentions: DataFrame, bindings: DataFrame) -> DataFrame:
    """Mentions with their bindings: those of the entity id; only where it has none, those of an alias' normal form; each
    keyword once, and only for its own stations. mentions: id, station_id, entity_id, names (array of normal forms);
    bindings: keyword_id, campaign_id, entity_id, aliases (array of normal forms), station_ids."""
    own = bindings.select("keyword_id", "campaign_id", "station_ids", "entity_id", "aliases")
    by_entity = mentions.join(own.drop("aliases"), "entity_id").select("id", "station_id", "keyword_id", "campaign_id", "station_ids")
    rest = mentions.join(by_entity.select("id").distinct(), "id", "left_anti")
    named = rest.select("id", "station_id", F.explode(F.array_distinct("names")).alias("alias")).filter("alias <> ''")
    by_alias = named.join(own.select("keyword_id", "campaign_id", "station_ids", F.explode(F.array_distinct("aliases")).alias("alias")), "alias").select("id", "station_id", "keyword_id", "campaign_id", "station_ids")
    both = by_entity.unionByName(by_alias).filter(F.array_contains("station_ids", F.col("station_id")))
    return both.groupBy("id", "station_id", "keyword_id").agg(F.min("campaign_id").alias("campaign_id"))


def attributed(rows: DataFrame, bucket: str, prefixes: tuple[str, ...]) -> DataFrame:
    """Rows that may be kept: not before monitoring began, a clip that doesn't end before it starts, and an allowed audio
    object. rows: start_text, end_text, clip_start_text, clip_end_text, monitor_from, audio_uri, label."""
    start, end = F.coalesce(instant(F.col("start_text")), instant(F.col("clip_start_text"))), F.coalesce(instant(F.col("end_text")), instant(F.col("clip_end_text")))
    rows = rows.withColumns({"started_at": start, "ended_at": end})
    rows = rows.withColumns({"clip_start": F.coalesce(instant(F.col("clip_start_text")), "started_at"), "clip_end": F.coalesce(instant(F.col("clip_end_text")), "ended_at", "started_at"), "audio_key": object_key(F.col("audio_uri"), bucket)})
    kept = rows.filter((F.col("started_at") >= F.col("monitor_from")) & (F.col("clip_end") >= F.col("clip_start")) & allowed_audio(F.col("audio_key"), prefixes))
    mood = F.lower(F.coalesce("label", F.lit("neutral")))
    return kept.withColumn("label", F.when(mood.isin(*LABELS), mood).otherwise("neutral"))


def overlaid(mentions: DataFrame, stations: DataFrame) -> DataFrame:
    """Mentions with their station's name and country; an unknown station has its own id as name and no languages."""
    both = mentions.join(stations.select("station_id", F.col("name").alias("known"), "country_code", "language_codes"), "station_id", "left")
    return both.withColumn("station_name", F.coalesce("known", "station_name", "station_id")).withColumn("language_codes", F.coalesce("language_codes", F.array().cast("array<string>"))).drop("known")


def next_revision(meta: DataFrame) -> DataFrame:
    """The revision counter after one change: every watermark of an older revision is void then."""
    return meta.agg((F.coalesce(F.max("revision"), F.lit(0)) + 1).alias("revision"))


def newest_version(indexes: DataFrame) -> DataFrame:
    """The latest index of each station. indexes: station_id, version, fingerprint."""
    place = Window.partitionBy("station_id").orderBy(F.desc("version"))
    return indexes.withColumn("place", F.row_number().over(place)).filter("place = 1").drop("place")


def published(indexes: DataFrame, built: DataFrame) -> DataFrame:
    """Index versions to append: only of stations whose fingerprint changed. built: station_id, fingerprint."""
    before = newest_version(indexes).select("station_id", F.col("version").alias("was"), F.col("fingerprint").alias("old"))
    both = built.join(before, "station_id", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("old")))
    return both.select("station_id", (F.coalesce("was", F.lit(0)) + 1).cast("long").alias("version"), "fingerprint")
