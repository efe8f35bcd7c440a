"""Station catalogue: coercion of source fields, overlay and deletions, filters, reference lists, selections, estimates.

Nulls: a station without a well-formed uuid isn't listed; fields that can't be read take their defaults; of several
overrides or managed records of one station one counts, the greatest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
STATION_ID = "^[A-Za-z0-9][A-Za-z0-9_-]{0,126}$"
ACTIVE, PROBING = ("active", "activating", "degraded"), ("pending_probe", "probing")


def whole(value: Column) -> Column:
    return F.coalesce(value.try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def truth(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes"), F.lit(False))


def listed(value: Column, lower: bool = True) -> Column:
    """A comma-separated text as a list of stripped, non-blank, distinct items."""
    items = F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x))
    items = F.transform(items, lambda x: F.lower(x)) if lower else items
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def coerced(raw: DataFrame) -> DataFrame:
    """Source rows with inconsistent types as stations. raw: stationuuid, name, url, url_resolved, countrycode, country,
    languagecodes, tags, codec, bitrate, lastcheckok, votes, clickcount, all as text."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    code = F.upper(F.trim("countrycode"))
    return raw.select(
        F.lower(F.trim("stationuuid")).alias("station_uuid"), text("name").alias("name"), F.coalesce(text("url_resolved"), text("url")).alias("stream_url"),
        F.when(code.rlike("^[A-Z]{2}$"), code).alias("country_code"), text("country").alias("country_name"), listed(F.col("languagecodes")).alias("language_codes"), listed(F.col("tags")).alias("tags"),
        F.upper(text("codec")).alias("codec"), whole(F.col("bitrate")).alias("bitrate"), truth(F.col("lastcheckok")).alias("healthy"), whole(F.col("votes")).alias("votes"), whole(F.col("clickcount")).alias("clicks"),
    ).filter(F.coalesce(F.col("station_uuid").rlike(UUID), F.lit(False)))


def one_each(rows: DataFrame, key: str) -> DataFrame:
    """One row a key: the greatest of its rows."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("m")).select(key, "m.*")


def catalogue(stations: DataFrame, overrides: DataFrame, deletions: DataFrame, managed: DataFrame) -> DataFrame:
    """Stations without deleted ones; an override's name, url, country, tags and, where it names any, languages replace the
    source's; with the monitoring state. overrides: station_uuid, name, url, country_code, language_codes, tags; managed:
    station_uuid, managed_id, state, probe_status, campaigns."""
    over = one_each(overrides, "station_uuid").select("station_uuid", F.struct("name", "url", "country_code", "language_codes", "tags").alias("o"))
    kept = stations.join(deletions.select("station_uuid").distinct(), "station_uuid", "left_anti").join(over, "station_uuid", "left").join(one_each(managed, "station_uuid"), "station_uuid", "left")
    has = F.col("o").isNotNull()
    pick = lambda new, old: F.when(has, F.col(f"o.{new}")).otherwise(F.col(old)).alias(old)
    languages = F.when(has & (F.size("o.language_codes") > 0), F.col("o.language_codes")).otherwise(F.col("language_codes")).alias("language_codes")
    return kept.select("station_uuid", F.concat(F.lit("rb-"), "station_uuid").alias("station_id"), pick("name", "name"), pick("url", "stream_url"), pick("country_code", "country_code"), languages, pick("tags", "tags"), "codec", "bitrate", "healthy", "votes", "clicks", F.when(has, "source+overlay").otherwise("source").alias("origin"), F.coalesce("state", F.lit("available")).alias("monitoring_status"), "managed_id", "probe_status", F.coalesce("campaigns", F.lit(0)).alias("active_campaign_count"))


def public(stations: DataFrame) -> DataFrame:
    """Stations as readers see them: without the address of the stream."""
    return stations.drop("stream_url")


def filtered(rows: DataFrame, name=None, country=None, language=None, tags=(), codec=None, bitrate_min=None, bitrate_max=None, https=False, healthy=False) -> DataFrame:
    """All given filters together."""
    tests = [(name, F.contains(F.lower("name"), F.lit((name or "").lower()))), (country, F.col("country_code") == country), (language, F.array_contains("language_codes", language)), (codec, F.col("codec") == (codec or "").upper()), (bitrate_min, F.col("bitrate") >= F.lit(bitrate_min)), (bitrate_max, F.col("bitrate") <= F.lit(bitrate_max)), (https or None, F.col("stream_url").startswith("https://")), (healthy or None, F.col("healthy"))]
    for value, test in tests:
        rows = rows if value is None else rows.filter(test)
    for tag in tags:
        rows = rows.filter(F.array_contains("tags", tag))
    return rows


def reference_list(rows: DataFrame, name: Column, code: Column | None = None) -> DataFrame:
    """Non-blank names with their numbers of stations, the most first; ties by code or name."""
    keyed = rows.select(F.trim(name).alias("name"), (F.trim(code) if code is not None else F.trim(name)).alias("code")).filter("name <> ''")
    counts = keyed.groupBy("code", "name").agg(F.count("*").alias("station_count"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("station_count"), "code", "name")).cast("long"))  # a row a name


def selected(rows: DataFrame, wanted: int, per_country: int = 100) -> DataFrame:
    """The most voted stations of each country, a page of each, merged and cut."""
    rank = Window.partitionBy("country_code").orderBy(F.desc("votes"), F.desc("clicks"), "station_uuid")
    pages = rows.withColumn("page_place", F.row_number().over(rank)).filter(F.col("page_place") <= per_country).drop("page_place")
    return pages.orderBy(F.desc("votes"), F.desc("clicks"), "station_uuid").limit(wanted)


def matched(rows: DataFrame, per_country: int = 100) -> DataFrame:
    """How many stations match, as an estimate: a country with more than a page counts a page and a hundred more."""
    n = rows.groupBy("country_code").agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum(F.when(F.col("n") > per_country, per_country + 100).otherwise(F.col("n"))), F.lit(0)).alias("matched"))


def estimate(stations: DataFrame, limit: int, active_now: int) -> DataFrame:
    """One row: of the selected stations, how many are active, wait for a probe, failed one, can start now or must wait."""
    s = F.col("monitoring_status")
    n = lambda cond: F.count(F.when(cond, 1))
    fresh = n(~s.isin(*ACTIVE, *PROBING, "failed_probe"))
    counts = stations.agg(F.count("*").alias("selected"), n(s.isin(*ACTIVE)).alias("already_active"), n(s.isin(*PROBING)).alias("pending_probe"), n(s == "failed_probe").alias("failed"), fresh.alias("fresh"))
    now = F.least("fresh", F.lit(max(0, limit - active_now)))
    return counts.withColumn("can_start_now", now.cast("long")).withColumn("pending_capacity", (F.col("fresh") - now).cast("long")).drop("fresh")


def repeated(overlay: DataFrame) -> DataFrame:
    """Station ids that an overlay names more than once, which it must not."""
    return overlay.groupBy(F.lower(F.trim("station_uuid")).alias("station_uuid")).agg(F.count("*").alias("n")).filter("n > 1")


def valid_ids(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose station id is well-formed, and the others."""
    good = F.coalesce(F.col(column).rlike(STATION_ID), F.lit(False))
    return rows.filter(good), rows.filter(~good)


def coordinate(text: Column, most: float) -> Column:
    """A coordinate within its range; null for anything else."""
    value = text.try_cast("double")
    return F.when(F.abs(value) <= most, value)
