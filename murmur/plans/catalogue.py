"""Queries of the station catalogue: pages are source rows, their hosts the stations' names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.operators import catalogue as ops
from murmur.operators import feed
from murmur.sources.views import Views

N = "page_id"


def _uuid(n: Column) -> Column:
    h = F.md5(n.cast("string"))
    return F.concat_ws("-", *[F.substring(h, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _raw(v: Views) -> DataFrame:
    """Source rows with all the inconsistencies: upper-case ids, blank names, numbers as text, broken values."""
    n = F.col(N)
    text = lambda c: c.cast("string")
    return v.table("pages").select(
        F.when(n % 10 == 0, F.upper(_uuid(n))).when(n % 33 == 1, "broken").otherwise(_uuid(n)).alias("stationuuid"),
        F.concat(F.lit(" "), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)).alias("name"), F.col("url"), F.when(n % 3 == 0, " ").otherwise(F.concat(F.lit("https://r/"), text(n))).alias("url_resolved"),
        F.element_at(F.array(*map(F.lit, ("de", "FR", "x", "us", " in "))), (n % 5 + 1).cast("int")).alias("countrycode"), F.lit("Land").alias("country"),
        F.element_at(F.array(*map(F.lit, ("en, hi", "", "FR,,fr", "de"))), (n % 4 + 1).cast("int")).alias("languagecodes"), F.when(n % 2 == 0, "Rock,news , rock").otherwise("news").alias("tags"),
        F.element_at(F.array(*map(F.lit, ("mp3", "AAC", ""))), (n % 3 + 1).cast("int")).alias("codec"), F.when(n % 7 == 0, "fast").otherwise(text(n % 5 * 64)).alias("bitrate"),
        F.when(n % 6 == 0, "0").otherwise("1").alias("lastcheckok"), F.concat(text(n * 37 % 101), F.lit(".0")).alias("votes"), text(n % 13).alias("clickcount"),
    )


def _catalogue(v: Views) -> DataFrame:
    n = F.col(N)
    pages = v.table("pages").select(N)
    codes = F.when(n % 2 == 0, F.array(F.lit("xx"))).otherwise(F.array().cast("array<string>"))
    overrides = pages.filter("page_id % 8 = 0").select(_uuid(n).alias("station_uuid"), F.concat(F.lit("Over "), n.cast("string")).alias("name"), F.lit("http://over").alias("url"), F.lit("IN").alias("country_code"), codes.alias("language_codes"), F.array(F.lit("over")).alias("tags"))
    deletions = pages.filter("page_id % 11 = 0").select(_uuid(n).alias("station_uuid"))
    state = F.element_at(F.array(*map(F.lit, ("active", "probing", "failed_probe", "stopped", "degraded"))), (n % 5 + 1).cast("int"))
    managed = pages.filter("page_id % 4 < 2").select(_uuid(n).alias("station_uuid"), n.alias("managed_id"), state.alias("state"), F.lit("ok").alias("probe_status"), (n % 3).alias("campaigns"))
    return ops.catalogue(ops.coerced(_raw(v)), overrides, deletions, managed)


CATALOGUE = r"""
raw AS (SELECT page_id AS n, md5(CAST(page_id AS VARCHAR)) AS h, trim(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), ' ') AS host, url FROM pages WHERE NOT (page_id % 33 = 1 AND page_id % 10 <> 0)),
source AS (SELECT n, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS station_uuid, nullif(host, '') AS name,
 CASE WHEN n % 3 = 0 THEN nullif(trim(url, ' '), '') ELSE 'https://r/' || n END AS stream_url, ['DE', 'FR', NULL, 'US', 'IN'][n % 5 + 1] AS country_code, [['en', 'hi'], [], ['fr'], ['de']][n % 4 + 1] AS language_codes,
 CASE WHEN n % 2 = 0 THEN ['rock', 'news'] ELSE ['news'] END AS tags, ['MP3', 'AAC', NULL][n % 3 + 1] AS codec, CASE WHEN n % 7 = 0 THEN 0 ELSE n % 5 * 64 END AS bitrate, n % 6 <> 0 AS healthy, n * 37 % 101 AS votes, n % 13 AS clicks FROM raw),
catalogue AS (SELECT station_uuid, 'rb-' || station_uuid AS station_id, CASE WHEN n % 8 = 0 THEN 'Over ' || n ELSE name END AS name, CASE WHEN n % 8 = 0 THEN 'http://over' ELSE stream_url END AS stream_url,
 CASE WHEN n % 8 = 0 THEN 'IN' ELSE country_code END AS country_code, CASE WHEN n % 8 = 0 THEN ['xx'] ELSE language_codes END AS language_codes, CASE WHEN n % 8 = 0 THEN ['over'] ELSE tags END AS tags,
 codec, bitrate, healthy, votes, clicks, CASE WHEN n % 8 = 0 THEN 'source+overlay' ELSE 'source' END AS origin, CASE WHEN n % 4 < 2 THEN ['active', 'probing', 'failed_probe', 'stopped', 'degraded'][n % 5 + 1] ELSE 'available' END AS monitoring_status,
 CASE WHEN n % 4 < 2 THEN n END AS managed_id, CASE WHEN n % 4 < 2 THEN 'ok' END AS probe_status, CASE WHEN n % 4 < 2 THEN n % 3 ELSE 0 END AS active_campaign_count FROM source WHERE n % 11 <> 0)"""


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("language_codes", F.array_join("language_codes", ",")).withColumn("tags", F.array_join("tags", ","))


def station_catalogue(v: Views) -> DataFrame:
    return _flat(ops.public(_catalogue(v)))


def catalogue_search(v: Views) -> DataFrame:
    rows = ops.filtered(_catalogue(v), language="en", tags=("rock",), bitrate_min=64, bitrate_max=192, https=True, healthy=True)
    return feed.page_with_more(rows.select("station_uuid", "votes", "clicks"), [F.desc("votes"), F.desc("clicks"), "station_uuid"], 5)


SEARCH_SQL = f"""
WITH {CATALOGUE.strip()}, found AS (SELECT station_uuid, votes, clicks FROM catalogue WHERE list_contains(language_codes, 'en') AND list_contains(tags, 'rock') AND bitrate BETWEEN 64 AND 192 AND starts_with(stream_url, 'https://') AND healthy)
SELECT *, (SELECT count(*) > 5 FROM found) AS has_more FROM found ORDER BY votes DESC, clicks DESC, station_uuid LIMIT 5"""


def country_list(v: Views) -> DataFrame:
    return ops.reference_list(_catalogue(v), F.col("country_code"))


def tag_list(v: Views) -> DataFrame:
    return ops.reference_list(_catalogue(v).select(F.explode("tags").alias("tag")), F.col("tag"))


def selected_stations(v: Views) -> DataFrame:
    return ops.selected(_catalogue(v).filter("country_code IS NOT NULL"), 30, 10).select("station_uuid", "country_code", "votes", "clicks")


def activation_estimate(v: Views) -> DataFrame:
    rows = _catalogue(v).filter("country_code IS NOT NULL")
    return ops.estimate(ops.selected(rows, 60, 20), 40, 12).join(ops.matched(rows, 20))  # two single rows


def repeated_overlays(v: Views) -> DataFrame:
    return ops.repeated(v.table("pages").select(_uuid(F.col(N) % 100).alias("station_uuid")))


def refused_stations(v: Views) -> DataFrame:
    """Customers' and parts' names as station ids."""
    names = v.table("customer").select(F.col("c_name").alias("id")).unionByName(v.table("part").select(F.concat_ws("_", "p_name", "p_brand").alias("id")))
    good, bad = ops.valid_ids(names.unionByName(v.table("supplier").select(F.concat(F.lit("rb-"), F.col("s_suppkey").cast("string")).alias("id"))), "id")
    return good.agg(F.count("*").alias("n")).withColumn("valid", F.lit(True)).unionByName(bad.agg(F.count("*").alias("n")).withColumn("valid", F.lit(False)))


QUERIES = {
    "station_catalogue": (station_catalogue, f"WITH {CATALOGUE.strip()} SELECT * EXCLUDE (stream_url) REPLACE (array_to_string(language_codes, ',') AS language_codes, array_to_string(tags, ',') AS tags) FROM catalogue"),
    "catalogue_search": (catalogue_search, SEARCH_SQL),
    "country_list": (country_list, f"""WITH {CATALOGUE.strip()} SELECT country_code AS name, country_code AS code, count(*) AS station_count, row_number() OVER (ORDER BY count(*) DESC, country_code) AS place
FROM catalogue WHERE country_code IS NOT NULL GROUP BY country_code"""),
    "tag_list": (tag_list, f"""WITH {CATALOGUE.strip()} SELECT tag AS name, tag AS code, count(*) AS station_count, row_number() OVER (ORDER BY count(*) DESC, tag) AS place FROM (SELECT unnest(tags) AS tag FROM catalogue) GROUP BY tag"""),
    "selected_stations": (selected_stations, f"""WITH {CATALOGUE.strip()} SELECT station_uuid, country_code, votes, clicks FROM (SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY votes DESC, clicks DESC, station_uuid) AS r
FROM catalogue WHERE country_code IS NOT NULL) WHERE r <= 10 ORDER BY votes DESC, clicks DESC, station_uuid LIMIT 30"""),
    "activation_estimate": (activation_estimate, f"""WITH {CATALOGUE.strip()}, ranked AS (SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY votes DESC, clicks DESC, station_uuid) AS r FROM catalogue WHERE country_code IS NOT NULL),
chosen AS (SELECT monitoring_status AS s FROM ranked WHERE r <= 20 ORDER BY votes DESC, clicks DESC, station_uuid LIMIT 60),
counts AS (SELECT count(*) AS selected, count(*) FILTER (s IN ('active', 'activating', 'degraded')) AS already_active, count(*) FILTER (s IN ('pending_probe', 'probing')) AS pending_probe, count(*) FILTER (s = 'failed_probe') AS failed,
 count(*) FILTER (s NOT IN ('active', 'activating', 'degraded', 'pending_probe', 'probing', 'failed_probe')) AS fresh FROM chosen)
SELECT selected, already_active, pending_probe, failed, least(fresh, 28) AS can_start_now, fresh - least(fresh, 28) AS pending_capacity,
 (SELECT CAST(sum(CASE WHEN n > 20 THEN 120 ELSE n END) AS BIGINT) FROM (SELECT count(*) AS n FROM ranked GROUP BY country_code)) AS matched FROM counts"""),
    "repeated_overlays": (repeated_overlays, """SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS station_uuid, n
FROM (SELECT md5(CAST(page_id % 100 AS VARCHAR)) AS h, count(*) AS n FROM pages GROUP BY page_id % 100) WHERE n > 1"""),
    "refused_stations": (refused_stations, """SELECT regexp_matches(id, '^[A-Za-z0-9][A-Za-z0-9_-]{0,126}$') AS valid, count(*) AS n FROM (SELECT c_name AS id FROM customer UNION ALL SELECT p_name || '_' || p_brand FROM part UNION ALL SELECT 'rb-' || s_suppkey FROM supplier) GROUP BY valid"""),
}
