"""Configuration as tables: station files, keyword entities, campaigns with their children, and small views of them.

Nulls: a file, line, name or id that is null or blank is left out; a child without its parent's id belongs to none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.functions.text import keys
from murmur.operators.tables import children_replaced, sparse

LONGEST_NAME, MOST_KEYWORDS = 200, 100


def env_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a station file (``*.env``): key (its path) and a map of its settings."""
    whole = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.env").text(path)
    return whole.select(F.col("_metadata.file_path").alias("key"), settings(F.col("value")).alias("settings"))


def settings(text: Column) -> Column:
    """A map of KEY=VALUE lines: comments and lines without a key go, outer quotes too; the last of a repeated key wins."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike("^(export +)?[A-Za-z_][A-Za-z0-9_]* *="))
    bare = F.transform(lines, lambda x: F.regexp_replace(x, "^export +", ""))
    value = lambda x: F.regexp_replace(F.trim(F.substring(x, F.instr(x, "=") + 1, F.char_length(x))), "^\"(.*)\"$|^'(.*)'$", "$1$2")
    pairs = F.transform(bare, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), value(x).alias("v")))
    last = F.aggregate(pairs, F.slice(pairs, 1, 0), lambda acc, p: F.array_append(F.filter(acc, lambda q: q["k"] != p["k"]), p))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def station_metadata(documents: DataFrame, body: str) -> DataFrame:
    """Stations out of metadata documents, which are a list or an object that holds one: id, name, country_code."""
    item = "array<struct<id:string,name:string,country_code:string,language_codes:array<string>>>"
    # an object would be read as a list of itself
    listed = F.from_json(F.when(F.ltrim(F.col(body)).startswith("["), F.col(body)).otherwise(F.get_json_object(body, "$.stations")), item)
    return documents.select(F.explode(listed).alias("s")).select("s.*").filter("trim(id) <> ''")


def station_ids(objects: DataFrame, depth: int = 1) -> DataFrame:
    """Station ids out of object keys: the distinct part at a depth of the path."""
    part = F.get(F.split("key", "/"), depth)
    return objects.select(part.alias("station_id"), F.size(F.split("key", "/")).alias("n")).filter((F.col("n") > depth + 1) & (F.col("station_id") != "")).select("station_id").distinct()


def by_name(stations: DataFrame) -> DataFrame:
    """Stations in the order of their names, whatever their case."""
    place = Window.orderBy(keys(F.col("name"), "casefold").asc_nulls_last(), "station_id")  # a row a station
    return stations.withColumn("place", F.row_number().over(place).cast("long"))


def entities(keywords: DataFrame) -> DataFrame:
    """Keyword entities: each with its campaigns and stations, and the aliases of all its keywords in order, without those
    that differ in case only. keywords: entity_id, display_name, campaign_id, ordinal, aliases (array), station_ids (array)."""
    each = keywords.select("entity_id", "ordinal", F.posexplode_outer("aliases").alias("i", "alias")).filter("trim(alias) <> ''")
    first = each.withColumn("alias", F.trim("alias")).groupBy("entity_id", F.lower("alias").alias("k")).agg(F.min(F.struct("ordinal", "i", "alias")).alias("a"))
    listed = first.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list("a")), lambda a: a["alias"]).alias("aliases"))
    whole = keywords.groupBy("entity_id").agg(F.min_by("display_name", "ordinal").alias("display_name"), F.array_sort(F.collect_set("campaign_id")).alias("campaign_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("station_ids")))).alias("station_ids"))
    return whole.join(listed, "entity_id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def configuration(existing: DataFrame, managed: DataFrame) -> DataFrame:
    """The keyword configuration after a write: what others put there, and the managed entities, which replace their like.
    Both: entity_id, managed, and others."""
    return existing.filter(~F.coalesce("managed", F.lit(False))).join(managed.select("entity_id"), "entity_id", "left_anti").unionByName(managed)


def updated_campaigns(campaigns: DataFrame, stations: DataFrame, changes: DataFrame, new_stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Campaigns and their stations after partial updates: given columns replace, given station lists replace whole."""
    return sparse(campaigns, changes, "campaign_id"), children_replaced(stations, new_stations, "campaign_id")


def refused_requests(requests: DataFrame) -> DataFrame:
    """Campaign requests with the reason to refuse them (null: none) and their keywords without repeats. requests: name,
    keywords (array), station_ids (array)."""
    clean = F.filter(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.trim(k)), lambda k: F.coalesce(k != "", F.lit(False)))
    distinct = F.aggregate(clean, F.array().cast("array<string>"), lambda acc, k: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(k)), acc).otherwise(F.array_append(acc, k)))
    name = F.trim(F.coalesce("name", F.lit("")))
    rows = requests.withColumn("distinct_keywords", distinct)
    reason = F.when(name == "", "no name").when(F.char_length(name) > LONGEST_NAME, "long name").when(F.size("distinct_keywords") == 0, "no keyword").when(F.size("distinct_keywords") > MOST_KEYWORDS, "too many keywords").when(F.size(F.coalesce("station_ids", F.array().cast("array<string>"))) == 0, "no station")
    return rows.withColumn("refused", reason)


def playback(mentions: DataFrame, pad_s: float = 2.0, least_s: float = 0.5) -> DataFrame:
    """Where in its clip a mention is played, in seconds from the clip's start: padded, inside the clip, and half a second
    at least. mentions: started_at, ended_at, clip_start, clip_end."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    length = F.greatest(us("clip_end") - us("clip_start"), F.lit(0.0))
    start = F.least(F.greatest(us("started_at") - us("clip_start") - pad_s, F.lit(0.0)), length)
    end = F.least(F.coalesce(us("ended_at"), us("started_at")) - us("clip_start") + pad_s, length)
    return mentions.withColumn("play_from", start).withColumn("play_to", F.greatest(end, start + least_s))


def live_sessions(beats: DataFrame, detail: str) -> DataFrame:
    """Sessions out of heartbeats' JSON: an object a session; anything else in the list is skipped."""
    raw = F.explode(F.from_json(F.get_json_object(detail, "$.sessions"), "array<string>"))
    rows = beats.select("worker_id", raw.alias("raw")).filter(F.col("raw").startswith("{"))
    field = lambda name: F.get_json_object("raw", f"$.{name}").alias(name)
    return rows.select("worker_id", *map(field, ("station_id", "session_id", "state", "started_at", "class")))


def selection_summary(stations: DataFrame) -> DataFrame:
    """Stations of each campaign by monitoring state. stations: campaign_id, state."""
    n = lambda *states: F.count(F.when(F.col("state").isin(*states), 1))
    return stations.groupBy("campaign_id").agg(F.count("*").alias("n"), n("active", "activating").alias("active"), n("pending_probe", "probing", "pending_capacity").alias("waiting"), n("failed_probe", "degraded").alias("failing"))


def backlog_page(analyses: DataFrame, mentions: DataFrame, failed: DataFrame, most: int) -> DataFrame:
    """Mentions whose analysis is a fallback, the newest first, without those that failed before."""
    rows = analyses.filter("status = 'fallback'").join(mentions, "mention_id").join(failed.select("mention_id"), "mention_id", "left_anti")
    return rows.orderBy(F.desc("started_at"), F.desc("mention_id")).limit(most)


def unpublished(mentions: DataFrame, most: int) -> DataFrame:
    """Mentions that aren't published, the oldest first."""
    return mentions.filter("published_at IS NULL").orderBy("started_at", "mention_id").limit(most)


def deletions(deletable: DataFrame, sizes: DataFrame, most: int = 200) -> DataFrame:
    """The oldest deletable segments with their bytes."""
    return deletable.orderBy(F.desc("age_s"), "segment_id").limit(most).join(sizes, "segment_id", "left").withColumn("size", F.coalesce("size", F.lit(0)))


def windows_of(pcm: DataFrame, bytes_each: int) -> DataFrame:
    """Tumbling windows of a stretch of samples: its number and bytes; what is left at the end is a shorter one."""
    n = F.ceil(F.octet_length("pcm") / bytes_each).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(i.alias("window"), F.substring(F.col("pcm"), i * bytes_each + 1, F.lit(bytes_each)).alias("pcm")))
    return pcm.filter("octet_length(pcm) > 0").select("id", F.explode(each).alias("w")).select("id", "w.*")
