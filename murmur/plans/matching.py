"""Queries of keyword matching: documents as transcripts of the station that is their source, benchmark passages as the
keywords of campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions import text
from murmur.operators import matching
from murmur.sources.views import Views

KINDS = ("brand", "topic", "person", "phrase", "place")


def transcripts(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.col("source").alias("station_id"), "text")


def keywords(v: Views) -> DataFrame:
    """A passage's words one and two are a keyword's value; words further on are its aliases, of all forms and kinds.
    Every keyword belongs to two campaigns."""
    words = F.split(F.trim("text"), "\\s+")
    part = lambda first, n: F.concat_ws(" ", F.slice(words, first, n))
    item = lambda first, n, kind, language: F.to_json(F.struct(part(first, n).alias("value"), F.lit(kind).alias("kind"), F.lit(language).alias("language")))
    listed = F.array(F.to_json(F.array(part(3, 1))).substr(F.lit(2), F.char_length(F.to_json(F.array(part(3, 1)))) - 2), item(4, 2, "romanization", "EN"), item(6, 2, "asr_variant", "fr"), item(8, 1, "phonetic", " "), item(9, 2, "translation", "de"), item(11, 1, "nickname", None))
    rows = v.table("benchmark").select(
        F.col("item_id").alias("keyword_id"),
        F.concat(F.upper(part(1, 1)), F.lit(" "), part(2, 1)).alias("canonical_value"),
        F.element_at(F.array(*map(F.lit, KINDS)), (F.col("item_id") % 5 + 1).cast("int")).alias("keyword_type"),
        F.when(F.col("item_id") % 7 == 0, "substring").otherwise("tokens").alias("match_mode"),
        F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("aliases"),
        F.explode(F.array(F.col("item_id") % 6, F.col("item_id") % 4 + 10)).alias("campaign_id"),
    )
    return rows


def stations(v: Views) -> DataFrame:
    """Every source is a station of about half of the campaigns, by digest."""
    sources = v.table("documents").select(F.col("source").alias("station_id")).distinct()
    mine = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("station_id"), F.col("campaign_id").cast("string"))), 1, 4), 16, 10).cast("int") % 2 == 0
    numbers = F.array(*[F.lit(c).cast("long") for c in (*range(6), *range(10, 14))])  # those that keywords() gives out
    return sources.select(F.explode(numbers).alias("campaign_id"), "station_id").filter(mine).join(keywords(v).select("campaign_id").distinct(), "campaign_id", "left_semi")


def _index(v: Views) -> tuple[DataFrame, DataFrame]:
    bound, words = stations(v), keywords(v)
    return matching.index_terms(matching.surface_forms(words), bound), matching.entries(words, bound)


def keyword_matches(v: Views) -> DataFrame:
    """Every match of every whole document with its station's index."""
    return matching.matches(transcripts(v), *_index(v))


def keyword_candidates(v: Views) -> DataFrame:
    """The same with words one edit away from a term."""
    return matching.matches(transcripts(v), *_index(v), fuzzy=True).filter("match_level = 'fuzzy'")


def match_report(v: Views) -> DataFrame:
    docs = transcripts(v)
    return matching.report(docs, matching.matches(docs, *_index(v)))


def best_matches(v: Views) -> DataFrame:
    return matching.best_per_keyword(matching.matches(transcripts(v), *_index(v))).select("doc_id", "keyword_id", "start", "matched", "confidence")


def station_terms(v: Views) -> DataFrame:
    return _index(v)[0]


def timed_matches(v: Views) -> DataFrame:
    """Matches with the times of the lines they lie in: a line is a segment of 80 ms a character."""
    docs = transcripts(v)
    lines = text.laid_out(F.transform(F.split("text", "\n"), F.char_length))
    at = lambda place: place.cast("long") * 80
    timeline = F.transform(lines, lambda x: F.struct(x["start_char"].alias("start_char"), x["end_char"].alias("end_char"), at(x["start_char"]).alias("start_ms"), at(x["end_char"]).alias("end_ms")))
    return matching.matches(docs.withColumn("timeline", timeline), *_index(v)).select("doc_id", "keyword_id", "start", "end", "start_ms", "end_ms")


def station_hints(v: Views) -> DataFrame:
    spoken = v.table("documents").filter("lang IS NOT NULL").groupBy(F.col("source").alias("station_id"), F.col("lang").alias("language")).agg(F.min("doc_id").alias("place"))
    return matching.language_hints(spoken, matching.surface_forms(keywords(v)), stations(v))


def station_prompts(v: Views) -> DataFrame:
    return matching.prompts(matching.surface_forms(keywords(v)), stations(v))


def text_keys(v: Views) -> DataFrame:
    """Key forms of the names of parts, suppliers and pages' hosts."""
    names = v.table("part").select(F.col("p_name").alias("name")).unionByName(v.table("supplier").select(F.col("s_name").alias("name"))).unionByName(v.table("pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("name"))).distinct()
    return names.select("name", *[text.keys(F.col("name"), k).alias(k) for k in ("normalized", "legacy", "slug", "identifier")], text.entity_id(F.col("name")).alias("entity_id"))


TEXT_KEYS_SQL = r"""
WITH keyed AS (SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ' ') AS normalized, array_to_string(regexp_extract_all(lower(name), '[a-z0-9_]+'), ' ') AS legacy,
 substr(coalesce(nullif(trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'keyword'), 1, 48) AS slug, trim(lower(name), ' ') AS identifier
 FROM (SELECT p_name AS name FROM part UNION SELECT s_name FROM supplier UNION SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) FROM pages))
SELECT *, 'api-' || slug || '-' || substr(sha256(legacy), 1, 10) AS entity_id FROM keyed"""


def station_shards(v: Views) -> DataFrame:
    """The shard of each supplier's station id."""
    return v.table("supplier").select(F.col("s_suppkey").alias("station_id"), text.stable_shard(F.concat(F.lit("rb-"), F.col("s_suppkey").cast("string")), 64).alias("shard"))


QUERIES = {
    "keyword_matches": (keyword_matches, None),
    "keyword_candidates": (keyword_candidates, None),
    "match_report": (match_report, None),
    "best_matches": (best_matches, None),
    "station_terms": (station_terms, None),
    "timed_matches": (timed_matches, None),
    "station_hints": (station_hints, None),
    "station_prompts": (station_prompts, None),
    "text_keys": (text_keys, TEXT_KEYS_SQL),
    "station_shards": (station_shards, None),
}
