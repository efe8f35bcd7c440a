"""Queries of analysis records: answers are made of documents, their labels and their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.operators import records
from murmur.sources.views import Views

MOODS = ("Positive", " negative", "mixed", "angry", "")


def _pick(values: tuple, column: str = "doc_id") -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(column) % len(values) + 1).cast("int"))


def _answers(v: Views) -> DataFrame:
    """An answer for each document: bare, fenced, after thinking, inside prose, broken or absent; it quotes the text's
    first words and words that were never said."""
    words = F.slice(F.split(F.trim("text"), "[ \n]+"), 1, 3)
    body = F.to_json(F.struct(
        F.when(F.col("doc_id") % 4 != 0, "news").alias("content_type"), F.col("lang").alias("language"),
        F.concat(F.lit(" The summary of "), F.col("doc_id").cast("string"), F.lit(" ")).alias("summary"), _pick(MOODS).alias("sentiment"),
        _pick(("HIGH", "soon", "low")).alias("urgency"), _pick(("0.7", "70", "-3", "1000", "much", "0.2")).alias("confidence"), (F.col("doc_id") % 9 == 0).alias("needs_review"),
        F.array(F.lit(" one "), F.lit("  "), F.col("source")).alias("key_points"),
        F.array(F.struct(F.lit("Ada").alias("name"), F.lit("Person").alias("type")), F.struct(F.lit(" ").alias("name"), F.lit("brand").alias("type")), F.struct(F.lit("Bo").alias("name"), F.lit("alien").alias("type"))).alias("entities"),
        F.array(F.struct(F.upper(F.array_join(words, " ")).alias("text"), (F.col("doc_id") % 90).alias("start_ms"), F.lit(10**6).alias("end_ms")), F.struct(F.when(F.col("doc_id") % 3 == 0, "never said at all").otherwise("").alias("text"), F.lit(0).alias("start_ms"), F.lit(5).alias("end_ms"))).alias("evidence"),
    ))
    kinds = (body, F.concat(F.lit("<think>\nwell {a}\n</think> "), body), F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("Here it is: "), body, F.lit(" as asked.")), F.lit("[1, 2]"), F.lit("{broken"), F.lit(None).cast("string"))
    raw = kinds[-1]
    for i, k in enumerate(kinds[:-1]):
        raw = F.when(F.col("doc_id") % 7 == i, k).otherwise(raw)
    return v.table("documents").select("doc_id", "text", "lang", "source", raw.alias("raw"))


def analysis_records(v: Views) -> DataFrame:
    got = records.records(_answers(v), "raw", F.col("text"), F.lit(60).cast("long"))
    r = F.col("record")
    return got.select("doc_id", "refused", *[r[c].alias(c) for c in ("content_type", "language", "summary", "sentiment", "urgency", "confidence", "needs_review")], F.array_join(r["key_points"], "|").alias("key_points"), F.array_join(F.transform(r["entities"], lambda e: F.concat_ws("=", e["name"], e["type"])), "|").alias("entities"), F.size(r["evidence"]).cast("long").alias("n_evidence"), F.get(r["evidence"], 0)["end_ms"].alias("end_ms"))


RECORDS_SQL = r"""
WITH rows AS (SELECT doc_id, lang, source, text, array_to_string(string_split_regex(trim(text, ' '), '[ \n]+')[1:3], ' ') AS quote FROM documents),
said AS (SELECT *, trim(quote, ' ') <> '' AND contains(lower(text), lower(trim(quote, ' '))) AND doc_id % 90 <= 60 AS heard,
 (CASE WHEN trim(quote, ' ') <> '' THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) AS given, [0.7, 0.7, 0, 1, 0, 0.2][doc_id % 6 + 1] AS sure FROM rows),
kinds AS (SELECT *, CASE WHEN doc_id % 7 = 6 THEN 'empty' WHEN doc_id % 7 IN (4, 5) THEN 'not an object' END AS refused FROM said)
SELECT doc_id, refused, CASE WHEN refused IS NULL THEN CASE WHEN doc_id % 4 <> 0 THEN 'news' ELSE 'unknown' END END AS content_type, CASE WHEN refused IS NULL THEN lang END AS language,
 CASE WHEN refused IS NULL THEN 'The summary of ' || doc_id END AS summary, CASE WHEN refused IS NULL THEN ['positive', 'negative', 'mixed', 'neutral', 'neutral'][doc_id % 5 + 1] END AS sentiment,
 CASE WHEN refused IS NULL THEN ['high', 'normal', 'low'][doc_id % 3 + 1] END AS urgency, CASE WHEN refused IS NULL THEN CAST(sure AS DOUBLE) END AS confidence,
 CASE WHEN refused IS NULL THEN doc_id % 9 = 0 OR (CASE WHEN heard THEN 1 ELSE 0 END) < given OR sure < 0.5 END AS needs_review,
 CASE WHEN refused IS NULL THEN concat_ws('|', 'one', source) END AS key_points, CASE WHEN refused IS NULL THEN 'Ada=person|Bo=other' END AS entities,
 CASE WHEN refused IS NULL THEN CAST(CASE WHEN heard THEN 1 ELSE 0 END AS BIGINT) END AS n_evidence, CASE WHEN refused IS NULL AND heard THEN CAST(60 AS BIGINT) END AS end_ms
FROM kinds"""


def fallback_records(v: Views) -> DataFrame:
    docs = v.table("documents").select("doc_id", "text", "source")
    made = records.fallbacks(docs, F.regexp_replace("text", "\n", " "), F.array("source", F.lit("second")), F.lit("model is away"))
    return made.select("doc_id", "summary", "main_topic", "entities", "sentiment", "confidence", "needs_review", "error")


FALLBACK_SQL = r"""
SELECT doc_id, CASE WHEN length(t) > 400 THEN regexp_replace(substr(t, 1, 397), ' [^ ]*$', '') || '...' ELSE t END AS summary, source AS main_topic, concat_ws('|', source, 'second') AS entities, 'neutral' AS sentiment,
 CAST(0 AS DOUBLE) AS confidence, true AS needs_review, 'model is away' AS error FROM (SELECT *, trim(replace(coalesce(text, ''), chr(10), ' '), ' ') AS t FROM documents)"""


def match_verdicts(v: Views) -> DataFrame:
    first = F.get(F.split(F.trim("text"), "[ \n]+"), 0)
    rows = v.table("documents").select("doc_id", "text", (F.col("doc_id") % 5 != 0).alias("is_match"), _pick(("exact_alias", "semantic_topic", "translated_equivalent", "odd")).alias("match_type"), F.when(F.col("doc_id") % 3 == 0, "never said at all").otherwise(records.capitals(first)).alias("matched_text"), _pick(("direct", "Indirect ", "incidental")).alias("relevance"), _pick(MOODS).alias("sentiment"), ((F.col("doc_id") % 13) / 10).alias("confidence"))
    return records.verdicts(rows, F.col("text"), F.lit(0.74), F.col("doc_id") % 2 == 0).drop("text", "is_match")


VERDICT_SQL = r"""
WITH rows AS (SELECT doc_id, ['exact_alias', 'semantic_topic', 'translated_equivalent', 'not_relevant'][doc_id % 4 + 1] AS kind, ['direct', 'indirect', 'incidental'][doc_id % 3 + 1] AS rel,
 CASE WHEN doc_id % 3 = 0 THEN 'never said at all' ELSE nullif(trim(upper(string_split_regex(trim(text, ' '), '[ \n]+')[1]), ' '), '') END AS quote, (doc_id % 13) / 10 AS confidence, text,
 ['positive', 'negative', 'mixed', 'neutral', 'neutral'][doc_id % 5 + 1] AS mood FROM documents),
judged AS (SELECT *, doc_id % 5 <> 0 AND coalesce(contains(lower(text), lower(quote)), false) AND least(confidence, 1) >= 0.74 AND rel IN ('direct', 'indirect') AND kind <> 'not_relevant'
 AND NOT (doc_id % 2 = 0 AND kind IN ('translated_equivalent', 'semantic_topic')) AS accepted FROM rows)
SELECT doc_id, CASE WHEN accepted THEN kind ELSE 'not_relevant' END AS match_type, CASE WHEN accepted THEN quote END AS matched_text, CASE WHEN accepted THEN rel ELSE 'not_relevant' END AS relevance,
 CASE WHEN accepted THEN mood ELSE 'neutral' END AS sentiment, CAST(confidence AS DOUBLE) AS confidence, accepted, least(confidence, 1) < 0.8 AS needs_review FROM judged"""


def settled_records(v: Views) -> DataFrame:
    rows = v.table("documents").select("doc_id", _pick(MOODS).alias("sentiment"), _pick(("direct", "incidental", "not_relevant", "odd")).alias("relevance"), ((F.col("doc_id") % 11) / 10).alias("confidence"), (F.col("doc_id") % 8 == 0).alias("needs_review"), F.array(F.col("lang"), F.upper("lang"), F.lit(" "), F.col("source")).alias("key_points"))
    return records.settled(rows).select("doc_id", "settled_sentiment", "settled_relevance", "settled_review", F.array_join("settled_points", "|").alias("points"))


SETTLED_SQL = """
WITH rows AS (SELECT doc_id, lang, source, ['positive', 'negative', 'mixed', 'neutral', 'neutral'][doc_id % 5 + 1] AS mood, ['direct', 'incidental', 'not_relevant', 'incidental'][doc_id % 4 + 1] AS rel FROM documents)
SELECT doc_id, CASE WHEN rel <> 'direct' THEN 'neutral' ELSE mood END AS settled_sentiment, rel AS settled_relevance,
 doc_id % 8 = 0 OR (doc_id % 11) / 10 < 0.6 OR (rel = 'incidental' AND mood <> 'neutral') AS settled_review, concat_ws('|', lang, source) AS points FROM rows"""


def relabelled_mentions(v: Views) -> DataFrame:
    mentions = v.table("documents").select(F.col("doc_id").alias("mention_id"), F.lit("neutral").alias("sentiment"), (F.col("doc_id") % 2 == 0).alias("needs_review"))
    made = v.table("labels").select(F.col("doc_id").alias("mention_id"), F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 0, "mixed").otherwise("positive").alias("sentiment"))
    return records.relabelled(mentions, made)


def stale_analyses(v: Views) -> DataFrame:
    docs = v.table("documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text")).filter("id % 17 <> 3")
    held = v.table("documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("transcript_sha256"))
    return records.stale(held, docs).select("id")


def shown_analyses(v: Views) -> DataFrame:
    rows = v.table("documents").select("doc_id", _pick(("ready", "error", "fallback", "pending", None)).alias("status"), F.when(F.col("doc_id") % 6 == 0, "{broken").when(F.col("doc_id") % 6 != 1, F.to_json(F.array("lang", "source"))).alias("key_points_json"))
    return records.view_of(rows).select("doc_id", "shown", "n_points", "first_point")


QUERIES = {
    "analysis_records": (analysis_records, RECORDS_SQL),
    "fallback_records": (fallback_records, FALLBACK_SQL),
    "match_verdicts": (match_verdicts, VERDICT_SQL),
    "settled_records": (settled_records, SETTLED_SQL),
    "relabelled_mentions": (relabelled_mentions, """SELECT d.doc_id AS mention_id, CASE WHEN l.doc_id IS NULL THEN 'neutral' WHEN toxic = 1 THEN 'negative' WHEN quality = 0 THEN 'neutral' ELSE 'positive' END AS sentiment,
d.doc_id % 2 = 0 OR coalesce(toxic <> 1 AND quality = 0, false) AS needs_review FROM documents d LEFT JOIN labels l USING (doc_id)"""),
    "stale_analyses": (stale_analyses, "SELECT doc_id AS id FROM documents WHERE doc_id % 17 = 3 OR (doc_id % 10 = 0 AND text IS NOT NULL)"),
    "shown_analyses": (shown_analyses, """SELECT doc_id, ['ready', 'failed', 'ready', 'pending', 'not_analyzed'][doc_id % 5 + 1] AS shown, CAST(CASE WHEN doc_id % 6 < 2 THEN 0 ELSE 2 END AS BIGINT) AS n_points,
CASE WHEN doc_id % 6 >= 2 THEN lang END AS first_point FROM documents"""),
}
