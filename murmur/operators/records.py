"""Analysis records: model answers to typed records, evidence that really was said, fallbacks, verdicts, cache validity.

Everything is column work. Nulls: an absent or unreadable answer is refused
with its reason, and its fields take their defaults; a null transcript is empty and supports no evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vocabularies and limits of a record.
SENTIMENTS = ("positive", "neutral", "negative", "mixed")
STANCES = ("supportive", "critical", "neutral", "unclear")
URGENCIES = ("low", "normal", "high", "critical")
ENTITY_TYPES = ("person", "organization", "location", "brand", "product", "event", "other")
RELEVANCES = ("direct", "indirect", "incidental", "not_relevant")
MATCH_TYPES = ("exact_alias", "spelling_variant", "translated_equivalent", "semantic_topic", "not_relevant")
SUMMARY, TOPIC, POINT, ENTITY, QUOTE, REASON = 2000, 300, 500, 200, 1000, 300
MOST_ITEMS, SURE, FALLBACK = 20, 0.5, 400
ANSWER = "content_type string, language string, relevant boolean, summary string, main_topic string, sentiment string, speaker_stance string, urgency string, confidence string, needs_review boolean, key_points array<string>, entities array<struct<name:string,type:string>>, evidence array<struct<text:string,start_ms:long,end_ms:long>>"


def answer_text(raw: Column) -> Column:
    """The first JSON object of an answer: without thinking block and code fence. Null if there is none."""
    bare = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), "(?s)<think>.*?</think>", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, "^```(?:json)?\\s*", ""), "\\s*```$", "")
    inside = F.regexp_extract(bare, "(?s)\\{.*\\}", 0)
    is_object = lambda c: F.get_json_object(c, "$").isNotNull() & F.ltrim(c).startswith("{")
    return F.when(is_object(bare), bare).when(F.get_json_object(bare, "$").isNull() & is_object(inside), inside)


def folded(text: Column) -> Column:
    """Text whatever its case: in capitals, where a sharp s, small or capital, meets its double."""
    return F.upper(F.translate(text, "ẞ", "ß"))


def capitals(text: Column) -> Column:
    """Text in capitals, character for character: what has no capital of one character stays, a sharp s has its own."""
    big = lambda c: F.when(F.char_length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, "ß", "ẞ"))
    return F.when(F.char_length(F.upper(text)) == F.char_length(text), F.upper(text)).otherwise(F.array_join(F.transform(F.split(text, ""), big), ""))


def one_of(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin(*allowed), v).otherwise(default)


def fraction(value: Column) -> Column:
    """A confidence in [0, 1]; percentages are read as such, what isn't a number as 0."""
    v = F.coalesce(F.try_to_number(value, F.lit("999999.999999")).cast("double"), value.try_cast("double"), F.lit(0.0))
    return F.least(F.greatest(F.when((v > 1) & (v <= 100), v / 100).otherwise(v), F.lit(0.0)), F.lit(1.0))


def stripped(items: Column, longest: int) -> Column:
    """Non-blank texts, cut to a length, twenty at most."""
    cut = F.transform(items, lambda t: F.substring(F.trim(t), 1, longest))
    return F.slice(F.filter(F.coalesce(cut, F.array().cast("array<string>")), lambda t: F.coalesce(t != "", F.lit(False))), 1, MOST_ITEMS)


def records(rows: DataFrame, raw: str, transcript: Column, duration_ms: Column) -> DataFrame:
    """rows with ``refused`` (null or why) and ``record``. Evidence stays if the transcript holds it whatever its case and
    it starts within the duration; its end is clamped. Dropped evidence or little confidence asks for review."""
    read = rows.withColumn("answer_text", answer_text(F.col(raw))).withColumn("answer", F.from_json("answer_text", ANSWER)).withColumn("said", folded(F.coalesce(transcript, F.lit(""))))
    text, a, said = F.col("answer_text"), F.col("answer"), F.col("said")
    evidence = F.slice(F.filter(F.coalesce(a["evidence"], F.array().cast("array<struct<text:string,start_ms:bigint,end_ms:bigint>>")), lambda e: F.coalesce(F.trim(e["text"]) != "", F.lit(False))), 1, MOST_ITEMS)
    start = lambda e: F.greatest(F.coalesce(e["start_ms"], F.lit(0)), F.lit(0))
    heard = F.filter(evidence, lambda e: F.contains(said, folded(F.substring(F.trim(e["text"]), 1, QUOTE))) & ((duration_ms <= 0) | (start(e) <= duration_ms)))

    def clamped(e: Column) -> Column:
        end = F.greatest(start(e), F.coalesce(e["end_ms"], F.lit(0)))
        return F.struct(F.substring(F.trim(e["text"]), 1, QUOTE).alias("text"), start(e).alias("start_ms"), F.when(duration_ms > 0, F.least(end, duration_ms)).otherwise(end).alias("end_ms"))

    confidence = fraction(a["confidence"])
    entities = F.filter(F.coalesce(a["entities"], F.array().cast("array<struct<name:string,type:string>>")), lambda e: F.coalesce(F.trim(e["name"]) != "", F.lit(False)))
    record = F.struct(
        F.coalesce(F.nullif(F.trim(a["content_type"]), F.lit("")), F.lit("unknown")).alias("content_type"),
        F.nullif(F.trim(a["language"]), F.lit("")).alias("language"),
        F.coalesce(a["relevant"], F.lit(True)).alias("relevant"),
        F.substring(F.coalesce(F.trim(a["summary"]), F.lit("")), 1, SUMMARY).alias("summary"),
        F.substring(F.trim(a["main_topic"]), 1, TOPIC).alias("main_topic"),
        one_of(a["sentiment"], SENTIMENTS, "neutral").alias("sentiment"),
        one_of(a["speaker_stance"], STANCES, "unclear").alias("speaker_stance"),
        one_of(a["urgency"], URGENCIES, "normal").alias("urgency"),
        confidence.alias("confidence"),
        stripped(a["key_points"], POINT).alias("key_points"),
        F.slice(F.transform(entities, lambda e: F.struct(F.substring(F.trim(e["name"]), 1, ENTITY).alias("name"), one_of(e["type"], ENTITY_TYPES, "other").alias("type"))), 1, MOST_ITEMS).alias("entities"),
        F.transform(heard, clamped).alias("evidence"),
        (F.coalesce(a["needs_review"], F.lit(False)) | (F.size(heard) < F.size(evidence)) | (confidence < SURE)).alias("needs_review"),
    )
    reason = F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "empty").when(text.isNull(), "not an object")
    return read.withColumn("refused", reason).withColumn("record", F.when(F.col("refused").isNull(), record)).drop("answer_text", "answer", "said")


def fallback_summary(transcript: Column) -> Column:
    """The transcript, or its beginning up to the last whole word within 397 characters and an ellipsis."""
    whole = F.trim(F.coalesce(transcript, F.lit("")))
    head = F.substring(whole, 1, FALLBACK - 3)
    return F.when(F.char_length(whole) > FALLBACK, F.concat(F.regexp_replace(head, "(?s) [^ ]*$", ""), F.lit("..."))).otherwise(whole)


def fallbacks(rows: DataFrame, transcript: Column, keywords: Column, reason: Column) -> DataFrame:
    """Records without a model: the mention stays, and asks for review."""
    return rows.withColumns({"summary": fallback_summary(transcript), "main_topic": F.get(keywords, 0), "entities": F.array_join(F.slice(keywords, 1, MOST_ITEMS), "|"), "sentiment": F.lit("neutral"), "confidence": F.lit(0.0), "needs_review": F.lit(True), "error": F.substring(reason, 1, REASON)})


def verdicts(rows: DataFrame, transcript: Column, threshold: Column, strict: Column) -> DataFrame:
    """Whether a proposed match is accepted: verbatim text, enough confidence, direct or indirect relevance, and for strict
    entities neither a translation nor a topic. rows: is_match, match_type, matched_text, relevance, sentiment, confidence."""
    text = F.nullif(F.trim("matched_text"), F.lit(""))
    verbatim = F.contains(folded(F.coalesce(transcript, F.lit(""))), folded(text))
    kind, relevance = one_of(F.col("match_type"), MATCH_TYPES, "not_relevant"), one_of(F.col("relevance"), RELEVANCES, "not_relevant")
    sure = F.least(F.greatest(F.coalesce(F.col("confidence"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    accepted = F.coalesce("is_match", F.lit(False)) & F.coalesce(verbatim, F.lit(False)) & (sure >= threshold) & relevance.isin("direct", "indirect") & (kind != "not_relevant")
    accepted = accepted & ~(strict & kind.isin("translated_equivalent", "semantic_topic"))
    rows = rows.withColumn("accepted", accepted)
    yes = lambda c, otherwise: F.when(F.col("accepted"), c).otherwise(otherwise)
    return rows.withColumns({"match_type": yes(kind, "not_relevant"), "matched_text": yes(text, None), "relevance": yes(relevance, "not_relevant"), "sentiment": yes(one_of(F.col("sentiment"), SENTIMENTS, "neutral"), "neutral"), "needs_review": sure < F.greatest(threshold, F.lit(0.8))})


def settled(rows: DataFrame) -> DataFrame:
    """Older records: the sentiment of a text that merely names the target is neutral, and asks for review if it only does
    so in passing. rows: sentiment, relevance, confidence, needs_review, key_points (array)."""
    mood, relevance = one_of(F.col("sentiment"), SENTIMENTS, "neutral"), one_of(F.col("relevance"), RELEVANCES, "incidental")
    sure = F.least(F.greatest(F.coalesce(F.col("confidence"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    leaks = relevance.isin("incidental", "not_relevant") & (mood != "neutral")
    points = F.transform(F.coalesce("key_points", F.array().cast("array<string>")), lambda t: F.substring(F.trim(t), 1, 300))
    distinct = F.aggregate(F.filter(points, lambda t: F.coalesce(t != "", F.lit(False))), F.array().cast("array<string>"), lambda acc, t: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(t)), acc).otherwise(F.array_append(acc, t)))
    review = F.coalesce("needs_review", F.lit(False)) | (sure < 0.6) | (leaks & (relevance == "incidental"))
    return rows.select("*", F.when(leaks, "neutral").otherwise(mood).alias("settled_sentiment"), relevance.alias("settled_relevance"), review.alias("settled_review"), F.slice(distinct, 1, 5).alias("settled_points"))


def relabelled(mentions: DataFrame, analyses: DataFrame) -> DataFrame:
    """Mentions with their analysis' label: a mixed one is neutral and asks for review; without one nothing changes."""
    both = mentions.join(analyses.select("mention_id", F.col("sentiment").alias("new")), "mention_id", "left")
    return both.withColumn("needs_review", F.when(F.col("new") == "mixed", True).otherwise(F.col("needs_review"))).withColumn("sentiment", F.when(F.col("new") == "mixed", "neutral").otherwise(F.coalesce("new", "sentiment"))).drop("new")


def stale(cached: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Cached analyses whose transcript has another text now, or is gone. cached: id, transcript_sha256; transcripts: id, text."""
    now = transcripts.select("id", F.sha2("text", 256).alias("now"))
    return cached.join(now, "id", "left").filter(~F.col("transcript_sha256").eqNullSafe(F.col("now"))).drop("now")


def view_of(analyses: DataFrame) -> DataFrame:
    """What a reader is shown: a status word, and JSON lists as lists (an unreadable one is empty). analyses: status, error,
    key_points_json."""
    points = F.coalesce(F.from_json("key_points_json", "array<string>"), F.array().cast("array<string>"))
    shown = F.when(F.col("status").isNull(), "not_analyzed").when(F.col("status") == "error", "failed").when(F.col("status").isin("ready", "fallback"), "ready").otherwise("pending")
    return analyses.withColumn("shown", shown).withColumn("n_points", F.size(points).cast("long")).withColumn("first_point", F.get(points, 0))
