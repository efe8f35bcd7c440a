"""Content type of a transcript from cue words and the kind of audio, as one expression over its normal form.

A null or blank transcript is ``unknown`` with confidence 0; a null kind of audio counts as speech. Whole texts are used.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.text import has_boundaries, normalized_key

# The types from the costliest miss to the cheapest, each with its cues in English, Hindi and Marathi.
CUES = {
    "emergency_alert": (
        "emergency", "evacuate", "evacuation", "take shelter", "severe weather", "tornado warning", "flood warning",
        "amber alert", "this is not a test", "civil defence", "civil defense", "state of emergency", "आपातकाल",
        "चेतावनी", "सतर्क", "तूफान", "बाढ़", "सुरक्षित स्थान", "आणीबाणी", "इशारा", "सावधान",
    ),
    "advertisement": (
        "call now", "order now", "buy now", "limited time", "offer ends", "discount", "% off", "free shipping",
        "visit our", "terms and conditions", "available at", "in stores now", "book your", "sale ends", "hurry",
        "अभी खरीदें", "छूट", "ऑफर", "मुफ्त", "आज ही", "संपर्क करें", "उपलब्ध", "आत्ताच", "सवलत", "मोफत",
    ),
    "announcement": (
        "please note", "we would like to inform", "will be closed", "scheduled for", "reminder that",
        "starting tomorrow", "road closure", "सूचना", "कृपया ध्यान", "घोषणा", "बंद रहेगा", "कृपया लक्ष",
    ),
    "news": (
        "according to", "reported", "officials said", "reuters", "associated press", "correspondent", "headlines",
        "police said", "the government", "prime minister", "president said", "in a statement", "समाचार", "खबर",
        "सूत्रों के अनुसार", "सरकार ने", "पुलिस ने", "प्रधानमंत्री", "बातमी", "सरकारने", "पोलिसांनी",
    ),
    "interview": (
        "thank you for joining", "welcome to the show", "my guest", "tell us about", "let me ask you",
        "joining us now", "in conversation with", "हमारे साथ", "बताइए", "आपका स्वागत", "सवाल", "आमच्यासोबत", "सांगा",
    ),
    "station_identification": (
        "you're listening to", "you are listening to", "this is", "on your radio", "fm", "am", "back after the break",
        "stay tuned", "आप सुन रहे हैं", "रेडियो", "तुम्ही ऐकत आहात",
    ),
    "dj_commentary": (
        "that was", "coming up next", "up next", "great track", "here's", "let's play", "request", "shout out",
        "good morning listeners", "अगला गाना", "सुनते रहिए", "पुढील गाणे",
    ),
}
PRICE = r"(?U)[$€£₹]\s?\d|(?<!\w)\d+\s?(?:%|percent)(?!\w)"
FREQUENCY = r"(?U)\b\d{2,3}\.\d\b"
CUE_WORDS, LYRIC_WORDS, LYRIC_RATIO, IDENT_WORDS, LONG_WORDS = 4, 12, 0.45, 14, 60


@F.pandas_udf(T.StructType([T.StructField("normal", T.StringType()), T.StructField("spaced", T.BooleanType())]))
def normal_form(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"normal": [normalized_key(t) for t in texts], "spaced": [has_boundaries(t) for t in texts]})


def cue_counts(normal: Column) -> Column:
    """Struct with the number of cues of each type that occur as whole words."""
    padded = F.concat(F.lit(" "), normal, F.lit(" "))
    forms = {kind: sorted({normalized_key(c) for c in cues}) for kind, cues in CUES.items()}
    return F.struct(*[reduce(lambda a, b: a + b, [F.contains(padded, F.lit(f" {c} ")).cast("int") for c in cues]).alias(kind) for kind, cues in forms.items()])


def classified(rows: DataFrame, text: str = "text", audio: str = "audio_class") -> DataFrame:
    """Adds content_type and confidence."""
    whole, kind = F.coalesce(text, F.lit("")), F.coalesce(audio, F.lit("speech"))
    seen = rows.withColumn("_f", normal_form(whole))
    seen = seen.withColumn("_c", cue_counts(F.col("_f.normal"))).withColumn("_w", F.when(F.col("_f.spaced"), F.filter(F.split("_f.normal", " "), lambda w: w != "")).otherwise(F.filter(F.split("_f.normal", ""), lambda w: w != "")))
    n = F.size("_w")
    over = kind == "speech_over_music"
    hits = {k: F.col(f"_c.{k}") for k in CUES} | {"advertisement": F.col("_c.advertisement") + whole.rlike(PRICE).cast("int") + over.cast("int")}
    # the most hits win; of equals, the earlier type
    best = F.array_max(F.array(*[F.struct(h.alias("hits"), F.lit(-i).alias("place"), F.lit(k).alias("kind")) for i, (k, h) in enumerate(hits.items())]))
    answer = lambda k, p: F.struct((F.lit(k) if isinstance(k, str) else k).alias("content_type"), (F.lit(p) if isinstance(p, float) else p).alias("confidence"))
    selling = F.when(hits["advertisement"] > 0, hits["advertisement"]).otherwise(hits["announcement"])
    lyrical = (n >= LYRIC_WORDS) & (F.size(F.array_distinct("_w")) / n < LYRIC_RATIO)
    ident = whole.rlike(FREQUENCY) | (hits["station_identification"] > 0)
    decided = (
        F.when(F.col("_f.normal") == "", answer("unknown", 0.0))
        .when(hits["emergency_alert"] > 0, answer("emergency_alert", F.least(F.lit(0.95), 0.6 + 0.15 * hits["emergency_alert"])))
        .when(kind.isin("singing", "music") & (selling > 0), answer("advertisement", F.least(F.lit(0.85), 0.55 + 0.1 * selling)))
        .when(kind.isin("singing", "music"), answer("song_lyrics", F.when(lyrical, 0.75).otherwise(0.55)))
        .when((n < CUE_WORDS) & ident, answer("station_identification", 0.6))
        .when(n < CUE_WORDS, answer("unknown", 0.2))
        .when((best["hits"] == 0) & over, answer("dj_commentary", 0.35))
        .when(best["hits"] == 0, F.when(n >= LONG_WORDS, answer("discussion", 0.35)).otherwise(answer("unknown", 0.25)))
        .when((best["kind"] == "station_identification") & (n > IDENT_WORDS), answer(F.when(over, "dj_commentary").otherwise("discussion"), 0.4))
        .otherwise(answer(best["kind"], F.least(F.lit(0.9), 0.5 + 0.12 * best["hits"])))
    )
    return seen.withColumn("_d", decided).select(*rows.columns, "_d.content_type", F.round("_d.confidence", 4).alias("confidence"))
