"""Script-aware normal form with source offsets, keys derived from it, and helpers that read spans of the original text.

The normal form of a text drops invisible characters, applies NFKC and casefold to each character, drops marks unless the
text's main script needs them, and writes white space and separators as single spaces. Offsets count code points.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scripts whose marks carry meaning, scripts without word boundaries, separators, invisible characters.
MARK_SCRIPTS = frozenset("DEVANAGARI BENGALI GURMUKHI GUJARATI ORIYA TAMIL TELUGU KANNADA MALAYALAM SINHALA THAI LAO TIBETAN MYANMAR KHMER".split())
OPEN_SCRIPTS = frozenset("HAN HIRAGANA KATAKANA THAI LAO KHMER MYANMAR TIBETAN".split())
SEPARATORS = frozenset("Pc Pd Pe Pf Pi Po Ps Sm Sk So Sc".split())
INVISIBLE = ((0x00AD, 0x00AD), (0x180E, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x2069), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB))


def is_invisible(ch: str) -> bool:
    return any(a <= ord(ch) <= b for a, b in INVISIBLE)


@functools.lru_cache(maxsize=65_536)
def script_of(ch: str) -> str:
    name = unicodedata.name(ch, "")
    return "HAN" if name.startswith(("CJK", "IDEOGRAPHIC")) else name.split(" ")[0]


def dominant_script(text: str) -> str:
    """The script of most letters; the first seen wins a tie. Distinct characters are looked up once each."""
    if text.isascii():
        return "LATIN" if any(map(str.isalpha, text)) else "COMMON"
    counts: dict[str, int] = {}
    for ch, n in Counter(text).items():  # in the order of first occurrence
        if ch.isalpha():
            s = script_of(ch)
            counts[s] = counts.get(s, 0) + n
    return max(counts, key=counts.get) if counts else "COMMON"


def has_boundaries(text: str) -> bool:
    return dominant_script(text) not in OPEN_SCRIPTS


class _Folded(dict):
    """What one source character becomes; a space stands for white space and separators."""

    def __init__(self, fold: bool):
        self.fold = fold

    def __missing__(self, ch: str) -> str:
        out = []
        for c in "" if is_invisible(ch) else unicodedata.normalize("NFKC", ch).casefold():
            kind = unicodedata.category(c)
            if kind[0] == "M":
                out.append("" if self.fold else c)
            elif c.isspace() or kind in SEPARATORS:
                out.append(" ")
            elif self.fold:
                out += [x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)]
            else:
                out.append(c)
        if len(self) < 200_000:
            self[ch] = "".join(out)
        return "".join(out)


_FOLDED = {fold: _Folded(fold) for fold in (True, False)}


def normal_form(text: str, fold: bool | None = None) -> tuple[str, np.ndarray]:
    """The normal form, and for each of its characters the index of its source."""
    fold = dominant_script(text) not in MARK_SCRIPTS if fold is None else fold
    parts = list(map(_FOLDED[fold].__getitem__, text))
    plain = "".join(parts)
    if not plain:
        return "", np.zeros(0, dtype=np.int64)
    source = np.arange(len(text)) if len(plain) == len(text) and "" not in parts else np.repeat(np.arange(len(text)), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
    space = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) == 32
    keep = ~(space & np.concatenate([[True], space[:-1]]))  # a run of spaces is one, none begins the form
    words = plain.split(" ")
    out = " ".join(w for w in words if w)
    at = source[keep]
    return out, at[: len(out)]


def normalize(text: str, fold: bool | None = None) -> tuple[str, list[int]]:
    plain, at = normal_form(text, fold)
    return plain, at.tolist()


def normalized_key(text: str) -> str:
    return normal_form(text)[0]


def variant_keys(text: str) -> list[str]:
    """Distinct forms worth indexing: by the script's own rule, with marks folded, with marks kept."""
    return [k for k in dict.fromkeys(normal_form(text, fold)[0] for fold in (None, True, False)) if k]


def token_set(text: str) -> set[str]:
    """Words of the normal form; none in scripts without word boundaries."""
    return set(normalized_key(text).split()) if has_boundaries(text) else set()


def legacy_key(text: str) -> str:
    """Words after NFKD and casefold, joined by spaces."""
    return " ".join(re.findall(r"\w+", unicodedata.normalize("NFKD", text).casefold()))


def slug(text: str, most: int = 48) -> str:
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return (re.sub(r"[^a-z0-9]+", "-", plain).strip("-") or "keyword")[:most]


def identifier_key(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold().strip()


def is_boundary(text: str, at: int) -> bool:
    return at <= 0 or at >= len(text) or not (text[at - 1].isalnum() and text[at].isalnum())


def original_span(text: str, phrase: str) -> tuple[int, int] | None:
    """Where the original text holds a phrase by normal form, its end extended to the end of the word."""
    plain, at = normal_form(text)
    key = normalized_key(phrase)
    start = plain.find(key) if key else -1
    if start < 0:
        return None
    end = int(at[start + len(key) - 1]) + 1
    while end < len(text) and text[end].isalnum():
        end += 1
    return int(at[start]), end


def exact_span(text: str, phrase: str) -> tuple[int, int] | None:
    """A phrase as a whole word of the original text whatever its case, else by normal form between word ends."""
    phrase = phrase.strip()
    if not phrase:
        return None
    if m := re.search(rf"(?<!\w){re.escape(phrase)}(?!\w)", text, re.IGNORECASE):
        return m.span()
    plain, at = normal_form(text)
    key = normalized_key(phrase)
    start = plain.find(key) if key else -1
    while start >= 0:
        end = start + len(key)
        if is_boundary(plain, start) and is_boundary(plain, end):
            return int(at[start]), int(at[end - 1]) + 1
        start = plain.find(key, start + 1)
    return None


def highlight_span(text: str, phrase: str) -> tuple[int, int] | None:
    """A phrase as it stands, else whatever its case."""
    at = text.find(phrase) if phrase else -1
    if at >= 0:
        return at, at + len(phrase)
    m = re.search(re.escape(phrase), text, re.IGNORECASE) if phrase else None
    return m.span() if m else None


def sentence_around(text: str, start: int, end: int) -> str:
    """The sentence that holds a span: from behind the last end mark before it to the first one after it that white space
    follows."""
    a = max(text.rfind(mark, 0, start) for mark in ".!?\n") + 1
    stop = re.compile(r"[.!?]+(?=\s|$)|\n").search(text, end)
    return text[a : stop.end() if stop else len(text)].strip()


def _mapped(f, kind):
    @F.pandas_udf(kind)
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series([f(t) if t is not None else None for t in texts], dtype=object)

    return apply


def keys(text: Column, form: str) -> Column:
    """One of the key forms of a text column: normalized, casefold, legacy, slug, identifier; null stays null."""
    forms = {"normalized": normalized_key, "casefold": str.casefold, "legacy": legacy_key, "slug": slug, "identifier": identifier_key}
    return _mapped(forms[form], T.StringType())(text)


def variants(text: Column) -> Column:
    return _mapped(variant_keys, T.ArrayType(T.StringType()))(text)


def boundaries(text: Column) -> Column:
    return _mapped(has_boundaries, T.BooleanType())(text)


def spans(text: Column, phrase: Column, how: str) -> Column:
    """Struct start, end of a phrase in a text (null if it isn't there): how is exact, normal or highlight. One text of a
    batch at a time is a Python string."""
    find = {"exact": exact_span, "normal": original_span, "highlight": highlight_span}[how]

    @F.arrow_udf("start int, end int")
    def apply(texts: pa.Array, phrases: pa.Array) -> pa.Array:
        found = [find(t.as_py(), p.as_py()) if t.is_valid and p.is_valid else None for t, p in zip(texts, phrases, strict=True)]
        return pa.StructArray.from_arrays([pa.array([f[i] if f else None for f in found], pa.int32()) for i in (0, 1)], names=["start", "end"])

    return F.when(text.isNotNull() & phrase.isNotNull(), apply(text, phrase))


def laid_out(sizes: Column) -> Column:
    """Array of struct start_char, end_char of parts that follow each other with one character between them. sizes: an array
    of the parts' sizes."""

    @F.arrow_udf("array<struct<start_char:int,end_char:int>>")
    def apply(listed: pa.Array) -> pa.Array:
        count = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
        size = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.append(0, np.cumsum(size + 1))
        first = np.append(0, np.cumsum(count))
        end = upto[1:] - 1 - np.repeat(upto[first[:-1]], count)
        parts = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (end - size, end)], names=["start_char", "end_char"])
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), parts)

    return apply(F.coalesce(sizes, F.array().cast("array<int>")))


def entity_id(text: Column) -> Column:
    return F.concat(F.lit("api-"), keys(text, "slug"), F.lit("-"), F.substring(F.sha2(keys(text, "legacy"), 256), 1, 10))


def sentences(text: Column, start: Column, end: Column) -> Column:
    """The sentence around a span of code points; null where the span is."""

    @F.arrow_udf(T.StringType())
    def apply(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        return pa.array((sentence_around(t.as_py(), a, b) for t, a, b in zip(texts, starts.to_pylist(), ends.to_pylist(), strict=True)), pa.string())

    return F.when(text.isNotNull() & start.isNotNull() & end.isNotNull(), apply(F.coalesce(text, F.lit("")), F.coalesce(start, F.lit(0)), F.coalesce(end, F.lit(0))))


def stable_shard(text: Column, shards: int) -> Column:
    """The shard of an id by BLAKE2b over 8 bytes, read big-endian."""
    return _mapped(lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") % shards, T.LongType())(text)
