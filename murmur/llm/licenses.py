"""License scans: passages compared with license templates by Dice coefficient over word bigrams.

Text and templates are lower-cased and reduced to words of letters and digits, so line breaks, comment marks and
punctuation don't matter: a notice is found on a line of its own, inside a longer line, or wrapped over several. A
template of n words is compared with every window of n words that begins with one of its bigrams (at the end of a text,
with what is left of it); the coefficient is that of the two sets of distinct bigrams. Of the windows that reach the
threshold and overlap, the one that shares most bigrams stays (then by coefficient, name and place).

Two bounds prune, and drop nothing. A window can reach threshold t only if it holds t / (2 - t) of a template's bigrams,
so it holds one of any larger rest of them: one regular expression over each template's longest bigrams rules out most
texts. In the others, a window is looked at only if that many hits lie within its length.

Edge cases: a null or empty text, or one of fewer than two words, matches nothing; repeated rows and equal passages are
reported each; null doc_ids stay null; an empty table gives an empty one; further columns are ignored. Whole texts are
scanned, however long; the work on one text grows with its length and its number of hits, and each window taken copies a
byte a word of the text (10,000 notices: some eight seconds beyond planning).
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, let

THRESHOLD = 0.8
# The notices by which licenses are declared.
NOTICES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def texts_of(folder: Path) -> dict[str, str]:
    """License texts and file headers by name: one file each."""
    return {f.stem: f.read_text() for f in sorted(folder.glob("*.txt"))}


#: Templates by license and kind.
TEMPLATES = {f"{k}/notice": v for k, v in NOTICES.items()} | {f"{k}/text": v for k, v in texts_of(Path(__file__).parent / "license_texts").items()}


def bigrams(text: str) -> list[str]:
    """Every bigram of a template, in order."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def least_shared(n: int, threshold: float) -> int:
    """Fewest of a template's n distinct bigrams that a window which reaches the threshold holds."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9)


def marks(text: str, threshold: float) -> list[str]:
    """Bigrams of a template one of which every window that reaches the threshold holds: the longest ones."""
    known = sorted(set(bigrams(text)), key=lambda b: (-len(b), b))
    return known[: len(known) - least_shared(len(known), threshold) + 1]


def any_of(phrases: list[str]) -> str:
    """A regular expression for one of the phrases, branching letter by letter."""

    def branch(rest: list[str]) -> str:
        if rest == [""]:
            return ""
        heads = sorted({r[:1] for r in rest})
        parts = [h + branch(sorted({r[1:] for r in rest if r[:1] == h})) if h else "" for h in heads]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return branch(sorted(set(phrases)))


def windows(name: str, text: str, pairs: Column, hits: Column, threshold: float) -> Column:
    """The windows of one template that reach the threshold. pairs: a text's bigrams; hits: place and bigram of those that
    any template has."""
    every = bigrams(text)
    known, span = sorted(set(every)), len(every)
    least = least_shared(len(known), threshold)
    own = F.transform(F.filter(hits, lambda h: h["pair"].isin(known)), lambda h: h["at"])

    def scored(at: Column) -> Column:
        # slice() copies the whole array first: places are looked up one by one
        held = F.array_distinct(F.transform(F.sequence(at, F.least(at + span, F.size(pairs)) - 1), lambda i: F.get(pairs, i)))
        shared = F.size(F.array_intersect(held, F.array(*map(F.lit, known))))
        dice = F.round(2 * shared / (F.size(held) + len(known)), 6)
        end = F.least(at + span, F.size(pairs)) + 1
        return F.struct((-shared).alias("rank"), (-dice).alias("rank_dice"), F.lit(name).alias("template"), at.alias("start"), end.alias("end"), F.size(held).alias("n"))

    def reaching(places: Column) -> Column:
        near = F.transform(places, lambda at, i: F.when(F.get(places, i + least - 1) < at + span, at))
        return F.filter(F.transform(F.filter(near, lambda at: at.isNotNull()), scored), lambda w: -2 * w["rank"] >= threshold * (w["n"] + len(known)))

    return F.when(F.size(own) >= least, let(own, reaching))


def chosen(found: Column, longest: int) -> Column:
    """Of the ranked windows, each that overlaps none taken before it. A byte a word tells what is taken, a window's first
    word apart from its others; a window looks at its own words only, and one that is taken writes them."""
    free, taken = F.lit(b"0" * longest), F.lit(b"2" + b"1" * (longest - 1))
    words = F.repeat(F.lit("0"), F.coalesce(F.array_max(F.transform(found, lambda w: w["end"])), F.lit(0))).cast("binary")
    size = lambda w: w["end"] - w["start"]
    holds = lambda held, w, what: F.substring(held, w["start"] + 1, size(w)) == F.substring(what, F.lit(1), size(w))
    written = lambda held, w: F.overlay(held, F.substring(taken, F.lit(1), size(w)), w["start"] + 1, size(w))
    held = F.aggregate(found, words, lambda held, w: F.when(holds(held, w, free), written(held, w)).otherwise(held))
    whole = lambda held, w: holds(held, w, taken) & (F.substring(held, w["end"] + 1, F.lit(1)) != F.lit(b"1"))
    # of several windows over the same words the first one is meant
    placed = let(held, lambda held: F.array_sort(F.transform(F.filter(found, lambda w: whole(held, w)), lambda w: F.struct(w["start"].alias("at"), w.alias("w")))))
    first = lambda ws: F.filter(ws, lambda x, i: (i == 0) | (F.get(ws, i - 1)["at"] != x["at"]))
    return F.transform(let(placed, first), lambda x: x["w"])


def matches(df: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, template, start and n_words of the passage in words, n_shared bigrams, dice. templates: name
    (license, slash, kind) to text."""
    templates = templates or TEMPLATES
    guard = " " + any_of([m for t in templates.values() for m in marks(t, threshold)]) + " "
    rows = id_and_text(df).select("doc_id", F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), "[^\\p{L}\\p{N}]+", " ")), F.lit(" ")).alias("clean")).filter(F.col("clean").rlike(guard))
    words = F.split(F.trim("clean"), " ")
    neighbours = lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    every = sorted({b for t in templates.values() for b in bigrams(t)})
    longest = max(len(bigrams(t)) for t in templates.values()) + 1
    none = F.array().cast("array<struct<rank:int,rank_dice:double,template:string,start:int,end:int,n:int>>")

    # one expression from words to windows, each part bound once: as columns of their own they would be worked out anew
    # wherever a later step names them
    def placed(pairs: Column) -> Column:
        hits = F.filter(F.transform(pairs, lambda b, i: F.struct(F.when(b.isin(every), b).alias("pair"), i.alias("at"))), lambda h: h["pair"].isNotNull())
        return let(hits, lambda h: ranked(pairs, h))

    def ranked(pairs: Column, hits: Column) -> Column:
        found = [F.coalesce(windows(k, templates[k], pairs, hits, threshold), none) for k in sorted(templates)]
        return let(F.array_sort(F.concat(*found)), lambda f: chosen(f, longest))

    taken = let(words, lambda w: let(neighbours(w), placed))
    one = rows.select("doc_id", F.explode(taken).alias("w"))
    return one.select("doc_id", F.substring_index("w.template", "/", 1).alias("license"), F.col("w.template").alias("template"), F.col("w.start").cast("long").alias("start"), (F.col("w.end") - F.col("w.start")).cast("long").alias("n_words"), (-F.col("w.rank")).cast("long").alias("n_shared"), (-F.col("w.rank_dice")).alias("dice"))
