"""Periodic runs of words by recompression: a run-length grammar over each text, whose longest common extensions tell runs.

A run is a stretch of words with smallest period q (words q apart are equal) and a length of at least ``LEAST`` words and
``TIMES`` periods that no neighbouring word extends.

The words of some texts, each text closed by a mark of its own, are the lowest level of one grammar. Levels alternate: a
block level replaces each stretch of one repeated symbol by a symbol for it and its length, a pair level deals the
symbols into left and right ones and replaces each left one that a right one follows by a symbol for the two. Equal
stretches of words become equal symbols but for a bounded number at either end of each level, so the longest common
extension of two places climbs while the symbols agree and descends where they first differ: a few steps a level.
Neither suffix arrays nor word-by-word extension are needed, and all questions of a level are answered together.

A run of period q has at least 3q places whose word recurs q words later, so one of them is a multiple of 3q: these
places, n/(3q) for each period, are the grid whose number sums to n log n. Places of the grid whose words agree are
candidates; the extensions forwards and backwards give their whole stretch, and the least period of a stretch stays.

``scan`` gives each text's runs and its words without the repeats; ``collapse`` replaces the texts of a table.

Edge cases: a null or empty text, or one of white space, has no runs and collapses to the empty text; every row of equal
ones gets the same; null doc_ids stay null; an empty table gives an empty one; ``collapse`` passes further columns
through, ``scan`` ignores them. A text is held whole by its task (some 150 bytes a word while it is worked on).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAPS, id_and_text, sliced, unused

LEAST, TIMES = 6, 4
_WORDS = re.compile(f"[^{GAPS}]+")
#: Candidates answered in one step.
STEP = 1 << 19
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Level:
    """Symbols of one level, the place of each in the level above, and the first place below of each symbol above."""

    def __init__(self, symbols: np.ndarray, blocks: bool = False, above: np.ndarray | None = None, first: np.ndarray | None = None):
        self.symbols, self.blocks, self.above, self.first = symbols, blocks, above, first

    def mirrored(self) -> Level:
        if self.above is None:
            return Level(self.symbols[::-1])
        n, up = len(self.symbols), len(self.first) - 1
        return Level(self.symbols[::-1], self.blocks, (up - 1 - self.above)[::-1], n - self.first[::-1])

    def after(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next places that may differ, after equal symbols at x and y: one on, or past what both blocks still hold."""
        step = np.minimum(self.first[self.above[x] + 1] - x, self.first[self.above[y] + 1] - y) if self.blocks else 1
        return x + step, y + step


def _sides(symbols: np.ndarray, salt: int) -> np.ndarray:
    """True for the left symbols of a pair level: one bit of a multiplicative hash."""
    h = (symbols.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(47)) & np.uint64(1) == 1


def grammar(symbols: np.ndarray) -> list[Level]:
    """Levels from the words (numbers from 0) up to one symbol a text; negative symbols are marks, each of them once."""
    levels, blocks, salt = [], True, 0
    names = int(symbols.max(initial=-1)) + 1
    while True:
        words = symbols >= 0
        same = np.zeros(len(symbols), dtype=bool)
        if blocks:
            same[1:] = symbols[1:] == symbols[:-1]
        else:
            if not (words[1:] & words[:-1]).any():
                break
            salt += 1
            left = _sides(symbols, salt)
            same[1:] = left[:-1] & ~left[1:] & words[1:] & words[:-1]
        if same.any():
            first = np.flatnonzero(~same)
            size = np.diff(np.append(first, len(symbols)))
            made = np.flatnonzero(size > 1)
            upper = symbols[first]
            second = size[made] if blocks else symbols[first[made] + 1]
            _, which = np.unique(upper[made] * np.int64(max(names, len(symbols)) + 1) + second, return_inverse=True)
            upper[made] = names + which
            names += int(which.max()) + 1
            levels.append(Level(symbols, blocks, np.cumsum(~same) - 1, np.append(first, len(symbols))))
            symbols = upper
        blocks = not blocks
    return [*levels, Level(symbols)]


def extensions(levels: list[Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words from x[i] on equal those from y[i] on. A mark always lies between, so every answer ends."""
    out = np.zeros(len(x), dtype=np.int64)
    ask = np.arange(len(x))
    x0, x, y = x, x.copy(), y.copy()
    parted: list[tuple] = []
    top = len(levels) - 1
    for k, level in enumerate(levels):
        done = []
        while len(ask):
            if k < top:
                up_x, up_y = level.above[x], level.above[y]
                climb = (level.first[up_x] == x) & (level.first[up_y] == y)
                done.append((ask[climb], up_x[climb], up_y[climb]))
                ask, x, y = ask[~climb], x[~climb], y[~climb]
            apart = level.symbols[x] != level.symbols[y]
            parted.append((k, ask[apart], x[apart], y[apart]))
            ask, x, y = ask[~apart], x[~apart], y[~apart]
            x, y = level.after(x, y)
        if k < top:
            ask, x, y = (np.concatenate(c) for c in zip(*done, strict=True)) if done else (ask, x, y)
    held = [np.zeros(0, dtype=np.int64)] * 3
    for k in range(top, -1, -1):
        level = levels[k]
        if k < top and len(held[0]):
            ask, x, y = held[0], level.first[held[1]], level.first[held[2]]
            stay: list[tuple] = []
            while len(ask):
                apart = level.symbols[x] != level.symbols[y]
                stay.append((ask[apart], x[apart], y[apart]))
                ask, x, y = ask[~apart], x[~apart], y[~apart]
                x, y = level.after(x, y)
            held = [np.concatenate(c) for c in zip(*stay, strict=True)]
        held = [np.concatenate([held[i], *(p[i + 1] for p in parted if p[0] == k)]) for i in range(3)]
    out[held[0]] = held[1] - x0[held[0]]
    return out


def _grid(sizes: np.ndarray, starts: np.ndarray, words: np.ndarray):
    """Candidates (place, period) of all texts whose words agree, about STEP grid places at a time: for each period q up
    to a quarter of a text, the places 0, 3q, 6q, ... that have a word q later."""
    for q in range(1, int(sizes.max(initial=0)) // TIMES + 1):
        long = np.flatnonzero(sizes >= max(LEAST, TIMES * q))
        count = (sizes[long] - q - 1) // (3 * q) + 1
        ends = np.cumsum(count)
        for a in range(0, int(ends[-1]), STEP):
            at = np.arange(a, min(a + STEP, int(ends[-1])))
            text = np.searchsorted(ends, at, side="right")
            place = starts[long[text]] + (at - (ends[text] - count[text])) * 3 * q
            hit = words[place] == words[place + q]
            if hit.any():
                yield place[hit], q


def runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Rows start, length, period of the runs of each text (word numbers), by start, then period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not sizes.max(initial=0) >= LEAST:
        return [np.zeros((0, 3), dtype=np.int64)] * len(texts)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) + 1
    total = int(starts[-1] + sizes[-1]) + 1
    symbols = -np.arange(1, total + 1, dtype=np.int64)  # a mark before, between and after the texts
    for s, t in zip(starts.tolist(), texts, strict=True):
        symbols[s : s + len(t)] = t
    levels = grammar(symbols)
    mirror = [level.mirrored() for level in levels]
    found, places, periods, held = [], [], [], 0

    def settle():
        x, q = np.concatenate(places), np.concatenate(periods)
        after = extensions(levels, x, x + q)
        before = extensions(mirror, total - x, total - x - q)
        start, length = x - before, before + after + q
        whole = length >= np.maximum(LEAST, TIMES * q)
        found.append(np.unique(np.stack([start[whole], length[whole], q[whole]], axis=1), axis=0))

    for place, q in _grid(sizes, starts, symbols):
        places.append(place)
        periods.append(np.full(len(place), q))
        held += len(place)
        if held >= STEP:
            settle()
            places, periods, held = [], [], 0
    if held:
        settle()
    every = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), dtype=np.int64)
    least = np.ones(len(every), dtype=bool)  # the same stretch under a multiple of its period
    least[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[least]
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    text = np.searchsorted(starts, every[:, 0], side="right") - 1
    every[:, 0] -= starts[text]
    return np.split(every, np.searchsorted(text, np.arange(1, len(texts))))


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Words in no run after its first period."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    return np.cumsum(depth)[:n] == 0


def _scanned(texts: list[str | None]):
    """Runs and collapsed text of each text."""
    for a, b in sliced([t or "" for t in texts]):
        words = [_WORDS.findall(t or "") for t in texts[a:b]]
        numbers, _ = pd.factorize(np.array([w for text in words for w in text], dtype=object)) if any(words) else (np.zeros(0, dtype=np.int64), None)
        split = np.split(numbers.astype(np.int64), np.cumsum([len(w) for w in words])[:-1])
        for text, found in zip(words, runs(split), strict=True):
            if len(found):
                text = [text[i] for i in np.flatnonzero(kept(len(text), found)).tolist()]
            yield found, " ".join(text)


def _columns(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    done = list(_scanned(texts.to_pylist()))
    rows = np.concatenate([f for f, _ in done]) if done else np.zeros((0, 3), dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum([len(f) for f, _ in done])]).astype(np.int32)
    parts = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(ends), parts), pa.array([t for _, t in done], pa.string())


def scan(df: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start, then period) and collapsed (text) of each row."""

    def run(batches):
        for batch in batches:
            found, collapsed = _columns(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found, collapsed], names=["doc_id", "runs", "collapsed"])

    return id_and_text(df).mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")


def collapse(df: DataFrame, text: str = "text") -> DataFrame:
    """df with each text that has a run replaced by its words without the repeats; other texts stay as they are."""

    @F.pandas_udf("struct<n:int,collapsed:string>")
    def short(texts: pd.Series) -> pd.DataFrame:
        done = list(_scanned(texts.tolist()))
        return pd.DataFrame({"n": [len(f) for f, _ in done], "collapsed": [t for _, t in done]})

    (made,) = unused(df, "collapsed")
    out = df.withColumn(made, short(F.coalesce(F.col(text), F.lit(""))))
    return out.withColumn(text, F.when(F.col(made)["n"] > 0, F.col(made)["collapsed"]).otherwise(F.col(text))).drop(made)


def repeated(doc_id: Column, text: Column) -> Column:
    """Text in which, for a tenth of the ids by CRC-32, the words from a place on repeat their first ones: the known
    repetitions of the query's contract. Other texts, and those of null ids, stay."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def made(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.when(n > 0, F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + F.pmod(i - a, p)).cast("int")))), " ")).otherwise("")

    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.when(F.pmod(h, F.lit(10)) == 0, F.element_at(F.transform(F.array(words), made), 1)).otherwise(text)
