"""Document fingerprints by spot signatures: chains of content words that follow common words.

Words are lower-cased runs of letters, digits and underscores. Each anchor (a common word) starts a chain of the next
two words that aren't anchors; the 32-bit hash of anchor and chain is a spot. A document's fingerprint is the set of
its spots, written as ascending eight-digit hexadecimal numbers; a text without spots has the hash of all its words as
the only one. Likeness is the Jaccard coefficient, given up early when the sizes rule the threshold out.

``edited_pairs`` compares each document with an edit of itself and with its neighbour in descending doc_id order: the
ids are cut into ranges at quantiles, a doc_id of many rows by its texts' hashes, and equal rows of which there are many
into several ranges by their places; each range goes to one task in order, and only the head of a range is sent to the
range above as well, so texts are shuffled once. ``similar_pairs`` partitions fingerprints by set length (a pair's
lengths must be in the same or neighbouring partitions) and compares those that share one of their rarest spots; where
very many share one, they are dealt into blocks, each pair of blocks a join key of its own. It works on 64-bit spots.

Edge cases: a null or empty text has the empty fingerprint, like (1.0) to another empty one only; equal texts have equal
fingerprints (and so may, rarely, texts whose spots' 32-bit hashes agree); rows of equal doc_id are neighbours in falling
order of their texts' 64-bit hash, null doc_ids come last; a single document is its own neighbour; an empty table gives an
empty one; further columns are ignored. In ``similar_pairs`` and ``linked`` every row counts, whatever its doc_id: classes
of equal fingerprints are numbered, so one doc_id over several texts is in several classes, rows without doc_id are in
theirs, and the empty fingerprint is a class without links.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, id_and_text, sliced, stored, tidied

# Frequent words of the four languages.
ANCHORS = (
    "the of and to in a is that for it was on are as with be at from or an "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de et un une est que qui dans en du pour pas au sur se elle il "
    "el los y por con para del las su al lo mi no es"
).split()
CHAIN = 2
SIMILAR = 0.75
_LEAST_ID, _MOST = -(1 << 63), (1 << 63) - 1
#: Bytes of text and number of ranges at most of the ordered comparison; rows of a block of an often shared spot.
RANGE_BYTES, MOST_RANGES, BLOCK = 32 << 20, 10_000, 500
#: Bytes of text whose words are held at once by a task that makes fingerprints.
SLICE_BYTES = 1 << 20
_WORD = re.compile(r"\w+")


def spots(texts: list[str], anchors=None, wide: bool = False) -> list[np.ndarray]:
    """Ascending distinct spots of each text, 64 bits each if ``wide``."""
    marks = pd.util.hash_array(np.array(sorted(set(anchors or ANCHORS)), dtype=object), categorize=False)
    words = [_WORD.findall(t.lower()) for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.array(list(chain.from_iterable(words)), dtype=object)
    hashed = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, dtype=np.uint64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    common = np.isin(hashed, marks)
    content = np.flatnonzero(~common)
    at = np.flatnonzero(common)
    first = np.searchsorted(content, at)
    whole = first + CHAIN <= len(content)
    at, first = at[whole], first[whole]
    last = content[first + CHAIN - 1]
    inside = doc[last] == doc[at]
    at, first = at[inside], first[inside]
    value = hashed[at]
    for k in range(CHAIN):
        value = (value ^ (value >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashed[content[first + k]]
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    if not wide:
        value = (value >> np.uint64(32)).astype(np.uint32)
    ends = np.searchsorted(doc[at], np.arange(len(texts)), side="right")
    out, a = [], 0
    for i, b in enumerate(ends.tolist()):
        if b > a:
            out.append(np.unique(value[a:b]))
        elif texts[i]:
            out.append(np.frombuffer(hashlib.blake2b(" ".join(words[i]).encode() or texts[i].encode(), digest_size=8 if wide else 4).digest(), dtype=value.dtype.newbyteorder("<")))
        else:
            out.append(np.zeros(0, dtype=value.dtype))
        a = b
    return out


def written(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard coefficient; 0.0 without comparing if the sizes keep it under ``least``."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


def _bounds(keys: DataFrame) -> tuple[list[tuple[int, int]], list[int]]:
    """Upper ends (k, h) of the ranges but the last, and the number of ranges that each is cut into by place. keys: k, h,
    size (bytes of text)."""
    of = keys.agg(F.count("*").alias("n"), F.sum("size").alias("size")).head()
    n = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, (of["size"] or 0) // RANGE_BYTES))
    held = keys.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 100_000).alias("q")).head()["q"] or [] if n > 1 else []
    bounds = set()
    for k, times in zip(*(x.tolist() for x in np.unique(np.array(held, dtype=np.int64), return_counts=True)), strict=True):
        bounds.add((k, _MOST))
        if times > 1:
            bounds |= {(k - 1, _MOST), *((k, _LEAST_ID + (j << 64) // times) for j in range(1, times))}
    often = keys.groupBy("k", "h").agg(F.count("*").alias("rows")).filter(F.col("rows") * n > of["n"]).collect()  # fewer than n
    cut = {}
    for r in often:
        bounds |= {(r["k"], r["h"]), (r["k"], r["h"] - 1)}
        cut[r["k"], r["h"]] = -(-r["rows"] * n // of["n"])
    ends = sorted(bounds)
    return ends, [cut.get(e, 1) for e in ends] + [1]


def in_order(df: DataFrame) -> DataFrame:
    """Rows dealt into ranges of doc_id and text hash, sorted descending in each task: range, sentinel, k, h, doc_id, text.
    The row after a range's last one, as ``sentinel``, is the head of the next non-empty range below; after the lowest
    comes the highest. Rows of one key that would fill several ranges are dealt to as many by their places: each of these
    ranges holds equal rows only, so any of them is the head."""
    keyed = id_and_text(df).withColumn("k", F.coalesce("doc_id", F.lit(_LEAST_ID))).withColumn("h", F.xxhash64("text"))
    keys = stored(keyed.select("k", "h", F.octet_length("text").cast("long").alias("size")), "keys")
    ends, cuts = _bounds(keys)
    first = np.concatenate([[0], np.cumsum(cuts)]).tolist()

    def ranges(k: pd.Series, h: pd.Series):
        """Key and range of each row; the rows of a cut range take turns."""
        turn: dict[int, int] = {}
        at = 7919 * TaskContext.get().partitionId()
        for key in zip(k.tolist(), h.tolist(), strict=True):
            i = bisect.bisect_left(ends, key)
            if cuts[i] > 1:
                turn[i] = (turn.get(i, at) + 1) % cuts[i]
            yield key, first[i] + turn.get(i, 0)

    @F.pandas_udf(T.IntegerType())
    def range_of(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([r for _, r in ranges(k, h)], dtype=np.int32)

    heads = {r["r"]: tuple(r["head"]) for r in keys.select(range_of("k", "h").alias("r"), F.struct("k", "h").alias("x")).groupBy("r").agg(F.max("x").alias("head")).collect()}  # one row a range
    for i, n in enumerate(cuts):
        if n > 1:  # which of these get rows depends on the batches: all may
            heads |= {first[i] + j: ends[i] for j in range(n)}
    discard(keys)
    order = sorted(heads)
    above: dict[tuple[int, int], list[int]] = {}
    for i, r in enumerate(order):
        above.setdefault(heads[r], []).append(order[(i + 1) % len(order)])

    @F.pandas_udf("array<struct<range:int,sentinel:boolean>>")
    def places(k: pd.Series, h: pd.Series) -> pd.Series:
        out, sent = [], set()
        for key, r in ranges(k, h):
            row = [{"range": r, "sentinel": False}]
            if key in above and key not in sent:  # once a batch: of equal rows one is enough
                sent.add(key)
                row += [{"range": x, "sentinel": True} for x in above[key]]
            out.append(row)
        return pd.Series(out, dtype=object)

    dealt = keyed.withColumn("place", F.explode(places("k", "h"))).select("place.range", "place.sentinel", "k", "h", "doc_id", "text")
    return dealt.repartitionById(first[-1], "range").sortWithinPartitions("range", "sentinel", F.desc("k"), F.desc("h"))


def edited_pairs(df: DataFrame, anchors=None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("range", "sentinel", "doc_id", "text")), strict=True))
            if held is not None:
                rows.insert(0, held)
            held = rows[-1]
            for a, b in sliced([r[3] for r in rows[:-1]]):
                own = spots([r[3] for r in rows[a : b + 1]], anchors)
                pairs = [i for i in range(a, b) if not rows[i][1]]
                edits = []
                for i in pairs:
                    text, after = rows[i][3], rows[i + 1][3]
                    half = len(text) // 2
                    edits.append(text[: len(text) - half] + after[:half])
                marks = spots(edits, anchors)
                cols = [
                    pa.array([rows[i][2] for i in pairs], pa.int64()),
                    pa.array([len(rows[i][3]) for i in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
                    pa.array([written(own[i - a]) for i in pairs], pa.string()),
                    pa.array([written(m) for m in marks], pa.string()),
                    pa.array([likeness(own[i - a], m) for i, m in zip(pairs, marks, strict=True)], pa.float64()),
                    pa.array([likeness(own[i - a], own[i - a + 1]) for i in pairs], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return in_order(df).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(df: DataFrame, anchors=None) -> DataFrame:
    """doc_id, spots (64 bits each, array of long) and mark (MD5 of them) of each row."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in _slices(pc.binary_length(texts).to_pylist()):  # Python strings of one slice at a time
                found = spots(texts.slice(a, b - a).to_pylist(), anchors, wide=True)
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = pa.array(np.concatenate(found).view(np.int64))
                marks = [hashlib.md5(s.tobytes()).digest() for s in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(marks, pa.binary())], names=["doc_id", "spots", "mark"])

    return id_and_text(df).mapInArrow(run, "doc_id long, spots array<bigint>, mark binary")


def _slices(sizes: list[int]):
    """Index ranges over texts of SLICE_BYTES bytes or one text."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE_BYTES:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def _blocks(n: str):
    return F.ceil(F.col(n) / BLOCK).cast("int")


def similar_pairs(df: DataFrame, threshold: float = SIMILAR, anchors=None) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, class, rep: the class's smallest doc_id, mark) of each row, and links between classes of equal
    fingerprints, each once: class_a, class_b, their reps a and b (a first), likeness."""
    rows = stored(fingerprints(df, anchors), "spots")
    classes = rows.groupBy("mark").agg(F.min("doc_id").alias("rep"), F.first("spots").alias("spots"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "spot-classes")
    member = rows.select("doc_id", "mark").join(classes.select("mark", "class", "rep"), "mark")
    sized = classes.withColumn("size", F.size("spots")).filter("size > 0").select("class", "rep", "spots", "size")
    flat = sized.select("class", "size", F.explode("spots").alias("spot"))
    often = flat.groupBy("spot").agg(F.count("*").alias("often"))
    ranked = flat.join(often, "spot").withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("often", "spot")))
    prefix = ranked.filter((F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold) + 1) & (F.col("often") > 1))
    part = F.floor(F.log(F.col("size").cast("double")) / -math.log(threshold) + 1e-9)
    prefix = stored(prefix.select("class", "size", "spot", part.alias("part")), "spot-prefixes")
    # both sides of a spot's partition are cut into blocks, and every two blocks meet under a key of their own
    right = prefix.select("class", "size", "spot", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    lefts, rights = (d.groupBy("spot", "part").agg(F.count("*").alias(n)) for d, n in ((prefix, "n_left"), (right, "n_right")))
    met = lefts.join(rights, ["spot", "part"]).filter("n_right > 1").select("spot", "part", _blocks("n_left").alias("left"), _blocks("n_right").alias("right"))
    turn = lambda n, seed: F.pmod(F.xxhash64("class", F.lit(seed)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = prefix.join(met, ["spot", "part"]).select(F.col("class").alias("x"), F.col("size").alias("size_x"), "spot", "part", turn("left", 1).alias("i"), all_of("right").alias("j"))
    y = right.join(met, ["spot", "part"]).select(F.col("class").alias("y"), F.col("size").alias("size_y"), "spot", "part", turn("right", 2).alias("j"), all_of("left").alias("i"))
    near = x.join(y, ["spot", "part", "i", "j"]).filter((F.col("x") < F.col("y")) & (F.least("size_x", "size_y") >= F.greatest("size_x", "size_y") * threshold)).select("x", "y").distinct()
    side = lambda n: sized.select(F.col("class").alias(n), F.col("rep").alias(f"rep_{n}"), F.col("spots").alias(f"spots_{n}"))
    shared = F.size(F.array_intersect("spots_x", "spots_y"))
    scored = near.join(side("x"), "x").join(side("y"), "y").withColumn("likeness", shared / (F.size("spots_x") + F.size("spots_y") - shared)).filter(F.col("likeness") >= threshold)
    ahead = F.struct("rep_x", "x") < F.struct("rep_y", "y")
    either = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
    return member, scored.select(either("rep_x", "rep_y").alias("a"), either("rep_y", "rep_x").alias("b"), "likeness", either("x", "y").alias("class_a"), either("y", "x").alias("class_b"))


def linked(df: DataFrame, threshold: float = SIMILAR, anchors=None) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the row's class), class_mark (which tells classes apart that share it) and
    n_links (other classes that are similar) of each row."""

    def build() -> DataFrame:
        member, links = similar_pairs(df, threshold, anchors)
        n = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
        named = member.join(n, "class", "left")
        return named.select("doc_id", F.col("rep").alias("class_id"), F.lower(F.hex("mark")).alias("class_mark"), F.coalesce("n", F.lit(0)).alias("n_links"))

    return tidied(df.sparkSession, "spot-links", build)
