"""Transcript documents: groups of objects, neighbours, sessions around an anchor, places in the text, assembled text.

Nulls: an object without key or time is in no group; a document without times begins no session and joins none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators import intervals
from murmur.operators.sessions import seconds

GAP_S, SPAN_S, LONGEST = 30, 1800, 120_000
NO_SPEECH = 0.85


def groups(objects: DataFrame, since: Column, until: Column) -> DataFrame:
    """Objects by parent path: group_key, station_id, n_keys, fingerprint over key and etag in key order, last_modified.
    objects: key, etag, modified_at; only settled ones of the window whose path has three parts or more."""
    part = F.split("key", "/")
    rows = objects.filter(F.col("key").endswith(".transcript.json") & (F.size(part) >= 3) & (F.col("modified_at") >= since) & (F.col("modified_at") <= until))
    entry = F.concat("key", F.lit(":"), F.replace(F.coalesce("etag", F.lit("")), F.lit('"'), F.lit("")))
    parent = F.concat(F.array_join(F.slice(part, F.lit(1), F.size(part) - 1), "/"), F.lit("/"))
    held = rows.select(parent.alias("group_key"), F.get(part, 1).alias("station_id"), "key", entry.alias("entry"), "modified_at").groupBy("group_key")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "entry"))), lambda e: e["entry"]), "|")
    return held.agg(F.min_by("station_id", "key").alias("station_id"), F.count("*").alias("n_keys"), F.sha2(listed, 256).alias("fingerprint"), F.max("modified_at").alias("last_modified"))


def neighbours(rows: DataFrame, anchors: DataFrame, reach: int = 6, most: int = 200) -> DataFrame:
    """Documents of the same day and of groups at most ``reach`` away from the anchor's, ``most`` of the nearest at most.
    rows: day, group_key, key; anchors: anchor, day, group_key."""
    order = rows.select("day", "group_key").distinct().withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy("group_key")))
    placed = rows.join(order, ["day", "group_key"])
    at = anchors.join(order, ["day", "group_key"]).select("anchor", "day", F.col("place").alias("at"))
    near = placed.join(at.withColumn("place", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach))), ["day", "place"])
    rank = Window.partitionBy("anchor").orderBy(F.abs(F.col("place") - F.col("at")), "group_key", "key")
    return near.withColumn("rank", F.row_number().over(rank).cast("long")).filter(F.col("rank") <= most).select("anchor", "key", "rank")


def sessions(docs: DataFrame, gap_s: float = GAP_S) -> DataFrame:
    """Documents with ``run``, the number of their contiguous run: a new one begins where the pause since the last end is
    over ``gap_s``. docs: station_id, key, started_at, ended_at."""
    order = Window.partitionBy("station_id").orderBy("started_at", "key")
    pause = seconds(F.col("started_at")) - F.lag(seconds(F.col("ended_at"))).over(order)
    return docs.filter("started_at IS NOT NULL AND ended_at IS NOT NULL").withColumn("opens", F.coalesce((pause > gap_s).cast("long"), F.lit(0))).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def limits(docs: DataFrame, anchors: DataFrame, gap_s: float = GAP_S, span_s: float = SPAN_S) -> DataFrame:
    """One row an anchor: station_id, anchor, lo, hi (places among the station's documents in order, of the first and last
    of its session), n, first_key (the smallest), last_at (the latest end). Within its contiguous run the session grows to
    the left as far as the span allows, then to the right. A task passes over its stations' documents in order, many runs
    at a time; it holds one run whole. docs: station_id, key, started_at, ended_at; anchors: key."""
    order = Window.partitionBy("station_id").orderBy("started_at", "key")
    marked = docs.filter("station_id IS NOT NULL").join(anchors.select("key", F.lit(True).alias("is_anchor")).distinct(), "key", "left")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    placed = _placed(sessions(marked.repartition("station_id"), gap_s))
    opens = F.col("run") != F.coalesce(F.lag("run").over(order), F.lit(-1))
    columns = ["station_id", "place", "key", F.col("ended_at").alias("last_at"), micros("started_at").alias("s"), micros("ended_at").alias("e"), opens.alias("opens"), F.col("is_anchor").isNotNull().alias("is_anchor")]
    rows = placed.select(*columns).sortWithinPartitions("station_id", "place")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_limits(round(span_s * 1_000_000)), f"station_id {kinds['station_id']}, anchor {kinds['key']}, lo long, hi long, n long, first_key {kinds['key']}, last_at {kinds['last_at']}")


def _placed(docs: DataFrame) -> DataFrame:
    order = Window.partitionBy("station_id").orderBy("started_at", "key")
    return docs.withColumn("place", F.row_number().over(order).cast("long"))


def around(docs: DataFrame, anchors: DataFrame, gap_s: float = GAP_S, span_s: float = SPAN_S) -> DataFrame:
    """The documents of each anchor's session (``limits``): anchor, station_id, key, started_at, ended_at."""
    every = limits(docs, anchors, gap_s, span_s).select("station_id", "anchor", F.explode(F.sequence("lo", "hi")).alias("place"))
    placed = _placed(docs.filter("started_at IS NOT NULL AND ended_at IS NOT NULL"))
    return every.join(placed, ["station_id", "place"]).select("anchor", "station_id", "key", "started_at", "ended_at")


def _limits(span_us: int):
    """Both limits of all anchors of the runs at hand by steps of halving length: leftwards the starts are in order;
    rightwards a step passes over a stretch whose latest end is early enough."""

    def firsts(rank: np.ndarray, longest: int) -> list[np.ndarray]:
        """tables[k][i]: which of the 2**k documents from i on has the smallest rank (the first of equals)."""
        tables = [np.arange(len(rank), dtype=np.int32)]
        while 2 ** len(tables) <= longest:
            half = 2 ** (len(tables) - 1)
            a, b = tables[-1][:-half], tables[-1][half:]
            tables.append(np.where(rank[b] < rank[a], b, a))
        return tables

    def least(tables: list[np.ndarray], rank: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which document of each [lo, hi) has the smallest rank: the better of two stretches that cover it."""
        size = np.frexp(hi - lo)[1] - 1
        best = np.empty(len(lo), np.int64)
        for k in np.unique(size):
            at = size == k
            a, b = tables[k][lo[at]], tables[k][hi[at] - 2**k]
            best[at] = np.where(rank[b] < rank[a], b, a)
        return best

    def of(runs: pa.Table) -> pa.RecordBatch:
        runs = runs.combine_chunks()
        s, e, opens = (runs.column(c).to_numpy() for c in ("s", "e", "opens"))
        at = np.flatnonzero(runs.column("is_anchor").to_numpy())
        bounds = np.append(np.flatnonzero(opens), len(s))
        run = np.searchsorted(bounds, at, side="right") - 1
        begin, end, longest = bounds[run], bounds[run + 1], int(np.diff(bounds).max())
        late = firsts(-e, longest)
        lo, hi = at.copy(), at + 1
        for k in range(len(late) - 1, -1, -1):
            there = np.maximum(lo - 2**k, 0)
            lo = np.where((lo - 2**k >= begin) & (e[at] - s[there] <= span_us), there, lo)
        for k in range(len(late) - 1, -1, -1):
            inside = hi + 2**k <= end
            latest = e[late[k][np.where(inside, hi, 0)]]
            hi = np.where(inside & (latest - s[lo] <= span_us), hi + 2**k, hi)
        last = least(late, -e, lo, hi)
        order = np.empty(len(s), np.int64)
        order[pc.sort_indices(runs.column("key")).to_numpy()] = np.arange(len(s))
        first = least(firsts(order, longest), order, lo, hi)
        place = runs.column("place").to_numpy()
        columns = {"station_id": runs.column("station_id").take(at), "anchor": runs.column("key").take(at), "lo": place[lo], "hi": place[hi - 1], "n": hi - lo, "first_key": runs.column("key").take(first), "last_at": runs.column("last_at").take(last)}
        return pa.table(columns).combine_chunks()

    def run(batches):
        held = []  # rows of whole runs' beginning: the last run of a batch may go on in the next
        for batch in batches:
            opens = np.flatnonzero(batch.column("opens").to_numpy(zero_copy_only=False))
            if len(opens):
                before = [*held, batch.slice(0, opens[-1])]
                if sum(map(len, before)):
                    yield from of(pa.Table.from_batches(before)).to_batches()
                held = []
                batch = batch.slice(opens[-1])
            held.append(batch)
        if held:
            yield from of(pa.Table.from_batches(held)).to_batches()

    return run


def assembled(segments: DataFrame, most: int = LONGEST) -> DataFrame:
    """Segments with the place of their stripped text in the whole, joined by single spaces: start_char, end_char. Blank
    ones have no place; what begins behind ``most`` characters goes, what crosses it is cut. segments: doc_id, place, text."""
    clean = segments.withColumn("text", F.trim("text")).filter("text <> ''").withColumn("n", F.char_length("text"))
    before = F.coalesce(F.sum(F.col("n") + 1).over(Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = clean.withColumn("start_char", before).filter(F.col("start_char") < most)
    return placed.withColumn("end_char", F.least(F.col("start_char") + F.col("n"), F.lit(most))).drop("n")


def segment_at(places: DataFrame, segments: DataFrame) -> DataFrame:
    """The segment that holds each character place, else the document's first. places: doc_id, at; segments: doc_id,
    start_char, end_char, place."""
    first = segments.groupBy("doc_id").agg(F.min("place").alias("first"))
    held = intervals.holding(places.select("doc_id", "at"), segments, "doc_id", "at", "start_char", "end_char", "place")
    return held.join(first, "doc_id", "left").select("doc_id", "at", F.coalesce("place", "first").alias("place"))


def words_of_span(words: DataFrame, spans: DataFrame) -> DataFrame:
    """The words that overlap a span of time, as one highlight: start_char, end_char, n_words. words: doc_id, start_char,
    end_char, started_at, ended_at; spans: doc_id, span_id, from_at, to_at (null: an instant)."""
    asked = spans.select("doc_id", "span_id", "from_at", F.coalesce("to_at", "from_at").alias("to_at"))
    # most words lie outside of all spans of their document: they are dropped before any pairs are made
    reach = asked.groupBy("doc_id").agg(F.min("from_at").alias("_least"), F.max("to_at").alias("_most"))
    near = words.withColumn("ended_at", F.coalesce("ended_at", "started_at")).join(reach, "doc_id")
    spoken = near.filter((F.col("ended_at") >= F.col("_least")) & (F.col("started_at") <= F.col("_most"))).drop("_least", "_most")
    over = intervals.overlapping(asked, spoken, "doc_id", ("from_at", "started_at"), ("to_at", "ended_at"), closed=True)
    return over.groupBy("doc_id", F.col("l.span_id").alias("span_id")).agg(F.min("r.start_char").alias("start_char"), F.max("r.end_char").alias("end_char"), F.count("*").alias("n_words"))


def heard(segments: DataFrame) -> DataFrame:
    """Recogniser segments worth keeping: not blank, speech likely enough, no loop. segments: text, no_speech, loops."""
    return segments.filter((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.coalesce("no_speech", F.lit(0.0)) <= NO_SPEECH) & ~F.coalesce("loops", F.lit(False)))


def language_hint(languages: Column, aliases: dict[str, str], allowed: tuple[str, ...]) -> Column:
    """The hint of a list of language codes: the only one, after aliases, if it is allowed; else none."""
    code = F.transform(F.coalesce(languages, F.array().cast("array<string>")), lambda c: F.lower(F.trim(F.substring_index(F.replace(c, F.lit("_"), F.lit("-")), "-", 1))))
    known = F.array_distinct(F.filter(F.transform(code, lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), c), c)), lambda c: c.isin(*allowed)))
    return F.when(F.size(known) == 1, F.get(known, 0))
