"""Balanced shards by label propagation: linked documents move towards their neighbours' shards, counts stay even.

Documents of equal text are one class; a class stands in one row with the number of its documents, whatever that is.
Classes are linked through hubs: a hub is any key that several classes share (here a long line), and a class's
neighbours are the other classes of its hubs, each hub weighing one in all. No pairs are made.

``label`` deals classes by hash, then repeats: hubs count their classes' documents by shard, classes sum their hubs'
counts, and a class would move to the shard in which it gains most. Each round moves what fits: the gains are counted by
shard from, shard to and bin of gain (a table of bounded size), the best bins go first as far as the quota of the shard
that they go to allows, and of a bin that fits in part a share drawn by hash. Classes of over 1/``LARGE`` of all
documents, at most ``LARGE`` of them, are laid out first, each over as few shards as can hold it, and stay. ``level``
then makes the counts exact: shards over their quota give documents to those under it, first those whose move cuts
least, ranked by sums over hash buckets and within the few buckets at the border only.

``assign`` gives each document its class's shard (a class on several shards is filled by its documents' ordinals) and a
gapless number in the shard, by counts of blocks of rows: no step orders a class or a shard in one task.

The law is ``rows``: the shards' numbers of documents are at most one apart; sizes (UTF-8 bytes and one) are reported.

Edge cases: a null text is like the empty one; null and repeated doc_ids and equal rows are documents like others, each
with a shard and slot of its own; an empty table gives an empty one; fewer documents than shards leave shards empty;
further columns are ignored. Very long texts are hashed in the first step and not moved.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAPS, stored, tidied

SHARDS = 8
ROUNDS = 6
LARGE = 64
#: Lines of so many characters, blanks around them apart, link the documents that hold them.
LINE = 60
#: A shard may hold so much over its quota between the rounds.
SLACK = 1.05
BINS, BUCKETS = 64, 4096
#: Rows numbered together: consecutive rows of one input partition.
BLOCK_BITS = 16


def rows_of(df: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, class (MD5 of the text) and block of each document, without its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("class"),
        F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block"),
    )


def long_lines(df: DataFrame, least: int = LINE) -> DataFrame:
    """class and hub (64-bit hash) of each line of ``least`` characters or more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(GAPS))), lambda s: F.char_length(s) >= least)
    return df.select(F.unhex(F.md5(text)).alias("class"), F.explode(F.array_distinct(F.transform(lines, lambda s: F.xxhash64(s)))).alias("hub"))


def quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def _one(shard: Column, n: Column, shards: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.when(s == shard, n).otherwise(F.lit(0).cast("long")))


def _large(classes: DataFrame, total: int, shards: int) -> tuple[list[tuple], list[int]]:
    """Layout of the classes of over total/LARGE documents: (class, documents by shard) and what they leave of the quotas.
    At most LARGE classes can be that large; they alone are collected."""
    room, out = quotas(total, shards), []
    for c in classes.filter(F.col("n") * LARGE > total).orderBy(F.desc("n"), "class").collect():
        left, alloc = c["n"], [0] * shards
        while left:
            fits = [s for s in range(shards) if room[s] >= left]
            s = min(fits, key=lambda s: (-room[s], s)) if fits else max(range(shards), key=lambda s: (room[s], -s))
            part = min(left, room[s])
            alloc[s] += part
            room[s] -= part
            left -= part
        out.append((bytes(c["class"]), alloc))
    return out, room


def _hashed(salt: int) -> Column:
    return F.pmod(F.xxhash64("class", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def label(classes: DataFrame, members: DataFrame, room: list[int], rounds: int = ROUNDS) -> DataFrame:
    """class, n, fixed (documents by shard of a large class, else null), shard and tie (how strongly its hubs bind it to
    its shard, each hub 1 at most) of each class after the rounds. classes: class, n, fixed; members: class, hub."""
    shards = len(room)
    share = np.cumsum(np.array(room) / max(1, sum(room)))
    first = F.lit(shards - 1)
    for s in range(shards - 2, -1, -1):
        first = F.when(_hashed(0) < float(share[s]), F.lit(s)).otherwise(first)
    main = F.when(F.col("fixed").isNull(), first).otherwise(F.array_position("fixed", F.array_max("fixed")) - 1).cast("int")
    state = stored(classes.select("class", "n", "fixed", main.alias("shard"), F.lit(0.0).alias("tie")), "labels")
    for round_ in range(1, rounds + 1):
        placed = members.join(state.select("class", "n", "shard"), "class")
        held = placed.groupBy("hub").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("shard") == s, F.col("n")).otherwise(0)).alias(f"s{s}") for s in range(shards)])
        # the share of the hub's other documents that each shard has
        others = [F.sum((F.col(f"s{s}") - F.when(F.col("shard") == s, F.col("n")).otherwise(0)) / (F.col("all") - F.col("n"))) for s in range(shards)]
        votes = placed.join(held, "hub").groupBy("class").agg(F.array(*others).alias("votes"))
        wish = state.drop("tie").join(votes, "class", "left").withColumn("votes", F.coalesce("votes", F.array(*[F.lit(0.0)] * shards)))
        wish = wish.withColumn("tie", F.get("votes", F.col("shard"))).withColumn("best", F.array_max("votes"))
        moves = F.col("fixed").isNull() & (F.col("best") > F.col("tie") + 1e-9) & (_hashed(round_) < 0.5)  # half of them, or two neighbours would change places for ever
        wish = wish.withColumn("to", F.when(moves, F.array_position("votes", F.col("best")) - 1).cast("int"))
        wish = wish.withColumn("bin", F.when(moves, F.least(F.lit(BINS - 1), F.floor((F.col("best") - F.col("tie")) * 16))).cast("int"))
        wish = stored(wish.select("class", "n", "fixed", "shard", "tie", "to", "bin"), "wishes")
        sums = wish.filter("fixed IS NULL").groupBy("shard", "to", "bin").agg(F.sum("n").alias("n")).collect()  # shards x shards x BINS rows at most
        now, asked = [0] * shards, {}
        for r in sums:
            now[r["shard"]] += r["n"]
            if r["to"] is not None:
                asked[r["shard"], r["to"], r["bin"]] = r["n"]
        grants = wish.sparkSession.createDataFrame([(*k, v) for k, v in granted(asked, now, room).items()], "shard int, to int, bin int, share double")
        goes = _hashed(-round_) < F.coalesce("share", F.lit(0.0))
        state = stored(wish.join(F.broadcast(grants), ["shard", "to", "bin"], "left").select("class", "n", "fixed", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard"), "tie"), "labels")
    return state


def granted(asked: dict[tuple[int, int, int], int], now: list[int], room: list[int]) -> dict[tuple[int, int, int], float]:
    """The share of each (from, to, bin of gain) that may move: what two shards can swap, then what finds room within
    SLACK of the quotas; best bins first."""
    shards, most, now = len(room), [math.ceil(r * SLACK) for r in room], list(now)
    pairs = {(a, b): sum(n for (f, t, _), n in asked.items() if (f, t) == (a, b)) for a, b, _ in asked}
    may = {(a, b): min(n, pairs.get((b, a), 0)) for (a, b), n in pairs.items()}
    for _ in range(shards):  # what leaves a shard makes room in it for others
        for a, b in sorted(pairs, key=lambda p: (now[p[1]] - room[p[1]], p)):
            more = min(pairs[a, b] - may[a, b], max(0, most[b] - now[b]))
            may[a, b] += more
            now[a] -= more
            now[b] += more
    out = {}
    for a, b, k in sorted(asked, key=lambda x: -x[2]):
        part = min(asked[a, b, k], may[a, b])
        may[a, b] -= part
        if part:
            out[a, b, k] = part / asked[a, b, k]
    return out


def level(state: DataFrame, room: list[int]) -> DataFrame:
    """class and alloc (documents by shard) of each class, so that every shard has its quota exactly."""
    shards = len(room)
    free = state.filter("fixed IS NULL")
    held = {r["shard"]: r["n"] for r in free.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    over = {s: held.get(s, 0) - room[s] for s in range(shards)}
    cost = F.least(F.lit(BINS - 1), F.ceil(F.col("tie") * 4) + F.when(F.col("n") > 1, 8).otherwise(0)).cast("int")
    keyed = free.withColumn("cost", cost).withColumn("bucket", (_hashed(-1) * BUCKETS).cast("int"))
    givers = [s for s in over if over[s] > 0]
    sums = keyed.filter(F.col("shard").isin(givers)).groupBy("shard", "cost").agg(F.sum("n").alias("n")).collect()  # shards x BINS rows at most
    edge = {}  # the cost at which a shard has given enough, and what it still gives of it
    for s in givers:
        left = over[s]
        for c, n in sorted((r["cost"], r["n"]) for r in sums if r["shard"] == s):
            if n >= left:
                edge[s] = (c, left)
                break
            left -= n
    parts = {}
    for s, (c, left) in edge.items():
        rows = keyed.filter((F.col("shard") == s) & (F.col("cost") == c)).groupBy("bucket").agg(F.sum("n").alias("n")).orderBy("bucket").collect()  # BUCKETS at most
        for r in rows:
            if r["n"] >= left:
                parts[s] = (c, r["bucket"], left)
                break
            left -= r["n"]
    none = F.lit(None).cast("long")
    gives, at_edge = none, F.lit(False)
    for s, (c, b, _) in parts.items():
        whole = (F.col("cost") < c) | ((F.col("cost") == c) & (F.col("bucket") < b))
        gives = F.when((F.col("shard") == s) & whole, F.col("n")).otherwise(gives)
        at_edge = at_edge | ((F.col("shard") == s) & (F.col("cost") == c) & (F.col("bucket") == b))
    quota = F.lit(0).cast("long")
    for s, (_, _, left) in parts.items():
        quota = F.when(F.col("shard") == s, F.lit(left).cast("long")).otherwise(quota)
    marked = keyed.withColumn("gives", gives).withColumn("edge", at_edge)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    border = marked.filter("edge").withColumn("gives", F.greatest(F.lit(0), F.least(F.col("n"), quota - before)).cast("long"))  # one bucket a shard
    every = stored(marked.filter("NOT edge").unionByName(border).select("class", "n", "shard", "cost", "bucket", F.coalesce("gives", F.lit(0)).cast("long").alias("gives")), "gifts")
    # what is given lies on one line, by shard, cost, bucket and class; the takers' wants cut it
    given = every.filter("gives > 0")
    buckets = given.groupBy("shard", "cost", "bucket").agg(F.sum("gives").alias("n"))
    piles = buckets.groupBy("shard", "cost").agg(F.sum("n").alias("pile"))
    below = piles.select("shard", "cost", (F.sum("pile").over(Window.orderBy("shard", "cost")) - F.col("pile")).alias("below"))  # shards x BINS rows at most
    within = F.sum("n").over(Window.partitionBy("shard", "cost").orderBy("bucket")) - F.col("n")  # BUCKETS rows at most
    starts = buckets.withColumn("within", within).join(below, ["shard", "cost"]).select("shard", "cost", "bucket", (F.col("below") + F.col("within")).alias("base"))
    inside = F.sum("gives").over(Window.partitionBy("shard", "cost", "bucket").orderBy("class")) - F.col("gives")
    line = given.join(starts, ["shard", "cost", "bucket"]).withColumn("a", F.col("base") + inside).withColumn("b", F.col("base") + inside + F.col("gives"))
    wants, at = [], 0
    for s in range(shards):
        if over[s] < 0:
            wants.append((s, at, at - over[s]))
            at -= over[s]
    takes = [F.lit(0).cast("long")] * shards
    for s, a, b in wants:
        takes[s] = F.greatest(F.lit(0), F.least(F.col("b"), F.lit(b)) - F.greatest(F.col("a"), F.lit(a))).cast("long")
    arrived = [F.when(F.col("shard") == s, F.col("n") - F.col("gives")).otherwise(takes[s]) for s in range(shards)]
    settled = line.select("class", F.array(*arrived).alias("alloc"))
    stay = every.filter("gives = 0").select("class", _one(F.col("shard"), F.col("n"), shards).alias("alloc"))
    return stay.unionByName(settled).unionByName(state.filter("fixed IS NOT NULL").select("class", F.col("fixed").alias("alloc")))


def assign(rows: DataFrame, alloc: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: each row in one of its class's shards, numbered there without gaps."""
    cells = rows.groupBy("class", "block").agg(F.count("*").alias("n"))
    offset = F.sum("n").over(Window.partitionBy("class").orderBy("block")) - F.col("n")
    ends = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(F.slice("alloc", 1, s + 1), F.lit(0).cast("long"), lambda x, y: x + y))
    placed = cells.select("class", "block", offset.alias("offset")).join(alloc.select("class", ends.alias("ends")), "class")
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy("class", "block").orderBy("doc_id")) - 1)
    full = F.size(F.filter("ends", lambda e: e <= F.col("offset") + F.col("place")))
    out = stored(numbered.join(placed, ["class", "block"]).select("doc_id", "size", "text_crc32", "block", full.alias("shard")), "placed")
    blocks = out.groupBy("shard", "block").agg(F.count("*").alias("n"))
    base = blocks.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("base"))  # one row a block
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")) - 1
    return out.withColumn("inside", inside).join(base, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("inside")).alias("slot"))


def shard(df: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, hubs: DataFrame | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each document. hubs: class (MD5 of a text) and hub, the classes' links;
    the documents' long lines unless given."""
    spark = df.sparkSession

    def build() -> DataFrame:
        rows = stored(rows_of(df), "rows")
        classes = stored(rows.groupBy("class", "block").agg(F.count("*").alias("n")).groupBy("class").agg(F.sum("n").alias("n")), "classes")
        total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()["n"]
        large, room = _large(classes, total, shards)
        fixed = spark.createDataFrame(large, "class binary, fixed array<bigint>")
        classes = classes.join(F.broadcast(fixed), "class", "left")  # LARGE rows at most
        pairs = (hubs if hubs is not None else long_lines(df)).select("class", "hub").distinct()
        shared = pairs.groupBy("hub").agg(F.count("*").alias("of")).filter("of > 1").select("hub")
        members = stored(pairs.join(shared, "hub"), "members")
        state = label(classes, members, room, rounds)
        return assign(rows, stored(level(state, room), "alloc"), shards)

    return tidied(spark, "shards", build)
