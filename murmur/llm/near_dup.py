"""MinHash near-duplicates with sequential Bayesian verification.

A document's set holds its distinct five-word shingles. Rows with equal sets fall into one numbered class; the work
below is on classes, so it depends neither on the order of rows nor on doc_ids that repeat. 32 bands of four MinHash values propose pairs (a pair at similarity
0.75 shares no band with chance 5e-6). ``prune`` compares signatures 16 values at a time and drops a pair as soon as the
posterior chance of a similarity of 0.75 or more (uniform prior) is under ``MISS``; survivors are verified on full sets.

Order of work, so that a group of copies never meets itself pair by pair:
1. every member of a band's bucket is paired with the bucket's leader (two orders of documents take turns by band);
   pairs that survive pruning join their documents into families;
2. buckets that hold several families are compared whole, but not inside a family: members are dealt by hash into blocks
   of about ``SIDE``, and a pair of blocks is one step in numpy; survivors join families;
3. each document's likeliest survivor is verified, links join components, and only survivors that run between
   components are verified next;
4. families that still hold several components are compared whole, but not inside a component, block by block on
   signatures and then on the full sets, which are carried along.
So no pair that shares a band goes untested, unless a chain of links joins it already.

Edge cases: a null or empty text has an empty set, is linked with nothing and is its own component; texts of one to four
words are one shingle; in ``components``, rows of one doc_id are one document, linked by what any of its texts is linked
by; rows without doc_id are linked with nothing, have a null component and are kept; an empty table gives an empty one;
further columns are ignored by ``components`` and kept by ``deduplicate``, which judges rows, not doc_ids.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, sliced, stored, tidied, unused

WIDTH, SIMILAR = 5, 0.75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signature values compared at a time, and the chance at which a pair is given up.
BATCH, MISS = 16, 1e-6
#: Members of a block in steps 2 and 4.
SIDE = 256
#: Most row hashes that are broadcast to pick texts for verification; with more, texts are shuffled. The pairs are the same.
FEW_ROWS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(5)
_A = _random.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
MASKS = (0, 0x5A5A5A5A5A5A5A5A)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (UTF-8)."""
    words = [t.lower().split() for t in texts]
    sizes = np.array([len(w) for w in words])
    flat = np.array(list(chain.from_iterable(words)), dtype=object)
    hashed = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, dtype=np.uint64)
    windows = max(0, len(hashed) - WIDTH + 1)
    rolled = np.zeros(windows, dtype=np.uint64)
    for k in range(WIDTH):
        rolled = rolled * _MIX + hashed[k : windows + k]
    rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    rolled ^= rolled >> np.uint64(32)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= WIDTH:
            out.append(np.unique(rolled[at : at + n - WIDTH + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(hashed[at : at + n].tobytes(), seed=n)], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def signature(values: np.ndarray) -> bytes:
    x = (values >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, (x[i : i + 1024] * _A + _B).min(axis=0), out=least)
    return least.tobytes()


def profile(df: DataFrame) -> DataFrame:
    """doc_id, row (hash of doc_id and text), n_shingles, key (of the set; null if empty), sig of each row."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for a, b in sliced(texts):
                sets = shingle_sets(texts[a:b])
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                known: dict = {}
                for k, s in zip(keys, sets, strict=True):
                    if k is not None and k not in known:
                        known[k] = signature(s)
                own = [batch.column(c).slice(a, b - a) for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([known.get(k) for k in keys], pa.binary())], names=["doc_id", "row", "n_shingles", "key", "sig"])

    return with_row(df).mapInArrow(run, "doc_id long, row long, n_shingles long, key binary, sig binary")


def row_of(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text, F.lit("")))


def with_row(df: DataFrame) -> DataFrame:
    return id_and_text(df).withColumn("row", row_of(F.col("doc_id"), F.col("text")))


def sets_of(df: DataFrame, ids: DataFrame, by_key: DataFrame, few_rows: int) -> DataFrame:
    """rep, set (bytes) of the classes whose rep is among ids."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for a, b in sliced(texts):
                sets = [x.tobytes() for x in shingle_sets(texts[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["key", "set"])

    wanted = stored(by_key.join(ids, "rep").select("first.row"), "verified-rows")
    if wanted.count() <= few_rows:  # eight bytes each; beyond that, texts are shuffled to them
        wanted = F.broadcast(wanted)
    found = with_row(df).join(wanted, "row", "left_semi").select("doc_id", "text").mapInArrow(run, "key binary, set binary")
    return found.join(by_key.select("key", "rep"), "key").dropDuplicates(["rep"]).select("rep", "set")


def least_matches(compared: int) -> int:
    """Fewest agreeing values of so many with which P(similarity >= SIMILAR) is MISS or more.

    With a uniform prior the posterior is a beta distribution, whose upper tail is a binomial's lower one.
    """
    total = 0.0
    for m in range(compared + 1):
        total += math.comb(compared + 1, m) * SIMILAR**m * (1 - SIMILAR) ** (compared + 1 - m)
        if total >= MISS:
            return m
    return compared


STEPS = tuple((k, least_matches(k)) for k in range(BATCH, HASHES + 1, BATCH))


def compare(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Agreeing values of each pair of signatures, -1 for pairs given up on the way."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), dtype=np.int64)
    for k, least in STEPS:
        matches[alive] += (left[alive, k - BATCH : k] == right[alive, k - BATCH : k]).sum(axis=1)
        lost = matches[alive] < least
        matches[alive[lost]] = -1
        alive = alive[~lost]
    return matches


def prune(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, likeness (agreeing values) of the pairs that survive."""

    @F.pandas_udf(T.LongType())
    def agreeing(x: pd.Series, y: pd.Series) -> pd.Series:
        left, right = (np.frombuffer(b"".join(s), dtype=np.uint32).reshape(-1, HASHES) for s in (x, y))
        return pd.Series(compare(left, right))

    sig = classes.select("rep", "sig")
    both = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.select("a", "b", agreeing("sig_a", "sig_b").alias("likeness")).filter("likeness >= 0").groupBy("a", "b").agg(F.max("likeness").alias("likeness"))


def overlap(u: np.ndarray, v: np.ndarray) -> int:
    """Values that two ascending arrays share."""
    if len(u) > len(v):
        u, v = v, u
    return int(np.count_nonzero(v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u)) if len(u) else 0


def similar(u: np.ndarray, v: np.ndarray) -> bool:
    if min(len(u), len(v)) < SIMILAR * max(len(u), len(v)):
        return False
    both = overlap(u, v)
    return both > 0 and 100 * both >= 100 * SIMILAR * (len(u) + len(v) - both)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose full sets are similar."""

    @F.pandas_udf(T.BooleanType())
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)) for p, q in zip(x, y, strict=True)], dtype=bool)

    both = pairs.select("a", "b").join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b")
    return both.filter(near("set_a", "set_b")).select("a", "b")


def connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of the edges a, b: hook to the least neighbour, jump to the
    root, contract, until no edge is left. Few rounds: each at least halves the nodes of a component."""
    edges = stored(edges.filter("a <> b").select("a", "b"), "edges")
    whole = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "parents")
        while True:
            up = parent.select(F.col("node").alias("component"), F.col("component").alias("top"))
            jumped = parent.join(up, "component", "left").select("node", "component", F.coalesce("top", "component").alias("top"))
            moved = stored(jumped, "parents")
            parent = moved.select("node", F.col("top").alias("component"))
            if moved.filter("top <> component").isEmpty():
                break
        whole = parent if whole is None else stored(whole.join(parent.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component")), "components")
        edges = stored(contracted(edges, parent).distinct(), "edges")
    return whole if whole is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def contracted(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """a, b as components of pairs that run between two."""
    out = pairs
    for side in ("a", "b"):
        out = out.join(components.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
    return out.filter("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))


def between(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs (all columns) whose ends are in different components."""
    out = pairs
    for side in ("a", "b"):
        out = out.join(components.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    return out.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select(*pairs.columns)


def merged(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Components after further links."""
    of = connected(contracted(edges, components))
    nodes = components.unionByName(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(components, "node", "left_anti").withColumn("component", F.col("node")))
    return stored(nodes.join(of.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component")), "components")


def banded(classes: DataFrame, *more: str) -> DataFrame:
    """bucket, mask, rep of every class and band."""
    cells = [F.struct(F.xxhash64(F.lit(i), F.substring("sig", 4 * ROWS * i + 1, 4 * ROWS)).alias("bucket"), F.lit(MASKS[i % len(MASKS)]).alias("mask")) for i in range(BANDS)]
    return classes.select("rep", *more, F.explode(F.array(*cells)).alias("x")).select("x.bucket", "x.mask", "rep", *more)


def leader() -> Column:
    return F.min(F.col("rep").bitwiseXOR(F.col("mask"))).bitwiseXOR(F.first("mask")).alias("leader")


def stars(classes: DataFrame) -> DataFrame:
    """a < b: every class with the leader of each of its buckets."""
    rows = banded(classes, "n")
    heads = rows.groupBy("bucket").agg(leader(), F.count("*").alias("members")).filter("members > 1").drop("members")
    heads = heads.join(classes.select(F.col("rep").alias("leader"), F.col("n").alias("n_leader")), "leader")
    # sets whose sizes are too far apart can't be similar
    near = F.least("n", "n_leader") >= SIMILAR * F.greatest("n", "n_leader")
    return rows.join(heads, "bucket").filter((F.col("rep") != F.col("leader")) & near).select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()


def dealt(members: DataFrame, sizes: DataFrame, unit: str, *payload: str) -> DataFrame:
    """Members (unit, rep, part, inner, payload) once for each pair of blocks they are in: outer blocks with one another
    and with inner ones. sizes: unit, n_out, n_in (numbers of blocks)."""
    own, none = F.col("own"), F.array().cast("array<struct<kind:int,i:int,j:int,right:boolean>>")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, i, j, right: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), right.alias("right"))
    outer = F.transform(upto("n_out"), lambda j: cell(0, F.least(own, j), F.greatest(own, j), own > j))
    outer = F.concat(outer, F.when(F.col("n_in") > 0, F.transform(upto("n_in"), lambda j: cell(1, own, j, F.lit(False)))).otherwise(none))
    inner = F.transform(upto("n_out"), lambda i: cell(1, i, own, F.lit(True)))
    placed = members.join(sizes, unit).withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("inner"), F.col("n_in")).otherwise(F.col("n_out"))).cast("int"))
    each = placed.select(unit, "rep", "part", *payload, F.explode(F.when(F.col("inner"), inner).otherwise(outer)).alias("c"))
    task = F.xxhash64(unit, "c.kind", "c.i", "c.j").alias("task")
    same = ((F.col("c.i") == F.col("c.j")) & (F.col("c.kind") == 0)).alias("same")
    return each.select(task, same, "c.right", "rep", "part", *payload).repartition("task").sortWithinPartitions("task")


def by_task(tasks: DataFrame, accept) -> DataFrame:
    """a < b: pairs that run between parts and pass the comparison of signatures, and accept(rows, x, y) -> mask."""

    def pairs_of(rows, a, b):
        rep, part, right = (rows[c][a:b] for c in ("rep", "part", "right"))
        left = np.flatnonzero(~right)
        other = left if rows["same"][a] else np.flatnonzero(right)
        if not len(left) or not len(other):
            return None
        sig = np.frombuffer(b"".join(rows["sig"][a:b].to_pylist()), dtype=np.uint32).reshape(b - a, -1)
        agree = np.zeros((len(left), len(other)), dtype=np.int16)
        for k in range(BATCH):
            agree += sig[left, k][:, None] == sig[other, k]
        x, y = np.nonzero((agree >= STEPS[0][1]) & (part[left][:, None] != part[other]))
        x, y = left[x], other[y]
        for k, least in STEPS[1 : sig.shape[1] // BATCH]:
            near = (sig[x, :k] == sig[y, :k]).sum(axis=1) >= least
            x, y = x[near], y[near]
        if accept is not None and len(x):
            good = accept(rows["set"][a:b].to_pylist(), x, y)
            x, y = x[good], y[good]
        return np.stack([np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])])

    def run(batches):
        held = None
        for batch in chain(batches, [None]):
            parts = [x for x in (held, batch) if x is not None]
            if not parts:
                continue
            table = pa.Table.from_batches(parts).combine_chunks()
            rows = {c: table.column(c) if c in ("sig", "set") else table.column(c).to_numpy() for c in table.column_names}
            task = rows["task"]
            a, found = 0, []
            for b in (np.flatnonzero(np.append(task[1:] != task[:-1], batch is None)) + 1).tolist():
                if b - a > 1 and (got := pairs_of(rows, a, b)) is not None:
                    found.append(got)
                a = b
            held = table.slice(a).combine_chunks().to_batches()[0] if a < table.num_rows else None
            if found and (both := np.unique(np.concatenate(found, axis=1), axis=1)).size:
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    return tasks.mapInArrow(run, "a long, b long").distinct()


def n_blocks(inner: bool) -> Column:
    return F.ceil(F.sum((F.col("inner") == F.lit(inner)).cast("int")) / SIDE).cast("int").alias("n_in" if inner else "n_out")


def between_families(classes: DataFrame, families: DataFrame) -> DataFrame:
    """a < b: pairs of different families, from buckets that hold several, that survive the comparison."""
    known = classes.join(families.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "sig", F.coalesce("component", "rep").alias("part"))
    rows = banded(known, "part")  # without signatures: only members of open buckets fetch theirs
    # a bucket of two had its pair compared with the leader
    open_ = stored(rows.groupBy("bucket").agg(leader(), F.count("*").alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi")).filter("n > 2 AND lo <> hi").select("bucket", "leader"), "open-buckets")
    of_leader = open_.join(known.select(F.col("rep").alias("leader"), F.col("part").alias("lead")), "leader")
    inside = stored(rows.join(of_leader, "bucket").filter("rep <> leader").select("bucket", "rep", "part", (F.col("part") == F.col("lead")).alias("inner")), "open-members")
    sizes = inside.groupBy("bucket").agg(n_blocks(False), n_blocks(True)).filter("n_out > 0")
    members = inside.join(classes.select("rep", "sig"), "rep")
    return by_task(dealt(members, sizes, "bucket", "sig"), None)


def inside_families(classes: DataFrame, sets: DataFrame, families: DataFrame, found: DataFrame) -> DataFrame:
    """a < b: links between components of one family."""
    member = families.select(F.col("node").alias("rep"), F.col("component").alias("family")).join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "family", F.coalesce("component", "rep").alias("part"))
    counts = member.groupBy("family", "part").agg(F.count("*").alias("n"))
    major = stored(counts.groupBy("family").agg(F.max_by("part", F.struct("n", "part")).alias("major"), F.sum("n").alias("n"), F.count("*").alias("parts")).filter("n > 2 AND parts > 1").select("family", "major"), "open-families")
    inside = stored(member.join(major, "family").select("family", "rep", "part", (F.col("part") == F.col("major")).alias("inner")), "open-members")
    sizes = inside.groupBy("family").agg(n_blocks(False), n_blocks(True))
    members = inside.join(classes.select("rep", "sig"), "rep").join(sets, "rep")

    def accept(sets, x, y):
        known = [np.frombuffer(b, dtype=np.uint64) for b in sets]
        return np.array([similar(known[i], known[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)], dtype=bool)

    return by_task(dealt(members, sizes, "family", "sig", "set"), accept)


def classes_of(df: DataFrame, one_id: bool, few_rows: int = FEW_ROWS) -> tuple[DataFrame, DataFrame]:
    """The profile of each row, and key, first (least doc_id and row hash), component (a class number) of each set that a
    row with doc_id has. With ``one_id``, rows of one doc_id are one document: their classes are linked."""
    rows = stored(profile(df), "profiles")
    linked = rows.filter("key IS NOT NULL AND doc_id IS NOT NULL")
    # numbered as they are written, so that a number stays what it is; which number a class has matters nowhere
    by_key = linked.groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    by_key = stored(by_key.withColumn("rep", F.monotonically_increasing_id()), "classes")
    classes = by_key.select("rep", "n", "sig")
    survivors = stored(prune(stars(classes), classes), "survivors")
    families = connected(survivors)
    late = stored(between_families(classes, families).withColumn("likeness", F.lit(0).cast("long")), "late-survivors")
    if not late.isEmpty():
        survivors = stored(survivors.union(late), "survivors")
        families = merged(families, late)
    sets = stored(sets_of(df, ends(survivors), by_key, few_rows), "shingle-sets")
    best = stored(survivors.groupBy("b").agg(F.max_by("a", F.struct("likeness", "a")).alias("a")).select("a", "b"), "likeliest")
    links = verify(best, sets)
    found = connected(links.union(same_id(linked, by_key)) if one_id else links)
    rest = between(survivors.select("a", "b").join(best, ["a", "b"], "left_anti"), found)
    found = merged(found, stored(verify(rest, sets), "links"))
    found = merged(found, stored(inside_families(classes, sets, families, found), "links"))
    of_key = by_key.select("key", "first", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return rows, of_key.select("key", "first", F.coalesce("component", "rep").alias("component"))


def same_id(linked: DataFrame, by_key: DataFrame) -> DataFrame:
    """a, b: the classes of each doc_id that has several, each with the least of them."""
    mark = F.xxhash64("key")
    several = stored(linked.groupBy("doc_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).filter("lo <> hi").select("doc_id"), "repeated-ids")
    held = linked.select("doc_id", "key").join(several, "doc_id", "left_semi").distinct()
    held = stored(held.join(by_key.select("key", "rep"), "key").select("doc_id", F.col("rep").alias("b")), "repeated-id-classes")
    return held.join(held.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").filter("a <> b").select("a", "b")


def components(df: DataFrame, few_rows: int = FEW_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""

    def build() -> DataFrame:
        rows, of_key = classes_of(df, True, few_rows)
        of_key = stored(of_key, "class-components")
        least = of_key.groupBy("component").agg(F.min("first.doc_id").alias("least"))
        named = of_key.join(least, "component").select("key", "least")
        # an empty set has no key: its row goes with the other texts of its doc_id, if there are any
        mixed = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("key").alias("n"), F.count("*").alias("m")).filter("n > 0 AND n < m").select("doc_id")
        other = rows.filter("key IS NOT NULL").select("doc_id", "key").join(mixed, "doc_id", "left_semi").join(named, "key").groupBy("doc_id").agg(F.min("least").alias("of_id"))
        out = rows.select("doc_id", "n_shingles", "key").join(named, "key", "left").join(other, "doc_id", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "of_id", "doc_id"))
        return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))

    return tidied(df.sparkSession, "components", build)


def deduplicate(df: DataFrame, few_rows: int = FEW_ROWS) -> DataFrame:
    """One row of each group of similar texts (of the smallest doc_id, and there the smallest row hash), and every row
    without doc_id. Rows are judged by their texts: a doc_id with two unlike texts keeps both, and of rows equal in
    doc_id and text one stays. Rows with empty texts are linked with nothing: of those of one doc_id one stays."""
    row, present = unused(df, "row", "present")

    def kept() -> DataFrame:
        rows, of_key = classes_of(df, False, few_rows)
        first = of_key.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
        return first.union(rows.filter("doc_id IS NOT NULL AND key IS NULL").select("row")).distinct()

    wanted = tidied(df.sparkSession, "kept", kept)
    keyed = df.withColumn(row, row_of(F.col("doc_id"), F.col("text"))).withColumn(present, F.col("doc_id").cast("long").isNotNull())
    one = keyed.filter(F.col(present)).join(wanted, row, "left_semi").dropDuplicates([row])
    return one.unionByName(keyed.filter(~F.col(present))).select(df.columns)
