"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture; its target repetition rate is the share times the mixture's size over
the source's own size (in characters). A document's number of copies inverts the Poisson distribution with that mean at
a uniform number drawn from the document's id and text, its place among equal rows and the seed, so it is the same on every
run and every machine. Copies are exploded and shuffled globally by a key drawn from the same and the copy's number.

Scale: sizes and rates are one row a source. The distribution is tabulated once a source, about its mean only (some
24 sqrt(rate) numbers, 4,824 at a rate of 40,000); the join brings the table to
the documents (broadcast when small, else a skew-split join), and the copies are dealt by cells of a uniform key, so a
hot source, or a doc_id that a third of all rows share, is spread like any other.

Edge cases: a null source is a source of its own; a null or empty text has the size of one character; repeated rows and
null doc_ids (drawn as the text "null") draw apart from one another; which of the rows that are equal in doc_id and text
gets which of their draws follows their place in the table; a source without target weight gets none; an empty table
gives an empty one; further columns pass through, but for those named like the two added ones (a parameter), which are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored, unused

SEED = 7
#: Exponent of the default targets: shares grow with this power of a source's size.
TEMPERATURE = 0.5
#: Size of the mixture as a multiple of the input.
EPOCHS = 1.0
#: Steps of the tabulated distribution on both sides of its mean: the rest holds under 1e-15 of it.
TAIL = 12


def uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) from the first 13 hexadecimal digits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(1 << 52)


def size(text: Column) -> Column:
    return F.greatest(F.coalesce(F.char_length(text), F.lit(1)), F.lit(1)).cast("long")


def rates(df: DataFrame, targets: dict | None = None, epochs: float = EPOCHS) -> DataFrame:
    """source, rate: the mean number of copies. targets: source to weight, of any sum; None: tempered sizes."""
    sized = stored(df.groupBy("source").agg(F.sum(size(F.col("text"))).alias("size")), "sizes")
    if targets is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(TEMPERATURE))
    else:
        weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]), F.col("source")), F.lit(0.0)) if targets else F.lit(0.0)
    weighed = sized.withColumn("weight", weight.cast("double"))
    total = weighed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).head()
    scale = epochs * float(total["size"] or 0) / (total["weight"] or 1.0)
    out = weighed.select("source", (F.col("weight") / F.col("size") * F.lit(scale)).alias("rate"))
    out._stored_at = sized._stored_at
    return out


def lowest(rate: Column) -> Column:
    """The number of copies at which the tabulated distribution begins: what lies below holds under 1e-15 of it."""
    return F.greatest(F.floor(rate - TAIL * F.sqrt(rate) - TAIL), F.lit(0)).cast("int")


def distribution(rate: Column) -> Column:
    """The Poisson distribution's running sums at ``lowest``, and one by one up to where nothing is left to draw.

    Begun at one and divided by the whole at the end: exp(-rate) is zero in double precision from a rate of 746 on.
    """
    first = lowest(rate)
    steps = F.sequence(first + 1, F.ceil(rate + TAIL * F.sqrt(rate) + TAIL).cast("int"))
    start = F.struct(F.lit(1.0).alias("p"), F.array(F.lit(1.0)).alias("c"))
    step = lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), F.array_append(acc["c"], F.element_at(acc["c"], -1) + acc["p"] * rate / k).alias("c"))
    return F.aggregate(steps, start, step, lambda acc: F.transform(acc["c"], lambda x: x / F.element_at(acc["c"], -1)))


def with_ordinal(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """df with ``key``, an MD5 digest of doc_id and text, and ``ordinal``: the place of a row among those of its key.

    Only rows whose key repeats are ranked, by the part of the table they lie in and then inside it, so that many equal
    rows never meet in one task.
    """
    text = F.coalesce(F.md5("text"), F.lit("null"))
    keyed = df.withColumn(key, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text))
    mark, at, place = unused(keyed, "mark", "at", "place")
    marked = keyed.withColumn(mark, F.xxhash64(key))
    repeats = stored(marked.groupBy(mark).agg(F.count("*").alias(at)).filter(F.col(at) > 1).select(mark), "repeated-rows")
    if repeats.isEmpty():
        return keyed.withColumn(ordinal, F.lit(1).cast("long"))
    several = stored(marked.join(repeats, mark, "left_semi").withColumn(at, F.monotonically_increasing_id()), "repeated-documents")
    part = F.shiftright(at, 33)
    inside = F.row_number().over(Window.partitionBy(key, place).orderBy(at))
    before = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    several = several.withColumn(place, part)
    parts = several.groupBy(key, place).agg(F.count("*").alias(mark)).withColumn(at, F.coalesce(F.sum(mark).over(before), F.lit(0))).select(key, place, F.col(at).alias(ordinal))
    ranked = several.withColumn(at, inside).join(parts, [key, place]).withColumn(ordinal, F.col(ordinal) + F.col(at))
    single = marked.join(repeats, mark, "left_anti").withColumn(ordinal, F.lit(1).cast("long"))
    return single.select(*keyed.columns, ordinal).unionByName(ranked.select(*keyed.columns, ordinal))


def replicate(df: DataFrame, targets: dict | None = None, epochs: float = EPOCHS, seed: int = SEED, copy: str = "copy", shuffle_key: str = "shuffle_key") -> DataFrame:
    """Every copy of every document, with the columns ``copy`` (1, 2 ...) and ``shuffle_key``, in the order of the key."""
    df = df.drop(copy, shuffle_key)
    source, lowest_n, running, key, ordinal = unused(df, "source_of_rate", "lowest", "running", "draw_key", "ordinal")
    rate = F.col("rate")
    rated = rates(df, targets, epochs)
    table = stored(rated.select(F.col("source").alias(source), lowest(rate).alias(lowest_n), distribution(rate).alias(running)), "rates")
    discard(rated)
    ranked = with_ordinal(df, key, ordinal)
    drawn = ranked.join(table, F.col("source").eqNullSafe(F.col(source)))
    u = uniform(F.lit(seed), F.col(key), F.col(ordinal))
    count = F.col(lowest_n) + F.size(F.filter(running, lambda c: c <= u))
    copies = drawn.select(*ranked.columns, F.explode(F.sequence(F.lit(1), F.when(count > 0, count))).alias(copy))
    keyed = copies.withColumn(shuffle_key, uniform(F.lit(seed + 1), F.col(key), F.col(ordinal), F.col(copy)))
    return shuffled(keyed.drop(key, ordinal), copy, shuffle_key)


def shuffled(keyed: DataFrame, copy: str, shuffle_key: str) -> DataFrame:
    """Rows dealt by equal cells of the uniform key, a partition each: the partitions are even, and their order is the
    key's, without a sampling pass over the texts."""
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionById(n, F.floor(F.col(shuffle_key) * n).cast("int")).sortWithinPartitions(shuffle_key, "doc_id", copy)
