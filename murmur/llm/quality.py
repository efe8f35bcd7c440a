"""Quality rules: text statistics, two fixed rules, and robust multivariate outliers by minimum covariance determinant.

``statistics`` counts words, symbols, repeated lines and repeated three-word windows of each text. ``judge`` rejects
what fails a fixed rule. Of the rest, it estimates location and scatter of four transformed statistics by the minimum
covariance determinant: five deterministic starts (quartile widths; correlations of rank-like scores, of clipped scores
and of spatial signs; the half closest to the medians), concentration steps on the closest three quarters until the
determinant stands still, the start of the least determinant, and one reweighting at the 0.975 quantile. A row is
rejected beyond a high chi-squared quantile of its squared Mahalanobis distance.

Groups are language and source, language, and the whole table. A group of n rows has the share n / (n + ``PRIOR``) in
its own estimates, the rest comes from the wider group: one formula for every size, so a small group leans on its
language and a large one on itself. Only rows that pass the fixed rules are counted and estimated from.

The cut and the least deviations in ``FLOOR`` are judgements: the cut is passed by one normal row in 1e12, and the floors
are about the spread of each statistic in plain prose, so that a group of texts without a single symbol doesn't reject the
first one. They were checked against the labels of the given tables, which they meet at 0.98 and more.

Scale: the pass over the texts reduces a row to four numbers, rounded to hundredths. Rows are then counted by group and
cell of these numbers, and all steps run on the cells: their number is bounded by the grid, not by the rows. Every
number that decides is an integer or worked out in a fixed order, so results don't depend on the order of rows.

Edge cases: a null or empty text has no words and fails the word rule; null languages and sources are groups of their
own; repeated rows count each; an empty table gives an empty one; null doc_ids stay null and are judged like any other;
further columns are ignored by ``judge`` and kept by ``keep``, whose verdict goes with the row.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAPS, WORD, let, stored, tidied, unused

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 50, 50
#: Share of a group that the concentration steps keep.
KEPT = 0.75
#: Rows at which a group's own estimates have half the weight.
PRIOR = 200
#: Squared distance beyond which a row is an outlier: the chi-squared quantile of four degrees of freedom at 1 - 1e-12.
CUT = 62.0
#: Squared distance within which rows enter the reweighted estimates: the quantile at 0.975.
NEAR = 11.143
#: Least standard deviation of each transformed statistic, so constant ones don't make every other value an outlier.
FLOOR = {"length": 0.1, "symbols": 0.08, "lines": 0.1, "repeats": 0.1}
NAMES = tuple(FLOOR)
PAIRS = tuple((i, j) for i in range(len(NAMES)) for j in range(i + 1))
#: Fixed point of the transformed statistics.
UNIT = 100
STARTS = ("widths", "ranks", "clipped", "signs", "half")
#: Concentration steps end when no log determinant falls by more than this, at the latest after so many.
STILL, MOST_STEPS = 1e-9, 50


def _even_chi2(x: float, k: int) -> float:
    """Chi-squared distribution of 2k degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k))


def consistency(quantile: float) -> float:
    """Scatter of the normal rows within a squared distance, relative to the whole, in four dimensions."""
    return _even_chi2(quantile, 3) / _even_chi2(quantile, 2)


#: The 0.75 quantile of four degrees of freedom.
KEPT_QUANTILE = 5.3853


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more. Windows are compared by 64-bit hash, in sorted order."""
    n = F.size(words)
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    keys = F.zip_with(F.slice(hashed, F.lit(1), n - 2), F.zip_with(F.slice(hashed, F.lit(2), n - 2), F.slice(hashed, F.lit(3), n - 2), lambda b, c: F.xxhash64(b, c)), lambda a, bc: F.xxhash64(a, bc))

    def covered(keys: Column) -> Column:
        placed = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def among(placed: Column) -> Column:
            size = F.size(placed)
            twin = F.zip_with(F.slice(placed, F.lit(1), size - 1), F.slice(placed, F.lit(2), size - 1), lambda a, b: F.when(a["k"] == b["k"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
            starts = F.array_distinct(F.flatten(twin))
            return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

        return let(placed, among)

    return F.when(n >= 4, let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k)))).otherwise(F.lit(0)).cast("long")


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(text: Column, words_name: str, rest_name: str) -> list[Column]:
    """Two structs that hold n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; ``flat`` unpacks them."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeats")))
    rest = F.struct(
        F.char_length(F.translate(text, GAPS, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return [counted.alias(words_name), rest.alias(rest_name)]


def flat(words: str, rest: str) -> list[Column]:
    return [F.col(f"{words}.n").alias("n_words"), *[F.col(f"{rest}.{c}").alias(c) for c in STATISTICS[1:4]], F.col(f"{words}.repeats").alias("n_repeat_words")]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def transformed() -> list[Column]:
    """The statistics as logarithms of rates, in fixed point."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    raw = {
        "length": F.log(F.col("word_chars") / n + 1),
        "symbols": F.log1p(4 * F.col("n_symbols") / n),
        "lines": F.log1p(F.col("n_dup_lines")) / 4,
        "repeats": F.log1p(4 * F.col("n_repeat_words") / n),
    }
    return [F.round(raw[k] * UNIT).cast("long").alias(k) for k in NAMES]


def named(level: str, *parts: str) -> Column:
    """A group's name; nulls and texts that look like them don't meet."""
    return F.concat_ws("|", F.lit(level), *[F.coalesce(F.concat(F.lit("="), F.replace(F.col(p).cast("string"), F.lit("|"), F.lit("||"))), F.lit("null")) for p in parts])




def factored(est: DataFrame, *keys: str) -> DataFrame:
    """keys (and other columns that are to stay), m_*, c_*, log_det and l_*: the Cholesky factor of the scatter c_* with the floor added to its diagonal."""
    for i, k in enumerate(NAMES):
        for j in range(i + 1):
            c = F.col(f"c_{i}{j}") + ((FLOOR[k] * UNIT) ** 2 if i == j else 0.0)
            rest = reduce(lambda x, n: x - F.col(f"l_{i}{n}") * F.col(f"l_{j}{n}"), range(j), c)
            est = est.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l_{j}{j}"))
    log_det = reduce(lambda x, i: x + 2 * F.log(f"l_{i}{i}"), range(1, len(NAMES)), 2 * F.log("l_00"))
    return est.select(*keys, *[f"m_{k}" for k in NAMES], *[f"c_{i}{j}" for i, j in PAIRS], *[f"l_{i}{j}" for i, j in PAIRS], log_det.alias("log_det"))


def distance() -> Column:
    """Squared Mahalanobis distance of a row joined with its group's estimates, by forward substitution."""
    z: list = []
    for i, k in enumerate(NAMES):
        rest = reduce(lambda x, j: x - F.col(f"l_{i}{j}") * z[j], range(i), F.col(k) - F.col(f"m_{k}"))
        z.append(rest / F.col(f"l_{i}{i}"))
    return reduce(lambda x, v: x + v * v, z, F.lit(0.0))


def _moments(rows: DataFrame, keys: list[str], weight: Column, *more: Column) -> DataFrame:
    """Location and scatter (divided by the sum of weights) of each group's weighted cells, and further aggregates."""
    rows = rows.withColumn("w", weight)
    w = F.col("w").cast("decimal(20,0)")  # whole weights, so that sums are exact in any order
    total = lambda c: F.sum(c.cast("decimal(20,0)") * w).cast("double")
    sums = [total(F.col(k)).alias(f"s_{k}") for k in NAMES] + [total(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p_{i}{j}") for i, j in PAIRS]
    got = rows.groupBy(*keys).agg(F.sum(w).cast("double").alias("w"), *sums, *more).filter("w > 0")
    mean = {k: F.col(f"s_{k}") / F.col("w") for k in NAMES}
    return got.select(*keys, *got.columns[len(keys) + 1 + len(sums) :], *[mean[k].alias(f"m_{k}") for k in NAMES], *[(F.col(f"p_{i}{j}") / F.col("w") - mean[NAMES[i]] * mean[NAMES[j]]).alias(f"c_{i}{j}") for i, j in PAIRS])


def _scaled(est: DataFrame, factor: float) -> DataFrame:
    return est.withColumns({f"c_{i}{j}": F.col(f"c_{i}{j}") / factor for i, j in PAIRS})


def starts(cells: DataFrame) -> DataFrame:
    """grp, start and the estimates that each start begins with."""
    long = cells.select("grp", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), F.col(k).alias("value")) for k in NAMES])).alias("v"))
    values = stored(long.groupBy("grp", "v.stat", "v.value").agg(F.sum("n").alias("n")), "values")
    by = Window.partitionBy("grp", "stat")
    running = values.withColumn("c", F.sum("n").over(by.orderBy("value")) / F.sum("n").over(by))
    quartiles = running.groupBy("grp", "stat").agg(*[F.min(F.when(F.col("c") >= q, F.col("value"))).alias(name) for q, name in ((0.25, "lo"), (0.5, "mid"), (0.75, "hi"))])
    of = lambda k, c: F.max(F.when(F.col("stat") == k, c))
    floor = F.create_map(*[F.lit(x) for k in NAMES for x in (k, FLOOR[k] * UNIT)])
    wide = F.greatest((F.col("hi") - F.col("lo")) / 1.349, F.element_at(floor, F.col("stat")))
    middle = stored(quartiles.groupBy("grp").agg(*[of(k, F.col("mid").cast("double")).alias(f"m_{k}") for k in NAMES], *[of(k, wide).alias(f"d_{k}") for k in NAMES]), "medians")
    z = [(F.col(k) - F.col(f"m_{k}")) / F.col(f"d_{k}") for k in NAMES]
    norm = F.sqrt(reduce(lambda a, b: a + b, [v * v for v in z]))
    scores = {
        "ranks": [2 / (1 + F.exp(-1.702 * v)) - 1 for v in z],  # the normal distribution's ranks, by the logistic
        "clipped": [F.greatest(F.least(v, F.lit(1.5)), F.lit(-1.5)) for v in z],
        "signs": [F.when(norm > 0, v / norm).otherwise(F.lit(0.0)) for v in z],
    }
    # scores in fixed point, so that their sums are exact
    fixed = lambda v: F.round(v * 1_000).cast("long")
    rows = cells.join(middle, "grp").select("grp", "n", *NAMES, *[fixed(v).alias(f"{s}_{i}") for s, vs in scores.items() for i, v in enumerate(vs)], F.round(norm * 1_000).cast("long").alias("norm"))
    got = rows.groupBy("grp").agg(*[F.sum(F.col("n") * F.col(f"{s}_{i}") * F.col(f"{s}_{j}")).cast("double").alias(f"{s}_{i}{j}") for s in scores for i, j in PAIRS])
    est = middle.join(got, "grp")
    d = lambda i: F.col(f"d_{NAMES[i]}")
    # a score's correlations with the quartile widths as deviations
    both = lambda s, i, j: F.sqrt(F.col(f"{s}_{i}{i}") * F.col(f"{s}_{j}{j}"))
    related = lambda s, i, j: F.lit(0.0) if s == "widths" else F.when(both(s, i, j) > 0, d(i) * d(j) * F.col(f"{s}_{i}{j}") / both(s, i, j)).otherwise(F.lit(0.0))
    begun = F.array(*[F.struct(F.lit(s).alias("start"), *[(d(i) * d(i) if i == j else related(s, i, j)).alias(f"c_{i}{j}") for i, j in PAIRS]) for s in ("widths", *scores)])
    out = est.select("grp", *[f"m_{k}" for k in NAMES], F.explode(begun).alias("b")).select("grp", "b.start", *[f"m_{k}" for k in NAMES], *[f"b.c_{i}{j}" for i, j in PAIRS])
    half = _moments(_closest(rows, ["grp"], "norm", 0.5), ["grp"], F.col("taken")).withColumn("start", F.lit("half"))
    return out.unionByName(half)


def _closest(rows: DataFrame, keys: list[str], by: str, share: float) -> DataFrame:
    """rows with ``taken``: how many of a cell's rows are among the closest share of its group. The cells of a group are
    ordered by distance and then by their own values; the last one counts in part."""
    group = Window.partitionBy(*keys)
    order = group.orderBy(by, *NAMES).rowsBetween(Window.unboundedPreceding, 0)
    want = F.ceil(F.sum("n").over(group) * share)
    return rows.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("n"), want - F.sum("n").over(order) + F.col("n")))).filter("taken > 0")


def estimates(cells: DataFrame) -> DataFrame:
    """grp, the number of its rows, and its reweighted minimum-covariance-determinant location and scatter."""
    keys = ["grp", "start"]
    est = stored(factored(starts(cells), *keys), "mcd")
    for step in range(MOST_STEPS):
        placed = cells.join(est, "grp").select(*keys, "n", *NAMES, distance().alias("d"), F.col("log_det").alias("before"))
        moved = stored(factored(_moments(_closest(placed, keys, "d", KEPT), keys, F.col("taken"), F.max("before").alias("before")), *keys, "before"), "mcd")
        est = moved.drop("before")
        # a start's own determinant has another number of rows behind it
        if step and moved.filter(F.col("before") - F.col("log_det") > STILL).isEmpty():
            break
    least = est.groupBy("grp").agg(F.min_by(F.struct(*[c for c in est.columns if c != "grp"]), F.struct("log_det", "start")).alias("e")).select("grp", "e.*")
    raw = factored(_scaled(least, consistency(KEPT_QUANTILE)), "grp")
    # some row of each group is near: the mean squared distance of the closest ones is under the number of dimensions
    placed = cells.join(raw, "grp").select("grp", "n", *NAMES, distance().alias("d"))
    again = _moments(placed, ["grp"], F.when(F.col("d") <= NEAR, F.col("n")).otherwise(0), F.sum("n").alias("n"))
    return _scaled(again, consistency(NEAR))


def group_estimates(rows: DataFrame) -> DataFrame:
    """lang, source, m_*, l_* of each language and source with rows that pass. rows: lang, source and the transformed
    statistics of those."""
    own, of_lang = named("own", "lang", "source"), named("lang", "lang")
    counted = stored(rows.groupBy("lang", "source", *NAMES).agg(F.count("*").alias("n")), "cells")
    each = counted.select("n", *NAMES, F.explode(F.array(own, of_lang, F.lit("all"))).alias("grp"))
    cells = stored(each.groupBy("grp", *NAMES).agg(F.sum("n").alias("n")), "group-cells")
    est = stored(estimates(cells), "estimates")
    groups = counted.select("lang", "source", own.alias("own"), of_lang.alias("of_lang")).distinct()
    columns = [c for c in est.columns if c not in ("grp", "n")]
    level = lambda name: est.filter(F.col("grp").startswith(name)).select(F.col("grp").alias(name), F.struct("n", *columns).alias(f"e_{name}"))
    of = groups.join(level("own"), "own").join(level("lang").withColumnRenamed("lang", "of_lang"), "of_lang").crossJoin(F.broadcast(level("all").drop("all")))  # one row

    def drawn(column: str) -> Column:
        """A group's estimate, drawn towards its language's, which is drawn towards the table's, by numbers of rows."""
        share = lambda e: F.col(f"{e}.n") / (F.col(f"{e}.n") + PRIOR)
        wide = share("e_lang") * F.col(f"e_lang.{column}") + (1 - share("e_lang")) * F.col(f"e_all.{column}")
        return (share("e_own") * F.col(f"e_own.{column}") + (1 - share("e_own")) * wide).alias(column)

    final = factored(of.select("lang", "source", *map(drawn, columns)), "lang", "source")
    return stored(final.drop("log_det", *[f"c_{i}{j}" for i, j in PAIRS]), "group-estimates")


def judged(counted: DataFrame) -> DataFrame:
    """The rows of counted (lang, source, statistics, base_failed and others) with distance and kept."""
    measured = counted.withColumns(dict(zip(NAMES, transformed(), strict=True)))
    est = group_estimates(measured.filter(~F.col("base_failed")).select("lang", "source", *NAMES))
    est = est.withColumnsRenamed({"lang": "est_lang", "source": "est_source"})
    out = measured.join(est, F.col("lang").eqNullSafe(F.col("est_lang")) & F.col("source").eqNullSafe(F.col("est_source")), "left").withColumn("distance", distance())
    # only where no row of a group passes the fixed rules has it no estimates, and there none is kept
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(False))).select(*counted.columns, "distance", "kept")


def judge(df: DataFrame) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, distance (null only where no row of the group passes the fixed
    rules) and kept of each row."""

    def build() -> DataFrame:
        rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", *statistics(F.col("text"), "words", "rest"))
        return judged(stored(rows.select("doc_id", "lang", "source", *flat("words", "rest")).withColumn("base_failed", base_failed()), "statistics"))

    return tidied(df.sparkSession, "judged", build)


def keep(df: DataFrame) -> DataFrame:
    """The rows of df that are kept, with all their columns."""

    def build() -> DataFrame:
        whole, words, rest = unused(df, "whole", "words", "rest")
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(whole), "lang", "source", *statistics(F.col("text"), words, rest))
        rows = stored(rows.select(whole, "lang", "source", *flat(words, rest)).withColumn("base_failed", base_failed()), "statistics")
        return judged(rows).filter("kept").select(f"{whole}.*")

    return tidied(df.sparkSession, "kept", build)
