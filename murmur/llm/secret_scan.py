"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control.

``scan`` returns, for each row, the base spans (assign, access, hex) and the spans that the battery adds (random), all
in code points. Everything runs in Spark's own expressions.

The battery. A candidate is a run of 20 or more characters of the usual encodings (equals signs only at its end, so
the name before a key isn't part of it) that overlaps no base span. Its encoding (hex, base32, one-case letters and
digits, letters and digits, base64) is inferred from its characters and gives the alphabet. Three tests are worked out
for it: chi-squared uniformity of the symbols, runs, and lag-one serial correlation.

They are used twice. First against randomness: a candidate that any of them rejects (beyond ``Z_RANDOM``) is ordinary.
Then against the null hypothesis that matters, "this is an ordinary string of its encoding and length": how far the same
three statistics (the chi-squared statistic as the rate of agreeing symbol pairs; runs of character classes; serial
correlation) are from what ordinary strings show, towards what random ones would. What ordinary strings show is learnt
from the table: means and covariances, times the root of the length, of the candidates of ``LEARNT`` characters or more
that the battery rejects (of shorter ones it rejects too few), for each encoding and length class, drawn towards fixed
ones by ``PRIOR`` strings. Shorter classes take those of the first learnt class, with the additional variance that pairs
of few symbols have. The three deviations are weighed by Fisher's discriminant (weights that point away from randomness
are zero) and divided by the standard deviation of that sum, so that kinds of ordinary strings that differ make for
wider bounds. The tail of the normal distribution is the candidate's p-value; a rejected candidate has one.
Benjamini-Hochberg over all candidates of a length class decides which are secrets.

Moments and p-values (in bins of a tenth of a decade) are counted in two small aggregations of a few rows each. Runs of
digits alone are hex base spans, so none is a candidate.

Edge cases: a null or empty text has no spans; repeated rows are scanned each; an empty table gives an empty one;
null doc_ids stay null; further columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, let, stored, tidied, unused

# Fixed values of the query contract.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"  # the whole run, so a shorter start can't hide a longer one
HEX = "[0-9a-f]{16,}"
BASE_KINDS = ("assign", "access", "hex")

CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
#: Alphabets of the inferred encodings.
HEX_SYMBOLS = "0123456789abcdef"
B32_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ONE_CASE_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789"
ALNUM_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
B64_SYMBOLS = ALNUM_SYMBOLS + "+/"
ENCODINGS = ("hex", "base32", "one-case", "alnum", "base64")
#: The point from which rates are measured: that two symbols agree, that neighbours differ in class (upper, lower, digit,
#: sign), and the serial correlation.
COINCIDENCE, CHANGES, SERIAL = 0.065, 0.1, 0.2
#: These rates in ordinary strings of each encoding before any is seen, their variances times the length, and the number of
#: strings that weigh as much.
BEFORE = ((0.1, 0.2, 0.1), (0.07, 0.03, 0.0), (0.07, 0.03, 0.0), (0.055, 0.25, 0.0), (0.07, 0.3, 0.0))
SPREAD = ((0.011, 0.15, 1.3), (0.011, 0.06, 1.3), (0.011, 0.06, 1.3), (0.011, 0.15, 1.3), (0.011, 0.3, 1.3))
PRIOR = 50
#: Ordinary strings are learnt from this length on; strings of n characters vary more than the normal law says, by WIDER/n.
LEARNT, WIDER = 48, 8
#: A candidate is ordinary if one test of the three is beyond this many standard deviations (0.001 in all).
Z_RANDOM = 3.6
#: Upper ends of the length classes, and the rate of false discoveries allowed in each.
LENGTH_CLASSES, FALSE_RATE = (24, 32, 48, 64, 128), 0.001
#: A length of each class, for what depends on it.
TYPICAL = (22, 28, 40, 56, 90, 160)
#: Bins of -log10 p, ten a decade.
BINS = 400


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans of the non-overlapping matches, from the lengths of what lies between and inside them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    cells = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), (F.regexp_extract_all(text, F.lit(pattern), F.lit(keep[0])) if keep else found).alias("part"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")

    def step(acc, cell):
        start = acc["at"] + F.char_length(cell["gap"])
        end = start + F.char_length(cell["hit"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))
        held = cell["hit"].isNotNull() & (F.char_length(cell["part"]) >= keep[1] if keep else F.lit(True))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(held, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    folded = F.aggregate(cells, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), folded).otherwise(none)


def _tail(z: Column) -> Column:
    """-log10 of the upper tail of the standard normal beyond z (0 below 0), by its asymptotic series."""
    x = F.greatest(z, F.lit(0.0))
    return (x * x / 2 + F.log(x + F.sqrt(x * x + 8 / math.pi)) + math.log(math.pi / 2) / 2) / math.log(10)


def _judged(c: Column, text: Column) -> Column:
    """A candidate span with its encoding, length, the three rates and whether the battery finds it random."""
    raw = F.substring(text, c["start"].cast("int") + 1, (c["end"] - c["start"]).cast("int"))
    bare = F.translate(F.rtrim(raw, F.lit("=")), "-_", "+/")

    def battery(token: Column, symbols: str, encoding: int) -> Column:
        k, n = len(symbols), F.char_length(token).cast("double")
        counts = F.transform(F.array(*map(F.lit, symbols)), lambda s: n - F.char_length(F.replace(token, s, F.lit(""))))
        pairs = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x)
        chi = pairs * k / n - n
        z_chi = (F.cbrt(chi / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
        xs = F.transform(F.filter(F.split(token, ""), lambda s: s != ""), lambda s: F.instr(F.lit(symbols), s).cast("double") - (k + 1) / 2)

        def after(xs: Column) -> Column:
            size = F.size(xs)
            total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
            pairs_of = lambda f: F.zip_with(F.slice(xs, F.lit(1), size - 1), F.slice(xs, F.lit(2), size - 1), f)
            sums = F.struct(
                total(xs).alias("s"),
                total(F.transform(xs, lambda x: x * x)).alias("q"),
                total(pairs_of(lambda a, b: a * b)).alias("lag"),
                total(pairs_of(lambda a, b: F.when((a > 0) != (b > 0), 1.0).otherwise(0.0))).alias("runs"),
                total(F.transform(xs, lambda x: F.when(x > 0, 1.0).otherwise(0.0))).alias("upper"),
                (xs[0] + F.element_at(xs, -1)).alias("ends"),
            )
            return let(sums, tested)

        def tested(v: Column) -> Column:
            mean = v["s"] / n
            spread = v["q"] - n * mean * mean
            lagged = v["lag"] - mean * (2 * v["s"] - v["ends"]) + (n - 1) * mean * mean
            expected = 2 * v["upper"] * (n - v["upper"]) / n
            z_runs = F.when(expected > 1, (v["runs"] - expected) / F.sqrt(F.greatest(expected * (expected - 1) / (n - 1), F.lit(1e-9)))).otherwise(F.lit(99.0))
            z_serial = F.when(spread > 0, lagged / spread * F.sqrt(n)).otherwise(F.lit(99.0))
            random = F.greatest(z_chi, F.abs(z_runs), F.abs(z_serial)) < Z_RANDOM
            serial = F.when(spread > 0, F.least(F.greatest(lagged / spread, F.lit(-1.0)), F.lit(1.0))).otherwise(F.lit(1.0))
            return F.struct(random.alias("random"), serial.alias("serial"))

        return F.struct(let(xs, after).alias("tests"), ((pairs - n) / (n * (n - 1))).alias("agree"), F.lit(encoding).alias("encoding"))

    classes = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "[a-z]+", "a "), "[A-Z]+", "A "), "[0-9]+", "0 "), "[+/]+", "+ "), " ", "")
    n = F.char_length(bare).cast("double")
    tests = (
        F.when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$"), battery(F.lower(bare), HEX_SYMBOLS, 0))
        .when(bare.rlike("^[A-Z2-7]+$"), battery(bare, B32_SYMBOLS, 1))
        .when(bare.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), battery(F.lower(bare), ONE_CASE_SYMBOLS, 2))
        .when(bare.rlike("^[A-Za-z0-9]+$"), battery(bare, ALNUM_SYMBOLS, 3))
        .otherwise(battery(bare, B64_SYMBOLS, 4))
    )
    # whole numbers of millionths: their sums are exact in any order
    unit = lambda v: F.round(v * 1_000_000).cast("long")
    changes = (F.char_length(classes) - 1) / (n - 1)
    return let(tests, lambda t: F.struct(c["start"].alias("start"), c["end"].alias("end"), t["encoding"].alias("encoding"), n.cast("long").alias("n"), t["tests"]["random"].alias("random"), unit(t["agree"]).alias("agree"), unit(changes).alias("changes"), unit(t["tests"]["serial"]).alias("serial")))


def _base(text: Column) -> Column:
    """Base spans by start, then kind as listed."""
    place = lambda s: F.array_position(F.array(*map(F.lit, BASE_KINDS)), s["kind"])
    spans = F.concat(_spans(text, ASSIGN, "assign", (2, 12)), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex"))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _candidates(text: Column):
    """From the base spans, the judged candidates that overlap none of them."""
    return lambda base: F.transform(F.filter(_spans(text, CANDIDATE, "random"), lambda c: (c["end"] - c["start"] >= 20) & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))), lambda c: _judged(c, text))


def found(df: DataFrame, text: Column, base: str, candidates: str) -> DataFrame:
    """df with its base spans and judged candidates."""
    return df.withColumn(base, _base(text)).withColumn(candidates, _candidates(text)(F.col(base)))


def length_class(n: Column) -> Column:
    size = F.lit(0)
    for i, top in enumerate(LENGTH_CLASSES):
        size = F.when(n >= top, F.lit(i + 1)).otherwise(size)
    return size


def _deviations(c: Column) -> list[Column]:
    """How far a candidate's three rates are from the fixed ones, towards randomness, in millionths."""
    unit = lambda v: F.lit(round(v * 1_000_000))
    return [unit(COINCIDENCE) - c["agree"], c["changes"] - unit(CHANGES), unit(SERIAL) - c["serial"]]


def _moments(candidates: DataFrame) -> dict[tuple[int, int], tuple[int, list[float], list[list[float]]]]:
    """For each encoding and learnt length class: number of rejected candidates, sums and sums of products of their
    deviations times the root of the length. Summed as whole thousandths, so exact in any order."""
    c = F.col("c")
    x = [F.round(v * F.sqrt(c["n"].cast("double")) / 1000).cast("decimal(18,0)") for v in _deviations(c)]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    total = lambda v, name: F.sum(v.cast("decimal(28,0)")).cast("double").alias(name)
    held = candidates.filter(~c["random"] & (c["n"] >= LEARNT)).groupBy(c["encoding"].alias("encoding"), length_class(c["n"]).alias("size"))
    rows = held.agg(F.count("*").alias("m"), *[total(x[i], f"s{i}") for i in range(3)], *[total(x[i] * x[j], f"q{i}{j}") for i, j in pairs]).collect()  # 15 rows at most
    return {(r["encoding"], r["size"]): (r["m"], [r[f"s{i}"] / 1e3 for i in range(3)], [[r[f"q{min(i, j)}{max(i, j)}"] / 1e6 for j in range(3)] for i in range(3)]) for r in rows}


def _class_changes(symbols: str) -> float:
    """The rate at which neighbours among random symbols differ in class."""
    kinds = [sum(map(test, symbols)) for test in (str.isdigit, str.isupper, str.islower)]
    return 1 - sum(k * k for k in (*kinds, len(symbols) - sum(kinds))) / len(symbols) ** 2


def _solved(m: list[list[float]], y: list[float]) -> list[float]:
    """The solution of three linear equations, by Cramer's rule."""
    det = lambda a: sum(a[0][i] * (a[1][(i + 1) % 3] * a[2][(i + 2) % 3] - a[1][(i + 2) % 3] * a[2][(i + 1) % 3]) for i in range(3))
    whole = det(m)
    return [det([[y[r] if c == i else m[r][c] for c in range(3)] for r in range(3)]) / whole for i in range(3)]


def weights(moments: dict) -> dict[tuple[int, int], tuple[list[float], float]]:
    """For each encoding and length class, the three weights and the shift that make standard deviations of deviations
    (times the root of the length)."""
    out = {}
    learnt = next(i for i, top in enumerate((0, *LENGTH_CLASSES)) if top >= LEARNT)
    for e, symbols in enumerate((HEX_SYMBOLS, B32_SYMBOLS, ONE_CASE_SYMBOLS, ALNUM_SYMBOLS, B64_SYMBOLS)):
        for size, n in enumerate(TYPICAL):
            of = max(size, learnt)
            m, sums, products = moments.get((e, of), (0, [0.0] * 3, [[0.0] * 3] * 3))
            before = [v * math.sqrt(TYPICAL[of]) for v in (COINCIDENCE - BEFORE[e][0], BEFORE[e][1] - CHANGES, SERIAL - BEFORE[e][2])]
            mean = [(s + PRIOR * v) / (m + PRIOR) for s, v in zip(sums, before, strict=True)]
            cov = [[(products[i][j] + PRIOR * (before[i] * before[j] + (SPREAD[e][i] if i == j else 0.0))) / (m + PRIOR) - mean[i] * mean[j] for j in range(3)] for i in range(3)]
            mean = [v / math.sqrt(TYPICAL[of]) for v in mean]
            agree = min(max(COINCIDENCE - mean[0], 1e-3), 0.5)
            cov[0][0] += 2 * agree * (1 - agree) * (1 / n - 1 / TYPICAL[of]) if size < learnt else 0.0
            cov = [[v * (1 + WIDER / n) for v in row] for row in cov]
            apart = [COINCIDENCE - 1 / len(symbols) - mean[0], _class_changes(symbols) - CHANGES - mean[1], SERIAL - mean[2]]
            w = [v if v * a > 0 else 0.0 for v, a in zip(_solved(cov, apart), apart, strict=True)]
            size_of = math.sqrt(sum(w[i] * cov[i][j] * w[j] for i in range(3) for j in range(3)))
            w = [v / size_of for v in w] if size_of > 0 else w
            out[e, size] = w, sum(v * x for v, x in zip(w, mean, strict=True))
    return out


def level(c: Column, weighed: dict) -> Column:
    """The bin of -log10 p of a candidate: 0 if the battery rejects it."""
    at = c["encoding"] * len(TYPICAL) + length_class(c["n"])
    rows = [weighed[k] for k in sorted(weighed)]
    of = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), at)  # noqa: E731  a constant, looked up
    z = of([-shift for _, shift in rows])
    for i, x in enumerate(_deviations(c)):
        z = z + x / 1e6 * of([w[i] for w, _ in rows])
    return F.when(c["random"], F.least(F.floor(_tail(z * F.sqrt(c["n"].cast("double"))) * 10), F.lit(BINS))).otherwise(F.lit(0)).cast("int")


def control(rows: DataFrame, candidates: str) -> tuple[dict, dict[int, int]]:
    """The weights, and the least accepted bin of each length class by Benjamini-Hochberg over all candidates."""
    each = rows.select(F.explode(candidates).alias("c"))
    weighed = weights(_moments(each))
    one = each.select(length_class(F.col("c.n")).alias("size"), level(F.col("c"), weighed).alias("level")).groupBy("size", "level").agg(F.count("*").alias("n"))
    above = Window.partitionBy("size").orderBy(F.desc("level"))
    ranked = one.withColumn("k", F.sum("n").over(above)).withColumn("m", F.sum("n").over(Window.partitionBy("size")))
    passed = ranked.filter((F.col("level") > 0) & (F.pow(F.lit(10.0), -F.col("level") / 10) <= F.col("k") * FALSE_RATE / F.col("m")))
    return weighed, {r["size"]: r["least"] for r in passed.groupBy("size").agg(F.min("level").alias("least")).collect()}  # a row a class


def _all_spans(base: Column, candidates: Column, weighed: dict, least: dict[int, int]) -> Column:
    """Base spans and accepted candidates by start, then kind."""
    accepted = F.filter(candidates, lambda c: reduce(or_, [(length_class(c["n"]) == s) & (level(c, weighed) >= v) for s, v in sorted(least.items())], F.lit(False)))
    merged = F.concat(base, F.transform(accepted, lambda c: F.struct(F.lit("random").alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    place = lambda s: F.array_position(F.array(*map(F.lit, (*BASE_KINDS, "random"))), s["kind"])
    ordered = F.array_sort(F.transform(merged, lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def scan(df: DataFrame) -> DataFrame:
    """doc_id, base (array of kind, start, end), spans (base and added ones by start, then kind) of each row."""

    def build() -> DataFrame:
        rows = stored(found(id_and_text(df), F.col("text"), "base", "candidates").select("doc_id", "base", "candidates"), "secrets")
        return rows.select("doc_id", "base", _all_spans(F.col("base"), F.col("candidates"), *control(rows, "candidates")).alias("spans"))

    return tidied(df.sparkSession, "secret-spans", build)


def redact(df: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """df with every secret in ``text`` replaced by the mark and n_chars, where present, brought up to date. The spans
    are stored with the rows, so every row gets its own, whatever its doc_id."""

    def build() -> DataFrame:
        base, candidates, spans = unused(df, "base", "candidates", "spans")
        rows = stored(found(df, F.coalesce("text", F.lit("")), base, candidates), "secrets")
        rows = rows.withColumn(spans, _all_spans(F.col(base), F.col(candidates), *control(rows, candidates)))
        text = F.col("text")

        def step(acc, s):
            new = s["end"] > acc["at"]
            before = F.substring(text, (acc["at"] + 1).cast("int"), (F.greatest(s["start"], acc["at"]) - acc["at"]).cast("int"))
            grown = F.concat(acc["out"], before, F.when(s["start"] >= acc["at"], F.lit(mark)).otherwise(F.lit("")))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, grown).otherwise(acc["out"]).alias("out"))

        folded = F.aggregate(spans, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))))
        out = rows.withColumn("text", F.when(F.size(spans) > 0, folded).otherwise(text)).select(df.columns)
        return out.withColumn("n_chars", F.when(text.isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(df.schema["n_chars"].dataType))) if "n_chars" in df.columns else out

    return tidied(df.sparkSession, "redacted", build)
