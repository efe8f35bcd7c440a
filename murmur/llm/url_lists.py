"""URL filters with dated lists: list entries become validity intervals, captures are judged as of their fetch time.

An entry names a host (which covers its subdomains; a scheme, user or port around it is dropped), or a host and a path
(which covers what lies at or below the path on that host and its subdomains), and a date on which it was put on or
taken off the list. The state after each entry holds until the next entry for the same host and path; ``intervals``
keeps the listed ones. ``evaluate`` looks up each capture's host and all its parent hosts among the intervals that hold
at its fetch time, and keeps those whose path, if any, is the capture's or a folder above it.

Scale: intervals are cut by month and joined on host and month, so a host with a long history doesn't meet every one of
its captures with every one of its intervals. A hot host is spread by the skew-split join, or the list is broadcast
where its table is small. Only keys are joined, never pages.

Edge cases: a null or unparsable url, or a null fetch time, is under no entry; of entries of one host and date, putting
on wins; repeated captures (all three columns equal) fold into one row with their number; an empty list blocks nothing;
empty captures give an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidied

HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), "\\.+$", "")


def entry_host(entry: Column) -> Column:
    """The host that an entry names: lower-case, without scheme, user, port, path, leading wildcard and final dot; null
    where nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(entry)), "^[a-z][a-z0-9+.-]*://|^//", "")
    host = F.regexp_replace(F.regexp_replace(bare, "[/?#].*$", ""), "^[^@]*@|:[0-9]*$", "")
    return F.nullif(F.regexp_replace(host, "^(\\*?\\.)+|\\.+$", ""), F.lit(""))


def entry_path(entry: Column) -> Column:
    """The path that an entry names, with a slash at its begin and none at its end; empty where it names the whole host.
    Query and fragment are dropped; letters keep their case."""
    bare = F.regexp_replace(F.trim(entry), "^[A-Za-z][A-Za-z0-9+.-]*://|^//", "")
    return F.regexp_replace(F.regexp_extract(bare, "^[^/?#]*(/[^?#]*)", 1), "/+$", "")


def path_of(url: Column) -> Column:
    """The path of an address, a slash if it has none."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def intervals(entries: DataFrame) -> DataFrame:
    """host, path, listed_from, listed_to (null: still listed). entries: host, dated, listed (boolean)."""
    named = entries.withColumn("path", F.when(entry_host(F.col("host")).isNotNull(), entry_path(F.col("host")))).withColumn("host", entry_host(F.col("host")))
    one = named.filter("host IS NOT NULL AND dated IS NOT NULL").groupBy("host", "path", "dated").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    after = F.lead("dated").over(Window.partitionBy("host", "path").orderBy("dated"))
    return one.withColumn("listed_to", after).filter("listed").select("host", "path", F.col("dated").alias("listed_from"), "listed_to")


def suffixes(host: Column) -> Column:
    """The host and all its parents, the last label alone included."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched, n_captures, n_active (hosts with an entry that covers it), pattern (the longest of them with
    its longest path), blocked of each capture.

    captures: page_id, url, fetched (date).
    """
    return tidied(captures.sparkSession, "judged-captures", lambda: _evaluated(captures, entries))


def _evaluated(captures: DataFrame, entries: DataFrame) -> DataFrame:
    one = captures.groupBy("page_id", "url", "fetched").agg(F.count("*").alias("n_captures"))
    first, last = one.agg(F.min("fetched"), F.max("fetched")).head()
    month = lambda d: F.trunc(d, "month")
    clipped = intervals(entries)
    if first is not None:
        begin = F.greatest("listed_from", F.lit(first))
        end = F.least(F.coalesce(F.date_sub("listed_to", 1), F.lit(last)), F.lit(last))
        clipped = clipped.filter(begin <= end).withColumn("month", F.explode(F.sequence(month(begin), month(end), F.expr("interval 1 month"))))
    else:
        clipped = clipped.withColumn("month", month("listed_from"))
    held = stored(clipped, "list-intervals")
    keyed = one.withColumn("host", F.explode(suffixes(host_of(F.col("url"))))).withColumn("month", month("fetched")).withColumn("at", F.concat(path_of(F.col("url")), F.lit("/")))
    hit = (F.col("fetched") >= F.col("listed_from")) & (F.col("listed_to").isNull() | (F.col("fetched") < F.col("listed_to"))) & F.col("at").startswith(F.concat("path", F.lit("/")))
    joined = keyed.join(held, ["host", "month"], "left").withColumn("active", F.when(hit, F.col("host")))
    keys = ["page_id", "url", "fetched", "n_captures"]
    top = F.max(F.when(F.col("active").isNotNull(), F.struct(F.char_length("active").alias("size"), F.char_length("path").alias("deep"), F.concat("active", "path").alias("pattern"))))
    out = joined.groupBy(*keys).agg(F.count_distinct("active").alias("n_active"), top.alias("top"))
    return out.select(*keys, "n_active", F.col("top.pattern").alias("pattern"), (F.col("n_active") > 0).alias("blocked"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A list drawn from the pages' own hosts, for data without one (the given tables hold no list): by digest, some hosts
    go on and off it."""
    hosts = pages.select(host_of(F.col("url")).alias("h")).filter("h <> ''").select(F.explode(F.array("h", F.regexp_replace("h", "^[^.]+\\.", ""))).alias("host")).distinct()
    number = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), "host")), 1, 6), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    chosen = hosts.filter(F.size(F.split("host", "\\.")) > 2).filter(number("in:") % 5 == 0)
    on, off, again = number("on:") % 200, number("off:") % 60 + 1, number("again:") % 90 + 1
    dates = F.array(F.struct(day(on).alias("dated"), F.lit(True).alias("listed")), F.struct(day(on + off).alias("dated"), F.lit(False).alias("listed")), F.struct(day(on + off + again).alias("dated"), (number("back:") % 2 == 0).alias("listed")))
    return chosen.select("host", F.explode(dates).alias("e")).select("host", "e.dated", "e.listed")


def dated_captures(pages: DataFrame) -> DataFrame:
    """Captures of the pages: the fetch date follows from the page's id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 360).cast("int")).alias("fetched"))
