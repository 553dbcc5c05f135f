"""URL filters: a temporal join of captures with dated block lists.

List entries are dated events: a list adds a pattern or drops it. Consecutive events of a pattern make validity
intervals, and a capture is held against the intervals that were open when it was fetched. Patterns are hosts (they
cover their subdomains) or hosts with a first path segment.

Intervals are cut at the bounds of time slices, so that a pattern that changes often, or a host that most captures
are of, is spread over its slices. Few pieces are broadcast and looked up by pattern and slice. Many are joined as
of the fetch: pieces and captures of a list, pattern, slice and salt are sorted by time, and each capture takes the
last piece that began before it, if that was still open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: Pieces of intervals up to which they are sent to every executor (under 100 bytes each); beyond, captures and pieces are shuffled.
BROADCAST_PIECES = 200_000
SLICE_SECONDS = 30 * 86_400

_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"
_ADDRESS = r"^(\d+(\.\d+){3}|\[.*\])$"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port or trailing dots; null without one. IPv6 addresses keep their brackets."""
    host = F.lower(F.regexp_extract(F.trim(url), _URL, 1))
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def normal_pattern(pattern: Column) -> Column:
    """A list entry as captures are looked up: the host in lower case without trailing dots, the path as it is but for a slash at its end."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.trim(pattern), "^[^/]*", 0)), r"\.+$", "")
    return F.concat(host, F.regexp_replace(F.regexp_extract(F.trim(pattern), "/.*$", 0), "/+$", ""))


def patterns_of(url: Column) -> Column:
    """All patterns that cover a URL: the host, its parents down to two labels, and the host with the first path segment. Addresses have no parents."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    last = F.when(host.rlike(_ADDRESS), F.lit(1)).otherwise(F.greatest(F.size(labels) - 1, F.lit(1)))
    parents = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^/?#]+)", 1)
    deep = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(parents, deep))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, since, until) of the times a pattern was on a list, from events (list, pattern, at, added).

    Patterns that differ only in the case of their host are one. until is the first moment it wasn't any more, null
    if it still is. Events that repeat a state change nothing; of events at one time an addition wins. Events with a
    null list, pattern, time or state are ignored.
    """
    known = entries.where("list is not null and pattern is not null and at is not null and added is not null")
    once = known.groupBy("list", normal_pattern(F.col("pattern")).alias("pattern"), "at").agg(F.max("added").alias("added"))  # bool_or
    w = Window.partitionBy("list", "pattern").orderBy("at")
    turns = once.withColumn("was", F.lag("added").over(w)).where("added <> coalesce(was, false)")
    return turns.withColumn("until", F.lead("at").over(w)).where("added").select("list", "pattern", F.col("at").alias("since"), "until")


def slice_of(at: Column) -> Column:
    return F.floor(F.unix_seconds(at.cast("timestamp")) / SLICE_SECONDS)


def pieces(valid: DataFrame, last: Column) -> DataFrame:
    """Intervals cut at the slices' bounds: a row for each slice that an interval is open in, up to the slice `last`."""
    end = F.coalesce(slice_of(F.col("until")), last)
    return valid.where(slice_of(F.col("since")) <= last).withColumn("slice", F.explode(F.sequence(slice_of(F.col("since")), F.least(end, last))))


def as_of(keyed: DataFrame, cut: DataFrame, salts: int) -> DataFrame:
    """keyed (id, url, fetched_at, pattern, slice) and pieces (list, pattern, since, until, slice) -> the pieces open at each fetch.

    Both sides meet sorted by time within (list, pattern, slice, salt); the last piece begun is the only one of its
    list that can be open, as a list's intervals of a pattern don't overlap.
    """
    lists = cut.select("list", "pattern", "slice").distinct()
    asked = keyed.join(lists, ["pattern", "slice"]).withColumn("salt", F.pmod(F.xxhash64("id", "url", "fetched_at"), F.lit(salts)).cast("int"))
    begun = cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    piece = F.struct("since", "until")
    rows = asked.select("list", "pattern", "slice", "salt", F.col("fetched_at").alias("time"), F.lit(1).alias("asks"), "id", "url", F.lit(None).cast("struct<since:timestamp,until:timestamp>").alias("piece")).union(
        begun.select("list", "pattern", "slice", "salt", F.col("since").alias("time"), F.lit(0).alias("asks"), F.lit(None).cast(keyed.schema["id"].dataType), F.lit(None).cast("string"), piece)
    )
    w = Window.partitionBy("list", "pattern", "slice", "salt").orderBy("time", "asks").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("last", F.last("piece", ignorenulls=True).over(w)).where("asks = 1 and last is not null")
    return met.where("last.until is null or time < last.until").select("id", "url", F.col("time").alias("fetched_at"), "list", "pattern", F.col("last.since").alias("since"))


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """id, url, fetched_at, host, lists, n_entries, listed_since, blocked of every capture.

    lists: the sorted names of lists with an entry that covers the URL and was open at that time; n_entries: how
    many such entries; listed_since: the earliest of their starts. Captures without a URL, host or time match
    nothing. Equal captures get equal rows, one each. Hosts match in any case, paths only as written; the host of a
    URL is read whatever its length. Without entries nothing is blocked, without captures there are no rows; other
    columns are ignored.
    """
    spark = captures.sparkSession
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).cast("timestamp").alias("fetched_at"))
    valid = intervals(entries.withColumn("at", F.col("at").cast("timestamp")))
    last = rows.agg(F.max("fetched_at").alias("m")).select(slice_of(F.col("m")).alias("s")).first()["s"]
    cut = pieces(valid, F.lit(-1 if last is None else last).cast("long"))
    keyed = rows.where("fetched_at is not null").where(host_of(F.col("url")).isNotNull()).select("*", F.explode(patterns_of(F.col("url"))).alias("pattern"), slice_of(F.col("fetched_at")).alias("slice"))
    if cut.limit(BROADCAST_PIECES + 1).count() <= BROADCAST_PIECES:
        met = keyed.join(F.broadcast(cut), ["pattern", "slice"]).where("since <= fetched_at and (until is null or fetched_at < until)")
    else:
        met = as_of(keyed, cut, max(4, min(64, shuffle_partitions(spark) // 4)))
    entry = F.struct("list", "pattern", "since")
    none = F.lit(None).cast("struct<list:string,pattern:string,since:timestamp>")
    # Captures and hits are grouped together: one shuffle, in which equal captures and their hits are joined before it.
    both = rows.select("id", "url", "fetched_at", F.lit(1).alias("n"), none.alias("entry")).union(met.select("id", "url", "fetched_at", F.lit(0), entry.alias("entry")))
    found = both.groupBy("id", "url", "fetched_at").agg(F.sum("n").alias("n"), F.collect_set("entry").alias("entries"))  # as many entries as lists hold patterns of one URL
    one = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return one.select(
        "id", "url", "fetched_at", host_of(F.col("url")).alias("host"), F.array_join(F.array_sort(F.array_distinct(F.col("entries.list"))), ",").alias("lists"),
        F.size("entries").cast("long").alias("n_entries"), F.array_min("entries.since").alias("listed_since"), (F.size("entries") > 0).alias("blocked"),
    )
