"""URL filters over time: dated list entries become validity intervals, and an as-of join evaluates every capture against the
intervals that were open when it was fetched.

An entry (pattern, listed_on, action) adds or removes a host or parent domain at a time, a date or a timestamp. Of entries of one
time, adds come before removals. An interval starts with an add that finds the pattern off the list and ends with the next removal,
whose own time is outside; an entry that changes nothing, as from a list issued anew every day, starts none. A capture is blocked
when an interval of its host or of any parent domain of it holds its fetch time; the longest such pattern is reported, with the
start of its interval as `listed_since`.

Null or malformed URLs have no host and are never blocked, nor are captures without a time. Entries with a null pattern, time or
action, or another action than add or remove, are passed over. Repeated captures and entries and null ids change nothing. The
columns `host`, `blocked`, `pattern` and `listed_since` take the place of captures' columns of these names; other columns stay. An
empty list blocks nothing, no captures give no rows. Hosts are compared in lower case, without port, user or end dot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host(url: Column) -> Column:
    found = F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit("."))
    return F.when(found != "", found)


def entries_of(entries: DataFrame) -> DataFrame:
    """pattern, listed_on, action: the list in lower case, each entry once."""
    rows = entries.select(F.lower("pattern").alias("pattern"), "listed_on", F.lower("action").alias("action"))
    return rows.dropna().where(F.col("action").isin("add", "remove")).distinct()


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, valid_from, valid_to (first time no longer; null: still active) of every time on the list."""
    order = Window.partitionBy("pattern").orderBy("listed_on")
    # of one time, the last entry tells the state
    states = entries_of(entries).groupBy("pattern", "listed_on").agg(F.max("action").alias("action"))
    changes = states.withColumn("before", F.lag("action").over(order)).where("before IS NULL OR before != action")
    spans = changes.withColumn("valid_to", F.lead("listed_on").over(order)).where("action = 'add'")
    return spans.select("pattern", F.col("listed_on").alias("valid_from"), "valid_to")


def as_of(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """asked(pattern, time), one row each, that fall into an interval of their pattern, with its start as `listed_since`.

    Times are cut into ranges (months of dates, hours of timestamps). What is open at the start of a range comes from one line of a
    pattern's ranges; the times and starts within a range are put in line by themselves, so a pattern that is asked for at any
    number of times is many tasks' work.
    """
    dates = dict(asked.dtypes)["time"] == "date"
    part = F.date_trunc("month" if dates else "hour", "time")
    span = F.struct("valid_from", "valid_to")
    empty = F.lit(None).cast(spans.select(span.alias("s")).schema["s"].dataType)
    starts = spans.select("pattern", F.col("valid_from").alias("time"), F.lit(0).alias("asks"), span.alias("span"))
    rows = asked.select("pattern", "time", F.lit(1).alias("asks"), empty.alias("span")).unionByName(starts).withColumn("part", part)
    line = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("pattern", "part").agg(F.max("span").alias("latest"))
    ranges = ranges.select("pattern", "part", F.last("latest", ignorenulls=True).over(line).alias("open"))
    within = Window.partitionBy("pattern", "part").orderBy("time", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.last("span", ignorenulls=True).over(within)
    found = rows.withColumn("latest", latest).where("asks = 1").join(ranges, ["pattern", "part"])
    found = found.withColumn("last", F.coalesce("latest", "open")).where("last IS NOT NULL AND (last.valid_to IS NULL OR time < last.valid_to)")
    return found.select("pattern", "time", F.col("last.valid_from").alias("listed_since"))


ADDED = ("host", "blocked", "pattern", "listed_since")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(url, fetched_on, ...) with host, blocked, pattern (the longest active) and listed_since.

    Hosts are reduced to those with a listed pattern first; what a pattern's state was at a time is found once for each of the
    two, so neither a hot host or domain nor a list issued daily multiplies rows. Writes small tables on the way.
    """
    kept = ["`" + c.replace("`", "``") + "`" for c in captures.columns if c.lower() not in ADDED]
    rows = captures.select(F.struct(*kept).alias("row"), host(F.col("url")).alias("host"), F.col("fetched_on").alias("time"))
    asked = rows.where("host IS NOT NULL AND time IS NOT NULL").select("host", "time").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spans = materialize(intervals(entries))
    hosts = rows.where("host IS NOT NULL").select("host").distinct().withColumn("pattern", F.explode(parents)).join(spans.select("pattern").distinct(), "pattern")
    asked = materialize(asked.join(hosts, "host").select("host", "time", "pattern"))
    state = materialize(as_of(asked.select("pattern", "time").distinct(), spans))
    longest = F.max(F.struct(F.length("pattern").alias("n"), F.col("pattern"), F.col("listed_since"))).alias("best")
    found = materialize(asked.join(state, ["pattern", "time"]).groupBy("host", "time").agg(longest).select(F.col("host").alias("h"), F.col("time").alias("t"), "best"))
    joined = rows.join(found, (F.col("host") == F.col("h")) & (F.col("time") == F.col("t")), "left")
    return joined.select("row.*", "host", F.col("best").isNotNull().alias("blocked"), "best.pattern", "best.listed_since")


def demo_list(pages: DataFrame) -> DataFrame:
    """A dated list drawn from the hosts of the pages themselves: which, when and for how long follows from their MD5."""
    hosts = pages.select(host(F.col("url")).alias("host")).where("host IS NOT NULL").distinct().withColumn("m", F.md5("host"))
    digits = lambda a, n: F.conv(F.substring("m", a, n), 16, 10).cast("int")
    day = lambda n: F.date_add(F.to_date(F.lit("2024-01-01")), n)
    first, gone = digits(2, 3) % 300, digits(2, 3) % 300 + 1 + digits(6, 2) % 60
    labels = F.split("host", r"\.")
    parent = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    entry = lambda ok, pattern, n, action: F.when(ok, F.struct(pattern.alias("pattern"), day(n).alias("listed_on"), F.lit(action).alias("action")))
    some = digits(1, 1) < 8
    made = F.array(
        entry(some, F.col("host"), first, "add"),
        entry(some & (digits(5, 1) < 8), F.col("host"), gone, "remove"),
        entry(some & (digits(5, 1) < 8) & (digits(8, 1) < 8), F.col("host"), gone + 10, "add"),
        entry(digits(10, 2) == 0, parent, F.lit(200), "add"),
        entry(digits(10, 2) == 0, parent, F.lit(210), "remove"),
    )
    return hosts.select(F.inline(F.filter(made, lambda x: x.isNotNull())))


def captures(pages: DataFrame) -> DataFrame:
    """The pages as captures: the tables have no fetch time, so the day follows from the page's number."""
    day = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched_on"))


ORACLE = r"""
WITH c AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS fetched_on,
         nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.'), '') AS host
  FROM pages),
m AS (SELECT host, md5(host) AS m, string_split(host, '.') AS l FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL)),
k AS (
  SELECT host, CAST('0x' || m[1:1] AS INTEGER) AS a, CAST('0x' || m[2:4] AS INTEGER) % 300 AS first,
         CAST('0x' || m[5:5] AS INTEGER) AS b, CAST('0x' || m[6:7] AS INTEGER) % 60 AS len, CAST('0x' || m[8:8] AS INTEGER) AS d,
         CAST('0x' || m[10:11] AS INTEGER) AS e, CASE WHEN len(l) > 1 THEN l[-2] || '.' || l[-1] ELSE host END AS parent
  FROM m),
entries AS (
  SELECT host AS pattern, first AS day, 'add' AS action FROM k WHERE a < 8
  UNION SELECT host, first + 1 + len, 'remove' FROM k WHERE a < 8 AND b < 8
  UNION SELECT host, first + 11 + len, 'add' FROM k WHERE a < 8 AND b < 8 AND d < 8
  UNION SELECT parent, 200, 'add' FROM k WHERE e = 0
  UNION SELECT parent, 210, 'remove' FROM k WHERE e = 0),
states AS (SELECT pattern, day, max(action) AS action FROM entries GROUP BY 1, 2),
changes AS (
  SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY pattern ORDER BY day) AS before FROM states)
  WHERE before IS NULL OR before != action),
spans AS (
  SELECT pattern, action, DATE '2024-01-01' + day AS valid_from,
         lead(DATE '2024-01-01' + day) OVER (PARTITION BY pattern ORDER BY day) AS valid_to
  FROM changes),
hit AS (
  SELECT c.host, c.fetched_on, s.pattern, s.valid_from,
         row_number() OVER (PARTITION BY c.host, c.fetched_on ORDER BY length(s.pattern) DESC) AS n
  FROM (SELECT DISTINCT host, fetched_on FROM c) c JOIN spans s
    ON s.action = 'add' AND (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern))
   AND s.valid_from <= c.fetched_on AND (s.valid_to IS NULL OR c.fetched_on < s.valid_to))
SELECT c.page_id, c.url, c.fetched_on, c.host, hit.pattern IS NOT NULL AS blocked, hit.pattern, hit.valid_from AS listed_since
FROM c LEFT JOIN hit ON hit.host = c.host AND hit.fetched_on = c.fetched_on AND hit.n = 1
"""
