"""URL filters by a temporal list join, in DataFrame operations only.

A list is a log of dated entries (pattern, at, action). Entries of one pattern follow each
other, so each is valid from its date until the pattern's next one. A capture is judged by
the entries that were active when it was fetched: an as-of join on the keys that its URL can
match, its host, the parent domains and its path's prefixes, and on the interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Actions of an entry. Of entries with the same pattern and date the first of
#: these holds; ``remove`` ends what was valid before.
ACTIONS = ("block", "allow", "remove")

#: A host, in brackets an IPv6 address, and an IPv4 address; addresses have no parent domains.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@]*)"
ADDRESS = r"^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case without a dot at its end; empty if the URL has none."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, HOST, 1), r"\.+$", ""))


def keys_of(url: Column) -> Column:
    """What a list can hold for a URL: its host and the host's parent domains, and host with path
    cut after each segment (``a.b/x``, ``a.b/x/y``). Query and fragment don't count. Hosts are in lower
    case, paths as they are; an IP address has no parent domains."""
    host = host_of(url)
    labels, segments = F.split(host, r"\."), F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    n, m = F.size(labels), F.size(segments)
    domains = F.transform(F.sequence(F.lit(1), F.when(host.rlike(ADDRESS), 1).otherwise(n)), lambda i: F.array_join(F.slice(labels, i, n), "."))
    paths = F.transform(F.slice(F.sequence(F.lit(0), m), F.lit(2), m), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, F.when(m > 0, paths).otherwise(F.array().cast("array<string>")))))


def folded(pattern: Column) -> Column:
    """A list's pattern with its host in lower case; a path tells cases apart, as URLs do."""
    host = F.substring_index(pattern, "/", 1)
    return F.concat(F.lower(host), F.substr(pattern, F.length(host) + 1))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, since, until) of entries (pattern, at, action), ``remove`` left out.

    until is exclusive and null if the entry still holds. Entries with a null pattern, date or
    action, or another action than ACTIONS, are ignored; repeated ones count once.
    """
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    log = entries.select(folded(F.col("pattern")).alias("pattern"), "at", rank.alias("rank")).where("pattern is not null and at is not null and rank > 0")
    log = log.groupBy("pattern", "at").agg(F.min("rank").alias("rank"))
    by_pattern = Window.partitionBy("pattern").orderBy("at")
    log = log.withColumn("until", F.lead("at").over(by_pattern)).where(F.col("rank") < len(ACTIONS))
    return log.select("pattern", F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("rank").cast("int")).alias("action"), F.col("at").alias("since"), "until")


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (id, url, fetched) with host, verdict, pattern and since added, one row for each row.

    The longest pattern that was active decides: a path over its host, a host over its parent
    domains. Without one the verdict is ``none``; so it is for a null or malformed URL and a null
    time. A verdict depends on URL and time alone, so each such pair is judged once, and equal
    rows get equal verdicts. The joins are plain equi-joins on the key with the interval as a
    further condition: intervals of a pattern don't overlap, so no capture finds two of them,
    and adaptive execution can split a host that very many captures share.
    """
    captures = captures.select("id", "url", "fetched")  # other columns are ignored, whatever their names
    pairs = captures.select(F.col("url").alias("u"), F.col("fetched").alias("f")).where("u is not null and f is not null").distinct()
    keyed = pairs.select("u", "f", F.explode(keys_of(F.col("u"))).alias("key"))
    active = intervals(entries)
    met = keyed.join(active, (F.col("key") == F.col("pattern")) & (F.col("since") <= F.col("f")) & (F.col("until").isNull() | (F.col("f") < F.col("until"))))
    best = met.groupBy("u", "f").agg(F.max_by(F.struct("pattern", "action", "since"), F.length("pattern")).alias("hit"))
    out = captures.join(best, (F.col("url") == F.col("u")) & (F.col("fetched") == F.col("f")), "left")
    return out.select("id", "url", "fetched", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce("hit.action", F.lit("none")).alias("verdict"), F.col("hit.pattern").alias("pattern"), F.col("hit.since").alias("since"))


def captures_of(pages: DataFrame) -> DataFrame:
    """(id, url, fetched) of the table of pages. It has no time of fetching: a date in 2023 or 2024 is
    taken from the page's id."""
    day = F.pmod(F.col("page_id").cast("long") * 7919, F.lit(730)).cast("int")
    return pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.date_add(F.lit("2023-01-01").cast("date"), day).alias("fetched"))


def list_of(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own hosts, for the query: every third host, by its checksum, is
    blocked on some day and removed or allowed later; two domains are blocked throughout, and
    one of them has a path that is allowed for a time."""
    hosts = pages.select(host_of(F.col("url").cast("string")).alias("pattern")).where("pattern <> ''").distinct()
    n = F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 7), 16, 10).cast("long")
    start = F.lit("2023-01-01").cast("date")
    day = lambda c: F.date_add(start, c.cast("int"))
    listed = hosts.withColumn("n", n).where("n % 3 = 0")
    first = listed.select("pattern", day(F.col("n") % 500).alias("at"), F.lit("block").alias("action"))
    later = listed.select("pattern", day(F.col("n") % 500 + 1 + F.floor(F.col("n") / 1024) % 200).alias("at"), F.when(F.col("n") % 2 == 0, "remove").otherwise("allow").alias("action"))
    fixed = [("cheap-pills.example.com", "2023-01-01", "block"), ("spam-farm.example.org", "2023-01-01", "block"), ("spam-farm.example.org/en", "2023-06-01", "allow"), ("spam-farm.example.org/en", "2024-03-01", "remove")]
    rows = pages.sparkSession.createDataFrame(fixed, "pattern string, at string, action string").select("pattern", F.col("at").cast("date").alias("at"), "action")
    return first.unionByName(later).unionByName(rows)


#: The query's result in DuckDB SQL.
SQL = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2023-01-01' + CAST(page_id * 7919 % 730 AS INTEGER) AS fetched,
         lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@]*)', 1), '\.+$', '')) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS segments
  FROM pages),
hosts AS (SELECT DISTINCT host AS pattern, CAST(concat('0x', substr(md5(host), 1, 7)) AS BIGINT) AS n FROM captures WHERE host <> ''),
log AS (
  SELECT pattern, DATE '2023-01-01' + CAST(n % 500 AS INTEGER) AS day, 1 AS action FROM hosts WHERE n % 3 = 0
  UNION ALL
  SELECT pattern, DATE '2023-01-01' + CAST(n % 500 + 1 + (n // 1024) % 200 AS INTEGER), CASE WHEN n % 2 = 0 THEN 3 ELSE 2 END FROM hosts WHERE n % 3 = 0
  UNION ALL
  SELECT * FROM (VALUES ('cheap-pills.example.com', DATE '2023-01-01', 1), ('spam-farm.example.org', DATE '2023-01-01', 1),
    ('spam-farm.example.org/en', DATE '2023-06-01', 2), ('spam-farm.example.org/en', DATE '2024-03-01', 3)) AS fixed(pattern, day, action)),
one AS (SELECT pattern, day, min(action) AS action FROM log GROUP BY ALL),
valid AS (SELECT *, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS until FROM one),
keys AS (
  SELECT page_id, fetched, unnest(list_distinct(list_concat(
    list_transform(range(1, CASE WHEN regexp_matches(host, '^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$') THEN 2 ELSE len(string_split(host, '.')) + 1 END), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(segments) + 1), lambda i: concat(host, '/', array_to_string(segments[:i], '/')))))) AS key
  FROM captures WHERE host <> ''),
hits AS (
  SELECT k.page_id, arg_max(v, length(v.pattern)) AS v
  FROM keys k JOIN valid v ON k.key = v.pattern AND v.action < 3 AND v.day <= k.fetched AND (v.until IS NULL OR k.fetched < v.until)
  GROUP BY 1)
SELECT c.page_id, c.host, CAST(c.fetched AS VARCHAR) AS fetched,
       coalesce(['block', 'allow'][h.v.action], 'none') AS verdict, h.v.pattern AS pattern, CAST(h.v.day AS VARCHAR) AS since
FROM captures c LEFT JOIN hits h USING (page_id)
"""
