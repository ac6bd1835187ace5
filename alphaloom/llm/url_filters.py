"""URL filters in DataFrame functions only: a temporal join of captures with dated lists.

A list is a table of dated entries (list, kind, pattern, action, since): kind 'domain'
covers a host and its subdomains, 'prefix' a host with a path prefix that ends at a
segment (hosts are compared in lower case, paths as they are); action 'add' or 'remove' takes
effect at `since`. Entries of one pattern become validity intervals [since, next entry); an
as-of join evaluates every capture against the entries active when it was fetched.

Scale: distinct hosts and paths, not captures, meet the list's patterns, so a host that
holds a third of all captures costs one row there. What they match, with its intervals, is
counted: up to `BROADCAST_ROWS` it is broadcast to the captures' as-of join, beyond that both sides are
salted, so that no host is one task's work. Lists of any size work.

Defined results: a null or host-less URL, or a null fetch time, matches nothing; of
entries of one pattern at one time a 'remove' wins; rows that repeat give repeated results;
empty tables give empty ones; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.llm.shared import materialise, table

#: Names listed in the built-in example list, with the list and the month each enters it.
LISTED = [
    ("adult-x", "adult", "2023-02-01"), ("casino-win", "gambling", "2023-04-01"), ("free-bets", "gambling", "2023-08-01"),
    ("cheap-pills", "pharma", "2023-06-01"), ("spam-farm", "spam", "2023-01-15"), ("ads-track", "tracking", "2024-03-01"),
]
#: Single entries of the example list.
SINGLE = [
    ("spam", "domain", "spam-farm.example.org", "remove", "2024-02-01"), ("spam", "domain", "spam-farm.example.org", "add", "2025-01-01"),
    ("gambling", "domain", "free-bets.example.com", "remove", "2024-05-01"), ("pharma", "domain", "www.cheap-pills.example.com", "add", "2023-03-01"),
    ("review", "prefix", "tionsh.example.net/fr", "add", "2023-05-01"), ("review", "prefix", "tionsh.example.net/fr", "remove", "2025-05-01"),
    ("review", "prefix", "blog.tionble.example.com/de", "add", "2024-01-01"),
]
ENTRIES = "list string, kind string, pattern string, action string, since string"
#: Rows of matched intervals that are broadcast, and salts beyond that.
BROADCAST_ROWS, SALTS = 200_000, 32


def example_entries(spark: SparkSession) -> DataFrame:
    """The dated entries of the example list: each listed name under three top-level domains, and the single entries."""
    rows = [(group, "domain", f"{name}.example.{tld}", "add", since) for name, group, since in LISTED for tld in ("com", "net", "org")] + SINGLE
    return spark.createDataFrame(rows, ENTRIES).withColumn("since", F.col("since").cast("timestamp"))


def watch_entries(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Dated entries drawn from a table of pages, so that the list grows with it: each seventh host (by its MD5) is watched for 200 days from a day that its MD5 gives."""
    hosts = pages.select(host_of(F.col(url_col)).alias("pattern")).where("pattern is not null").distinct()
    number = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("int")
    begun = F.date_add(F.lit("2023-01-01").cast("date"), number % 800)
    picked = hosts.where(number % 7 == 0).select(F.lit("watch").alias("list"), F.lit("domain").alias("kind"), "pattern", begun.alias("begun"))
    event = lambda action, day: picked.select("list", "kind", "pattern", F.lit(action).alias("action"), day.cast("timestamp").alias("since"))
    return event("add", F.col("begun")).unionByName(event("remove", F.date_add("begun", 200)))


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null if there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(h, r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, valid_from, valid_to): the spans in which an entry is in force; an open end is null."""
    host = F.lower(F.substring_index("pattern", "/", 1))
    pattern = F.concat(host, F.substring("pattern", F.length(host) + 1, F.length("pattern")))
    once = entries.groupBy("list", "kind", pattern.alias("pattern"), "since").agg(F.max(F.col("action") == "remove").alias("off"))
    w = Window.partitionBy("list", "kind", "pattern").orderBy("since")
    return once.withColumn("valid_to", F.lead("since").over(w)).where(~F.col("off")).select("list", "kind", "pattern", F.col("since").alias("valid_from"), "valid_to")


def _as_of(captures: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """As-of join: each capture with the entries of its key that were active when it was fetched."""
    side = spans.withColumnsRenamed({k: f"s_{k}" for k in keys})
    on = (F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    for k in keys:
        on = on & (F.col(k) == F.col(f"s_{k}"))
    if spans.count() <= BROADCAST_ROWS:
        return captures.join(F.broadcast(side), on)
    salted = captures.withColumn("salt", F.pmod(F.xxhash64("id", "url", "fetched"), F.lit(SALTS)))
    copies = side.withColumn("s_salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return salted.join(copies, on & (F.col("salt") == F.col("s_salt"))).drop("salt", "s_salt")


def judge(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, time_col: str) -> DataFrame:
    """(id, url, host, fetched, n_entries, lists, blocked) for every capture."""
    spans = materialise(intervals(entries), "spans")
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched"))
    once = rows.groupBy("id", "url", "fetched").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    caps = once.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = rows.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host is not null")
    # Domain entries: distinct hosts meet them under each of their parent domains.
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = named.select("host").distinct().withColumn("pattern", F.explode(parents))
    by_host = materialise(hosts.join(spans.where("kind = 'domain'"), "pattern").drop("kind"), "by_host")
    # Path entries: distinct (host, path) pairs, under each prefix that ends at a segment.
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat_ws("/", F.col("host"), F.array_join(F.slice(segments, F.lit(1), i), "/")))
    paths = named.distinct().withColumn("pattern", F.explode(F.when(F.size(segments) > 0, prefixes)))
    by_path = materialise(paths.join(spans.where("kind = 'prefix'"), "pattern").drop("kind"), "by_path")
    held = _as_of(caps, by_host, ["host"]).select("id", "url", "fetched", "list").unionByName(_as_of(caps, by_path, ["host", "path"]).select("id", "url", "fetched", "list"))
    verdict = held.groupBy("id", "url", "fetched").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    d = caps.join(verdict.withColumnsRenamed({k: f"v_{k}" for k in ("id", "url", "fetched")}), (F.col("id").eqNullSafe(F.col("v_id"))) & (F.col("url") == F.col("v_url")) & (F.col("fetched") == F.col("v_fetched")), "left")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return d.select("id", "url", "host", "fetched", F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("lists", F.lit("")).alias("lists"), F.col("n").isNotNull().alias("blocked"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the example list and the watch list of all pages' hosts. Pages carry no fetch time, so the query gives each one by a rule of its id within 2023 to 2025."""
    fetched = F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id") * 389, F.lit(1096)).cast("int")).cast("timestamp")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched"))
    judged = judge(pages, example_entries(spark).unionByName(watch_entries(pages)), "page_id", "url", "fetched").withColumnRenamed("id", "page_id")
    return judged.withColumn("fetched", F.col("fetched").cast("timestamp_ntz"))


_ROWS = ", ".join(str(r) for r in [(g, "domain", f"{n}.example.{t}", "add", s) for n, g, s in LISTED for t in ("com", "net", "org")] + SINGLE)
OP2_SQL = rf"""
WITH hosts AS (
  SELECT DISTINCT nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', ''), '') AS pattern FROM pages
), watched AS (
  SELECT pattern, DATE '2023-01-01' + (('0x' || substr(md5(pattern), 1, 6))::INT % 800)::INT AS begun FROM hosts WHERE pattern IS NOT NULL AND ('0x' || substr(md5(pattern), 1, 6))::INT % 7 = 0
), entries AS (
  SELECT * FROM (VALUES {_ROWS}) AS v(list, kind, pattern, action, since)
  UNION ALL SELECT 'watch', 'domain', pattern, 'add', begun::VARCHAR FROM watched UNION ALL SELECT 'watch', 'domain', pattern, 'remove', (begun + 200)::VARCHAR FROM watched
), caps AS (
  SELECT row_number() OVER () AS rid, page_id, url, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', ''), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
         (DATE '2023-01-01' + (page_id * 389 % 1096)::INT)::TIMESTAMP AS fetched FROM pages
), parts AS (
  SELECT *, string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM caps
), keys AS (
  SELECT rid, fetched, 'domain' AS kind, array_to_string(list_slice(l, i, len(l)), '.') AS pattern FROM parts, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)
  UNION ALL
  SELECT rid, fetched, 'prefix', host || '/' || array_to_string(list_slice(s, 1, i), '/') FROM parts, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)
), groups AS (SELECT DISTINCT list FROM entries),
events AS (SELECT list, kind, pattern, action, since::TIMESTAMP AS since FROM entries),
latest AS (
  SELECT k.rid, e.list, e.action FROM (SELECT keys.*, groups.list FROM keys, groups) k
  ASOF JOIN events e ON k.kind = e.kind AND k.pattern = e.pattern AND k.list = e.list AND k.fetched >= e.since
), verdict AS (
  SELECT rid, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM latest WHERE action = 'add' GROUP BY rid
)
SELECT page_id, url, host, fetched, coalesce(n, 0)::BIGINT AS n_entries, coalesce(lists, '') AS lists, n IS NOT NULL AS blocked FROM caps LEFT JOIN verdict USING (rid)
"""
