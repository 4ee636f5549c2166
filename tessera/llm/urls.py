"""URL lists with dates: every capture is judged by the entries in force when it was fetched.

A list entry has a key (a host, which covers its subdomains, or a host with the beginning of
a path), a date, and an action: block, allow, or remove. The entries of a key follow each
other in time; each is in force from its date up to the next entry's date, so the list
becomes a table of validity intervals. A capture has the keys of its host, of the domains
above it and of the beginnings of its path; an equi-join on the key with the interval's
condition gives the entries as of the fetch time, and of these the one with the longest
key decides (of host and path keys as long, the last in order).

Only ids, URLs and times are joined. A list of up to BROADCAST_ENTRIES intervals is broadcast;
beyond that keys of many captures are, and the other keys are shuffled. Captures are shuffled
once, after the join, to one row for each.

Defined results: of entries of one key and date block wins over allow over remove; entries
with a null key, date or action, or another action are left out; a null URL, one without a
host, or a null time has no entry in force and is kept; scheme, user, port, letter case, a
final dot, query and fragment don't matter; empty parts of a path are skipped; rows that are
equal in id, URL and time count as one; an empty list blocks nothing; an empty table gives
an empty result. Other columns are never read by the verdicts, and stay in filtered pages.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spill import cut

#: The list of the registered query; any DataFrame (key, listed_on, action) may stand for it.
ENTRIES = [
    ("spam-farm.example.com", "2024-01-10", "block"),
    ("spam-farm.example.com", "2024-07-01", "remove"),
    ("spam-farm.example.com", "2024-10-15", "block"),
    ("ads-track.example.com", "2024-02-20", "block"),
    ("m.ads-track.example.com", "2024-05-05", "allow"),
    ("m.ads-track.example.com", "2024-09-01", "remove"),
    ("casino-win.example.com", "2024-03-01", "block"),
    ("casino-win.example.com", "2024-03-01", "allow"),
    ("casino-win.example.com/en", "2024-08-12", "allow"),
    ("blog.tionsh.example.com/de", "2024-04-01", "block"),
    ("blog.tionsh.example.com/fr", "2024-06-15", "block"),
    ("example.org", "2024-11-01", "block"),
    ("tionble.example.org", "2024-11-01", "allow"),
]
#: Intervals (some hundred bytes each in a hash relation) up to which the list is broadcast.
BROADCAST_ENTRIES = 500_000
#: A key of more than this share of all asked keys is hot; there are at most 1 / HOT_SHARE.
HOT_SHARE = 1e-4
ACTIONS = ("remove", "allow", "block")


def default_entries(spark: SparkSession) -> DataFrame:
    rows = [(k, date.fromisoformat(d), a) for k, d, a in ENTRIES]
    return spark.createDataFrame(rows, "key string, listed_on date, action string")


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, valid_from, valid_to): what is in force from valid_from on and before valid_to (null: for good)."""
    strength = F.array_position(F.array(*map(F.lit, ACTIONS)), F.lower("action"))
    good = entries.select(F.lower(F.trim("key")).alias("key"), F.col("listed_on").cast("timestamp").alias("valid_from"), strength.alias("s")).where("key is not null and valid_from is not null and s > 0")
    one = good.groupBy("key", "valid_from").agg(F.max("s").alias("s"))
    following = F.lead("valid_from").over(Window.partitionBy("key").orderBy("valid_from"))
    return one.select("key", F.get(F.array(*map(F.lit, ACTIONS)), (F.col("s") - 1).cast("int")).alias("action"), "valid_from", following.alias("valid_to"))


def keys(url: Column) -> Column:
    """Host keys from the whole host up to its last label, then host and path keys from short to long."""
    rest = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://", "")
    rest = F.regexp_replace(rest, r"[?#].*$", "")
    authority = F.regexp_extract(rest, r"^[^/]*", 0)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(F.regexp_replace(rest, r"^[^/]*", ""), "/"), lambda p: p != "")
    hosts = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    paths = F.transform(parts, lambda _, i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i + 1), "/")))
    return F.when(url.isNull() | (host == ""), F.array().cast("array<string>")).otherwise(F.concat(hosts, paths))


def verdicts(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, time_col: str) -> DataFrame:
    """(id, url, fetched_at, entry, action, listed_from, blocked): a row for each distinct capture."""
    c = captures.select(captures[id_col].alias(id_col), captures[url_col].alias("url"), captures[time_col].cast("timestamp").alias("fetched_at"))
    asked = c.withColumn("key", F.explode_outer(keys(F.col("url"))))
    held = _as_of(asked, intervals(entries))
    # The rows of a capture lie together, so they are one before they are shuffled.
    listed = F.struct(F.col("key").alias("entry"), "action", F.col("valid_from").alias("listed_from"))
    best = F.max_by(F.when(F.col("action").isin("block", "allow"), listed), F.when(F.col("action").isin("block", "allow"), F.struct(F.length("key"), "key")))
    out = held.groupBy(id_col, "url", "fetched_at").agg(best.alias("__b"))
    return out.select(id_col, "url", "fetched_at", "__b.entry", "__b.action", "__b.listed_from", F.coalesce(F.col("__b.action") == "block", F.lit(False)).alias("blocked"))


def _as_of(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """Captures by key, with the interval of the key that holds their time if there is one."""
    entries = cut(entries, "intervals")
    on = (asked["key"] == entries["key"]) & (entries["valid_from"] <= asked["fetched_at"]) & (entries["valid_to"].isNull() | (asked["fetched_at"] < entries["valid_to"]))
    rest = entries["action"], entries["valid_from"]
    if entries.count() <= BROADCAST_ENTRIES:
        return asked.join(F.broadcast(entries), on, "left").select(*(asked[x] for x in asked.columns), *rest)
    # A list beyond that: keys that many captures have ("com") are few. They are joined by broadcast, and the rest by a shuffle.
    sizes = cut(asked.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")), "keys")
    least = max(1_000, int((sizes.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE))
    hot = F.broadcast(sizes.where(F.col("n") >= least).select("key"))
    of_hot = F.broadcast(entries.join(hot, "key", "left_semi"))
    cold = asked.join(hot, asked["key"] == hot["key"], "left_anti").join(entries, on, "left").select(*(asked[x] for x in asked.columns), *rest)
    again = asked.alias("a").join(hot, F.col("a.key") == hot["key"], "left_semi")
    on = (again["key"] == of_hot["key"]) & (of_hot["valid_from"] <= again["fetched_at"]) & (of_hot["valid_to"].isNull() | (again["fetched_at"] < of_hot["valid_to"]))
    return again.join(of_hot, on, "left").select(*(again[x] for x in asked.columns), of_hot["action"], of_hot["valid_from"]).unionByName(cold)


def allowed_pages(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """`pages` without those that were blocked when they were fetched; columns as they are."""
    blocked = verdicts(pages, entries, id_col, url_col, time_col).where("blocked").select(F.col(id_col).alias("__id"), F.col("url").alias("__url"), F.col("fetched_at").alias("__at"))
    on = [pages[id_col].eqNullSafe(blocked["__id"]), pages[url_col] == blocked["__url"], pages[time_col].cast("timestamp") == blocked["__at"]]
    return pages.join(blocked, on, "left_anti")


def fetch_times(pages: DataFrame) -> DataFrame:
    """Pages have no fetch time: the registered query spreads them over 2024 by their ids."""
    day = F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")
    return pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp"))


def op9_temporal_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fetch_times(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    out = verdicts(pages, default_entries(spark), "page_id", "url", "fetched_at")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("fetched_at", "listed_from")})


_VALUES = ", ".join(f"('{k}', TIMESTAMP '{d}', '{a}')" for k, d, a in ENTRIES)
QUERIES = {"op9_temporal_url_list": op9_temporal_url_list}
ORACLE_SQL = {
    "op9_temporal_url_list": f"""
WITH e(key, d, action) AS (VALUES {_VALUES}),
one AS (SELECT key, d, max(CASE action WHEN 'block' THEN 3 WHEN 'allow' THEN 2 ELSE 1 END) AS s FROM e GROUP BY key, d),
i AS (SELECT key, d AS valid_from, ['remove', 'allow', 'block'][s] AS action, lead(d) OVER (PARTITION BY key ORDER BY d) AS valid_to FROM one),
c AS (SELECT DISTINCT page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST((page_id * 37) % 366 AS INTEGER)) AS fetched_at FROM pages),
r AS (SELECT *, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '[?#].*$', '') AS rest FROM c),
h AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_extract(rest, '^[^/]*'), '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') AS host,
      list_filter(string_split(regexp_replace(rest, '^[^/]*', ''), '/'), lambda x: x <> '') AS parts FROM r),
k AS (SELECT page_id, url, fetched_at, unnest(list_concat(
        list_transform(range(1, len(string_split(host, '.')) + 1), lambda n: array_to_string(string_split(host, '.')[n:], '.')),
        list_transform(range(1, len(parts) + 1), lambda n: host || '/' || array_to_string(parts[:n], '/')))) AS key FROM h WHERE host <> ''),
f AS (SELECT k.page_id, k.url, k.fetched_at, k.key, i.action, i.valid_from,
        row_number() OVER (PARTITION BY k.page_id, k.url, k.fetched_at ORDER BY length(k.key) DESC, k.key DESC) AS n
      FROM k JOIN i ON k.key = i.key AND i.valid_from <= k.fetched_at AND (i.valid_to IS NULL OR k.fetched_at < i.valid_to)
      WHERE i.action <> 'remove')
SELECT c.page_id, c.url, strftime(c.fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, f.key AS entry, f.action,
       strftime(f.valid_from, '%Y-%m-%d %H:%M:%S') AS listed_from, coalesce(f.action = 'block', false) AS blocked
FROM c LEFT JOIN f ON f.n = 1 AND c.page_id IS NOT DISTINCT FROM f.page_id AND c.url = f.url AND c.fetched_at = f.fetched_at"""
}
