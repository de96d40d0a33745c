"""URL filters over time: a dated list becomes validity intervals, and each capture is judged by those at its fetch time.

A list is a table of events (key, at, action, kind): from `at` on the key is blocked ('block') or free again ('allow').
A key is a host or a host's suffix, optionally with a path prefix: `example.org`, `example.org/ads/`. The as-of join
takes for each capture and each key that its URL falls under the last event at or before the fetch time; the capture is
blocked if any of those blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read_table, spare

#: Intervals are cut at multiples of this many seconds, so that one key's captures meet few intervals at a time.
BUCKET_S = 90 * 86_400
#: Keys of a list up to which they are broadcast.
BROADCAST_KEYS = 1 << 18


def host_of(url: Column) -> Column:
    """The lower-cased host without user, port or final dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """The path without query and fragment; / if there is none."""
    path = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def keys_of(url: Column, n_labels: int, n_folders: int) -> Column:
    """The list keys that a URL falls under: each suffix of its host, alone and with each directory of its path, of at
    most n_labels labels and n_folders folders. With the list's own extent() no key of the list is left out."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), n - (n_labels - 1)), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    parts = F.split(path, "/", -1)
    inner = F.size(parts) - 2
    deep = F.least(F.lit(n_folders), inner)
    folders = F.when(deep >= 1, F.transform(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i + 1), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    both = F.flatten(F.transform(suffixes, lambda s: F.concat(F.array(s), F.transform(folders, lambda f: F.concat(s, f)))))
    return F.when(host.isNotNull(), F.array_distinct(both))


def extent(events: DataFrame) -> tuple[int, int]:
    """The most labels of a host and the most folders among the keys that the list blocks at any time."""
    n_labels = F.size(F.split(F.substring_index("key", "/", 1), r"\.", -1))
    n_folders = F.size(F.split("key", "/", -1)) - 2
    most = events.where("key is not null and action = 'block'").agg(F.max(n_labels), F.max(n_folders)).first()
    return max(1, most[0] or 0), max(0, most[1] or 0)


def intervals(events: DataFrame) -> DataFrame:
    """(key, kind, since, until) during which a key is blocked; until is null for those that hold still.

    Of events of one key at one time 'allow' wins. Rows without key, time or action are left out.
    """
    at = F.col("at").cast("timestamp_ntz")
    kept = events.where("key is not null and at is not null and action in ('block', 'allow')").withColumn("at", at)
    one = kept.groupBy("key", "at").agg(F.min(F.struct((F.col("action") != "allow").alias("o"), F.coalesce("kind", F.lit("")).alias("kind"))).alias("e"))
    following = F.lead("at").over(Window.partitionBy("key").orderBy("at"))
    spans = one.select("key", F.col("e.kind").alias("kind"), F.col("e.o").alias("blocks"), F.col("at").alias("since"), following.alias("until"))
    return spans.where("blocks").drop("blocks")


def url_filter(captures: DataFrame, events: DataFrame, bucket_s: int = BUCKET_S) -> DataFrame:
    """captures with blocked, block_key, block_kind, block_since: the longest key that blocks it at its fetch time.

    captures has url and fetched_at besides any other columns; events is described above. A capture without a valid
    URL or fetch time is kept unblocked; of equally long keys the first by code point is named. An entry holds from its
    time on and ends where the next event of its key begins, that instant excluded. Rows that repeat are judged alike;
    empty tables give no row or no block. Columns of captures that have one of the new names are replaced.

    Intervals and captures meet by key and time bucket, an equi-join that Spark can split where a host is hot; an open
    interval is cut at the last fetch time. Each (capture, key) meets one interval at most. Keys of a URL are made up to
    the labels and folders of the longest key in the list, so every entry is looked up, however long.
    """
    new = ["blocked", "block_key", "block_kind", "block_since"]
    captures = captures.select(*[c for c in captures.columns if c.lower() not in new])
    url, at, hit = spare([*captures.columns, *new], "_url", "_at", "_hit")
    seconds = lambda c: F.unix_timestamp(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    bucket = lambda c: F.floor(seconds(c) / bucket_s)
    # the last and first fetch bound the buckets: one row, crossed in as literals
    ends = captures.agg(F.min(F.col("fetched_at").cast("timestamp_ntz")).alias("lo"), F.max(F.col("fetched_at").cast("timestamp_ntz")).alias("hi")).first()
    spans = intervals(events)
    lo, hi = F.lit(ends["lo"]).cast("timestamp_ntz"), F.lit(ends["hi"]).cast("timestamp_ntz")
    spans = spans.where((F.col("since") <= hi) & (F.col("until").isNull() | (F.col("until") > lo)))
    first, last = bucket(F.greatest("since", lo)), bucket(F.least(F.coalesce("until", hi), hi))
    spans = spans.withColumn("bucket", F.explode(F.sequence(first, last))).select(F.col("key").alias("_key"), "kind", "since", "until", F.col("bucket").alias("_bucket"))

    # one row a distinct (url, time): repeated captures are looked up once, and the answer is joined back by them
    asked = captures.select("url", F.col("fetched_at").cast("timestamp_ntz").alias("at")).where("url is not null and at is not null")
    # a repartitioning by number isn't coalesced, so the keys are made by all tasks
    asked = asked.repartition(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), "url", "at").distinct()
    asked = asked.withColumn("key", F.explode(keys_of(F.col("url"), *extent(events)))).withColumn("bucket", bucket(F.col("at")))
    asked = _listed(asked, spans)
    on = (F.col("key") == F.col("_key")) & (F.col("bucket") == F.col("_bucket")) & (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    best = F.min(F.struct((-F.length("key")).alias("n"), F.col("key"), F.col("kind"), F.col("since")))
    hits = asked.join(spans, on).groupBy("url", "at").agg(best.alias("_hit")).select(F.col("url").alias(url), F.col("at").alias(at), F.col("_hit").alias(hit))
    out = captures.join(hits, (F.col("url") == F.col(url)) & (F.col("fetched_at").cast("timestamp_ntz") == F.col(at)), "left")
    out = out.withColumns({"blocked": F.col(hit).isNotNull(), "block_key": F.col(f"{hit}.key"), "block_kind": F.col(f"{hit}.kind"), "block_since": F.col(f"{hit}.since")})
    return out.drop(url, at, hit)


def _listed(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """asked without rows whose key is in no entry, as far as that can be told without a shuffle by key: all of them if
    the list's keys can be broadcast, else those of the keys that are asked for most, such as the suffix `com`."""
    keys = spans.select(F.col("_key").alias("key")).distinct()
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        return asked.join(F.broadcast(keys), "key", "left_semi")
    counted = asked.groupBy("key").count()
    often = counted.where(F.col("count") > F.lit(2 * asked.count() // BROADCAST_KEYS)).select("key")  # fewer than BROADCAST_KEYS
    return asked.join(F.broadcast(often.join(keys, "key", "left_anti")), "key", "left_anti")


def page_captures(pages: DataFrame) -> DataFrame:
    """pages with fetched_at: the tables have no fetch times, so each page's is set by its id, over ten years."""
    minutes = F.pmod(F.pmod("page_id", F.lit(5_256_000)) * 7919, F.lit(5_256_000)).cast("long")
    return pages.select("page_id", "url", F.expr("timestamp_ntz '2014-01-01 00:00:00'").alias("_0"), minutes.alias("_m")).select(
        "page_id", "url", (F.col("_0") + F.make_interval(mins=F.col("_m").cast("int"))).alias("fetched_at")
    )


def page_events(pages: DataFrame) -> DataFrame:
    """A dated list for the pages' own hosts and folders: by the MD5 of a key it is blocked, freed, and blocked again."""
    host = host_of(F.col("url"))
    site = F.regexp_replace(host, r"^(?:www|m|blog)\.", "")
    folder = F.regexp_extract(F.col("url"), r"^[a-z]+://[^/?#]*(/[^/?#]*/)", 1)
    keys = pages.select(F.explode(F.array(host, site, F.when(folder != "", F.concat(host, folder)))).alias("key")).where("key is not null").distinct()
    crc = F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("long")
    day = lambda plus: F.make_interval(days=(crc % 3000 + plus).cast("int"))
    start = F.expr("timestamp_ntz '2014-01-01 00:00:00'")
    event = lambda plus, action: F.struct((start + day(plus)).alias("at"), F.lit(action).alias("action"))
    kind = F.when(crc % 2 == 0, F.lit("spam")).otherwise(F.lit("malware"))
    made = F.when(crc % 7 == 0, F.array(event(0, "block"), event(200, "allow"), event(400, "block"))).when(crc % 7 == 1, F.array(event(0, "block"), event(90, "allow")))
    return keys.select("key", kind.alias("kind"), F.explode(made).alias("e")).select("key", "kind", "e.at", "e.action")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter(page_captures(pages), page_events(pages))
    return out.select("page_id", "url", "fetched_at", "blocked", "block_key", "block_kind", "block_since")


SQL = r"""
WITH captures AS (
  SELECT page_id, url, TIMESTAMP '2014-01-01 00:00:00' + to_minutes(CAST(((page_id * 7919) % 5256000 + 5256000) % 5256000 AS BIGINT)) AS fetched_at,
    nullif(regexp_replace(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', ''), '') AS host,
    coalesce(nullif(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1), ''), '/') AS path,
    regexp_extract(url, '^[a-z]+://[^/?#]*(/[^/?#]*/)', 1) AS folder
  FROM pages
), list_keys AS (
  SELECT DISTINCT unnest([host, regexp_replace(host, '^(?:www|m|blog)\.', ''), CASE WHEN folder <> '' THEN host || folder END]) AS key FROM captures
), hashed AS (
  SELECT key, CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) AS h FROM list_keys WHERE key IS NOT NULL
), events AS (
  SELECT key, h, unnest(CASE WHEN h % 7 = 0 THEN [0, 200, 400] WHEN h % 7 = 1 THEN [0, 90] ELSE [] END) AS plus FROM hashed
), spans AS (
  SELECT key, CASE WHEN h % 2 = 0 THEN 'spam' ELSE 'malware' END AS kind, plus IN (0, 400) AS blocks,
    TIMESTAMP '2014-01-01 00:00:00' + to_days(CAST(h % 3000 + plus AS INTEGER)) AS since,
    lead(TIMESTAMP '2014-01-01 00:00:00' + to_days(CAST(h % 3000 + plus AS INTEGER))) OVER (PARTITION BY key ORDER BY plus) AS until
  FROM events
), cut AS (
  SELECT *, string_split(host, '.') AS labels, string_split(path, '/') AS parts FROM captures WHERE host IS NOT NULL
), suffixes AS (
  SELECT page_id, fetched_at, parts, unnest([array_to_string(labels[i:len(labels)], '.') FOR i IN range(1, len(labels) + 1)]) AS suffix FROM cut
), keys AS (
  SELECT DISTINCT page_id, fetched_at, unnest(list_concat([suffix], [suffix || array_to_string(parts[1:i + 1], '/') || '/' FOR i IN range(1, len(parts) - 1)])) AS key FROM suffixes
), hits AS (
  SELECT k.page_id, s.key, s.kind, s.since, row_number() OVER (PARTITION BY k.page_id ORDER BY length(s.key) DESC, s.key) AS r
  FROM keys k JOIN spans s ON k.key = s.key AND s.blocks AND s.since <= k.fetched_at AND (s.until IS NULL OR k.fetched_at < s.until)
)
SELECT c.page_id, c.url, c.fetched_at, h.key IS NOT NULL AS blocked, h.key AS block_key, h.kind AS block_kind, h.since AS block_since
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND h.r = 1
"""
