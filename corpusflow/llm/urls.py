"""URL filters: a temporal join of captures with dated list entries, in DataFrame operations only.

List entries are dated changes (key, list, action, at). Per key and list they become validity intervals, from an ``add``
to the next change. A key is a host, a parent domain of two or more labels (names only, not IPv4 addresses), or a host
with its first path segment. Every capture is evaluated as of its fetch time against the intervals of all its keys.

The join is made of equi-joins on (key, time bucket). In the first and the last bucket of an interval the times decide.
The buckets between are covered by nodes of a tree of buckets with ``2 ** FAN_BITS`` children each, so an interval that
is open for years stands in some dozen nodes, and a capture's bucket looks up one node a level. A busy host and a list
with many changes are spread over the buckets. The next change of a key and list is found within days, and from day to
day between their first changes. Repeated captures of one URL and time cost one evaluation.

Defined cases: a null or malformed URL has no keys and is never listed; a null fetch time neither; changes without key,
list or time are left out; of several changes of a key and list at one time a removal wins; repeated rows give repeated
results; empty tables give empty results or no listings; a very long URL is a URL; other columns pass, except those
named as a result (``host``, ``lists``, ``n_listings``, ``blocked``), which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written

BUCKET_S, DAY_S, CENTURY_S = 3600, 86_400, 3_155_760_000
FAN_BITS = 3
RESULT = ("host", "lists", "n_listings", "blocked")


def host(url: Column) -> Column:
    """Lower-case host without user, port and a final dot; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1)
    return F.nullif(found, F.lit(""))


def keys(url: Column) -> Column:
    """Array of the keys under which a URL may be listed: host, parent domains, host/first segment."""
    h = host(url)
    labels = F.split(h, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 2, F.lit(1))), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    parents = F.when((F.size(labels) > 2) & ~h.rlike(r"^[0-9]+(\.[0-9]+){3}$"), parents).otherwise(F.array().cast("array<string>"))
    segment = F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1), F.lit(""))
    return F.when(h.isNotNull(), F.concat(F.array(h), parents, F.when(segment.isNotNull(), F.array(F.concat_ws("/", h, segment))).otherwise(F.array().cast("array<string>"))))


def validity(entries: DataFrame) -> DataFrame:
    """(key, list, valid_from, valid_to): from dated changes; valid_to is null while the listing stands."""
    dated = entries.where("key is not null and list is not null and at is not null").withColumn("day", F.floor(F.col("at") / DAY_S))
    one = dated.groupBy("key", "list", "day", "at").agg(F.max("action").alias("action"))
    spans = one.withColumn("next", F.lead("at").over(W.partitionBy("key", "list", "day").orderBy("at")))  # seconds of a day at most
    days = one.groupBy("key", "list", "day").agg(F.min("at").alias("first"))
    later = days.withColumn("later", F.lead("first").over(W.partitionBy("key", "list").orderBy("day"))).drop("first")  # days at most
    whole = spans.where("action = 'add'").join(later, ["key", "list", "day"])
    return whole.select("key", "list", F.col("at").alias("valid_from"), F.coalesce("next", "later").alias("valid_to"))


def levels(bucket_s: int) -> int:
    """Levels of the tree of buckets: the nodes of one more would be longer than a century."""
    n = 1
    while bucket_s << (FAN_BITS * n) < CENTURY_S:
        n += 1
    return n


def cover(start: Column, end: Column, n_levels: int) -> Column:
    """Array of (level, node): the fewest nodes of the tree that hold the buckets from ``start`` up to ``end``, exclusive."""
    low = lambda n: -F.shiftright(-start, FAN_BITS * n)
    high = lambda n: F.shiftright(end, FAN_BITS * n)

    def nodes(n: int, a: Column, b: Column) -> Column:
        numbers = F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(numbers, lambda i: F.struct(F.lit(n).alias("level"), i.alias("node")))

    parts = []
    for n in range(n_levels):
        if n + 1 == n_levels:
            parts.append(nodes(n, low(n), high(n)))
            continue
        above = low(n + 1) < high(n + 1)  # the level above holds the middle
        parts.append(nodes(n, low(n), F.when(above, F.shiftleft(low(n + 1), FAN_BITS)).otherwise(high(n))))
        parts.append(nodes(n, F.when(above, F.shiftleft(high(n + 1), FAN_BITS)).otherwise(high(n)), high(n)))
    return F.flatten(F.array(*parts))


def as_of(visits: DataFrame, intervals: DataFrame, bucket_s: int = BUCKET_S) -> DataFrame:
    """(visit, list) of every active listing of the visits (visit, url, fetched)."""
    last = visits.agg(F.max("fetched").alias("last")).first()["last"]
    until = F.lit(last + 1 if last is not None else -(1 << 62)).cast("long")
    spans = intervals.where(F.col("valid_from") < until).withColumn("end", F.least(F.coalesce("valid_to", until), until))
    spans = spans.withColumns({"a": F.floor(F.col("valid_from") / bucket_s), "b": F.floor((F.col("end") - 1) / bucket_s)})
    asked = written(visits.select("visit", "fetched", F.floor(F.col("fetched") / bucket_s).alias("bucket"), F.explode(keys(F.col("url"))).alias("key")), "asked")
    edges = spans.withColumn("bucket", F.explode(F.array_distinct(F.array("a", "b"))))
    inside = (F.col("fetched") >= F.col("valid_from")) & (F.col("fetched") < F.col("end"))
    at_edges = asked.join(edges, ["key", "bucket"]).where(inside).select("visit", "list")

    n = levels(bucket_s)
    nodes = spans.where("b - a > 1").select("key", "list", F.explode(cover(F.col("a") + 1, F.col("b"), n)).alias("n")).select("key", "list", "n.level", "n.node")
    up = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("bucket", FAN_BITS * k).alias("node")) for k in range(n)))
    slots = asked.select("key", "bucket").distinct().select("key", "bucket", F.explode(up).alias("n")).select("key", "bucket", "n.level", "n.node")
    full = slots.join(nodes, ["key", "level", "node"]).select("key", "bucket", "list")
    return at_edges.union(asked.join(full, ["key", "bucket"]).select("visit", "list"))


def url_verdicts(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_s", bucket_s: int = BUCKET_S) -> DataFrame:
    """The captures with all their columns, and host, lists (sorted, comma-joined), n_listings and blocked."""
    rows = captures.select(F.struct("*").alias("row"), F.col(url_col).alias("url"), F.col(time_col).cast("long").alias("fetched"))
    there = rows.select("url", "fetched").where(host(F.col("url")).isNotNull() & F.col("fetched").isNotNull()).distinct()
    visits = written(there.withColumn("visit", F.monotonically_increasing_id()), "visits")
    found = as_of(visits, written(validity(entries), "intervals"), bucket_s)
    lists = found.groupBy("visit").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.count("*").alias("n"))
    # Written, so that the join deals both sides anew and a much repeated capture can be split over tasks.
    listed = written(visits.join(lists, "visit").select(F.col("url").alias("u"), F.col("fetched").alias("t"), "lists", "n"), "listed")
    joined = rows.join(listed, (rows["url"] == listed["u"]) & (rows["fetched"] == listed["t"]), "left")
    passed = [F.col("row")[c].alias(c) for c in captures.columns if c not in RESULT]
    return joined.select(*passed, host(F.col("url")).alias("host"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("n", F.lit(0)).alias("n_listings"), F.col("n").isNotNull().alias("blocked"))


#: The test tables have no fetch times: captures are spread over the 30 days of ``events`` by their id.
FIRST_S, DAYS, STRIDE = 1_704_067_200, 30, 7919
LISTS, SEGMENTS = ("ads", "malware", "spam"), ("en", "de", "fr", "es")


def captures_of(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", (F.lit(FIRST_S) + F.pmod(F.col("page_id") * STRIDE, F.lit(DAYS * 86_400))).alias("fetched_s"))


def entries_of(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Dated changes: each error, signup or purchase event changes the listing of a key made from the host of the page
    whose id is its user id, modulo the number of pages."""
    n = pages.agg((F.max("page_id") + 1).alias("n")).first()["n"] or 1
    hosts = pages.select(F.col("page_id").alias("_page"), host(F.col("url")).alias("host")).where("host is not null")
    changes = events.where(F.col("event_type").isin("error", "signup", "purchase")).withColumn("_page", F.pmod("user_id", F.lit(n)))
    scope = F.col("event_id") % 8
    key = F.when(scope == 0, F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).when(scope < 4, F.concat_ws("/", "host", F.element_at(F.array(*map(F.lit, SEGMENTS)), (F.col("user_id") % 4 + 1).cast("int")))).otherwise(F.col("host"))
    return changes.join(hosts, "_page").select(
        key.alias("key"), F.element_at(F.array(*map(F.lit, LISTS)), (F.col("user_id") % 3 + 1).cast("int")).alias("list"),
        F.when(F.col("event_type") == "error", "add").otherwise("remove").alias("action"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"),
    )


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, url, 1704067200 + (page_id * 7919) % 2592000 AS fetched_s,
                  nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1), '') AS host,
                  nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1), '') AS seg FROM pages),
c AS (SELECT CASE WHEN event_id % 8 = 0 THEN regexp_extract(host, '([^.]+\.[^.]+)$', 1)
                  WHEN event_id % 8 < 4 THEN host || '/' || (['en', 'de', 'fr', 'es'])[(user_id % 4 + 1)::INTEGER] ELSE host END AS key,
             (['ads', 'malware', 'spam'])[(user_id % 3 + 1)::INTEGER] AS list,
             CASE WHEN event_type = 'error' THEN 'add' ELSE 'remove' END AS action, epoch_us(ts) // 1000000 AS changed
      FROM events JOIN p ON user_id % (SELECT max(page_id) + 1 FROM pages) = p.page_id WHERE p.host IS NOT NULL AND event_type IN ('error', 'signup', 'purchase')),
o AS (SELECT key, list, changed, max(action) AS action FROM c GROUP BY ALL),
v AS (SELECT * FROM (SELECT *, lead(changed) OVER (PARTITION BY key, list ORDER BY changed) AS until FROM o) WHERE action = 'add'),
k AS (SELECT DISTINCT url, fetched_s, host AS key FROM p WHERE host IS NOT NULL
      UNION ALL SELECT DISTINCT url, fetched_s, array_to_string(string_split(host, '.')[i + 1:], '.')
                FROM (SELECT url, fetched_s, host, unnest(range(1, len(string_split(host, '.')) - 1)) AS i FROM p WHERE host IS NOT NULL AND NOT regexp_matches(host, '^[0-9]+([.][0-9]+){3}$'))
      UNION ALL SELECT DISTINCT url, fetched_s, host || '/' || seg FROM p WHERE host IS NOT NULL AND seg IS NOT NULL),
f AS (SELECT url, fetched_s, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists, count(*) AS n
      FROM k JOIN v ON k.key = v.key AND fetched_s >= v.changed AND (v.until IS NULL OR fetched_s < v.until) GROUP BY ALL)
SELECT p.page_id, p.url, p.fetched_s, p.host, coalesce(f.lists, '') AS lists, coalesce(f.n, 0)::BIGINT AS n_listings, f.n IS NOT NULL AS blocked
FROM p LEFT JOIN f ON p.url = f.url AND p.fetched_s = f.fetched_s
"""
