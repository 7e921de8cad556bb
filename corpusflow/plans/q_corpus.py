"""Queries on the corpus as a whole: aggregates, completeness, health, gate."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import text as T
from ..operators import chunks as K
from ..operators import matching as X
from ..operators import records as R
from . import gate, health
from .registry import query, table


@query("""SELECT o_orderstatus, count(*) AS total, count(*) FILTER (o_totalprice > 0) AS ok, count(*) FILTER (NOT o_totalprice > 0) AS failed, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (o_totalprice > 0) / count(*) * 100 END, 4) AS success_rate, round(avg(n), 4) AS lines_each
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""")
def stage_summary(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    good = F.col("o_totalprice") > 0
    rows = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("total"), F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"), F.round(F.count_if(good) / F.count("*") * 100, 4).alias("success_rate"), F.round(F.avg("n"), 4).alias("lines_each"))


@query("SELECT l_suppkey, l_returnflag, total, round(total / whole * 100, 4) AS share FROM (SELECT *, sum(total) OVER (PARTITION BY l_suppkey) AS whole FROM (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS total FROM lineitem GROUP BY ALL)) WHERE whole > 0")
def group_shares(spark, d):
    return R.shares(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", "l_quantity")


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value, round(avg(CASE WHEN value > 50 THEN value END), 4) AS mean_large FROM events GROUP BY 1")
def type_distribution(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.avg(F.when(F.col("value") > 50, F.col("value"))), 4).alias("mean_large"))


@query("SELECT o_custkey, round(list_reduce(list(o_totalprice ORDER BY o_orderdate, o_orderkey), lambda a, x: (a + x) / 2) + 0.0000001, 4) AS running, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1")
def running_averages(spark, d):
    """(average so far + value) / 2 in order, and the true mean beside it.

    The recurrence weighs the k-th value from the end by 2**-k, so it is a weighted sum: no customer's orders are collected."""
    recent = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    rows = table(spark, d, "orders").withColumn("k", F.row_number().over(recent)).withColumn("n", F.count("*").over(W.partitionBy("o_custkey")))
    weight = F.pow(F.lit(0.5), F.when(F.col("k") == F.col("n"), F.col("n") - 1).otherwise(F.col("k")))
    return rows.groupBy("o_custkey").agg(F.round(F.sum(F.col("o_totalprice") * weight) + 1e-7, 4).alias("running"), F.round(F.avg("o_totalprice"), 6).alias("mean"))


@query("SELECT source, arg_min(lang, doc_id) AS first_lang, count(*) AS chunks, count(DISTINCT lang) AS types, CASE WHEN count(*) >= 5 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS efficiency FROM documents GROUP BY 1")
def entity_rollup(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.min_by("lang", "doc_id").alias("first_lang"), F.count("*").alias("chunks"), F.count_distinct("lang").alias("types"), C.ladder(F.count("*"), ((5, "high"), (3, "medium")), "low").alias("efficiency"))


def _profiles(spark, d):
    """Customers with some fields missing."""
    c = table(spark, d, "customer")
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").cast("string").alias("last_order"), F.max(F.when(F.col("o_totalprice") > 300_000, F.lit("yes"))).alias("large_order"))
    return c.select("c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")).otherwise(T.SENTINEL).alias("balance")).join(last, "c_custkey", "left")


_PROFILES = """o AS (SELECT o_custkey, max(o_orderdate) AS last_order, max(CASE WHEN o_totalprice > 300000 THEN 'yes' END) AS large_order FROM orders GROUP BY 1),
p AS (SELECT c_custkey, c_name IS NOT NULL AS c_name, c_mktsegment IS NOT NULL AS c_mktsegment, c_acctbal > 0 AS balance, last_order IS NOT NULL AS last_order, large_order IS NOT NULL AS large_order FROM customer LEFT JOIN o ON o_custkey = c_custkey)"""
CATEGORIES = {"basic": ("c_name", "c_mktsegment"), "money": ("balance", "large_order"), "activity": ("last_order",)}


@query(f"""WITH {_PROFILES}, u AS (UNPIVOT p ON COLUMNS(* EXCLUDE (c_custkey)) INTO NAME field VALUE there), k AS (SELECT *, CASE WHEN field IN ('c_name', 'c_mktsegment') THEN 'basic' WHEN field = 'last_order' THEN 'activity' ELSE 'money' END AS category FROM u)
SELECT c_custkey, category, count(*) FILTER (there) AS available, count(*) AS required, round(count(*) FILTER (there) / count(*) * 100, 1) AS coverage, coalesce(string_agg(field, ',' ORDER BY field) FILTER (NOT there), '') AS missing FROM k GROUP BY ALL""")
def category_coverage(spark, d):
    return R.coverage(_profiles(spark, d), "c_custkey", CATEGORIES)


_SUM = "(c_name::INTEGER + c_mktsegment::INTEGER + balance::INTEGER + last_order::INTEGER + large_order::INTEGER)"


@query(f"WITH {_PROFILES} SELECT c_custkey, round({_SUM} / 5 * 100, 4) AS completeness, least(100, 30 * (c_name::INTEGER + c_mktsegment::INTEGER) + 15 * (balance::INTEGER + large_order::INTEGER) + 5 * last_order::INTEGER)::DOUBLE AS weighted FROM p")
def completeness_scores(spark, d):
    p = _profiles(spark, d)
    tiers = ((30, (F.col("c_name"), F.col("c_mktsegment"))), (15, (F.col("balance"), F.col("large_order"))), (5, (F.col("last_order"),)))
    plain = R.completeness(p, "c_custkey", tuple(f for fs in CATEGORIES.values() for f in fs))
    return plain.join(p.select("c_custkey", R.weighted_completeness(tiers).alias("weighted")), "c_custkey")


@query(f"WITH {_PROFILES}, s AS (SELECT {_SUM} / 5 * 100 AS c FROM p) SELECT round(avg(c), 4) AS score, count(*) FILTER (c < 80) AS incomplete, CASE WHEN count(*) FILTER (c < 80) = 0 AND avg(c) >= 90 THEN 'passed' ELSE 'needs_improvement' END AS status FROM s")
def corpus_completeness(spark, d):
    c = R.completeness(_profiles(spark, d), "c_custkey", tuple(f for fs in CATEGORIES.values() for f in fs))
    low = F.count_if(F.col("completeness") < 80)
    return c.agg(F.round(F.avg("completeness"), 4).alias("score"), low.alias("incomplete"), F.when((low == 0) & (F.avg("completeness") >= 90), "passed").otherwise("needs_improvement").alias("status"))


@query(f"WITH {_PROFILES}, u AS (UNPIVOT p ON COLUMNS(* EXCLUDE (c_custkey)) INTO NAME field VALUE there), a AS (SELECT field, round(avg(there::INTEGER) * 100, 4) AS availability FROM u GROUP BY 1) SELECT field, availability, CASE WHEN availability < 95 THEN 'high' ELSE 'medium' END AS severity, CASE field WHEN 'large_order' THEN 'Cannot answer questions on large orders' ELSE 'May affect query responses' END AS impact FROM a WHERE availability < 99")
def field_gaps(spark, d):
    gaps = R.field_gaps(_profiles(spark, d), "c_custkey", tuple(f for fs in CATEGORIES.values() for f in fs), 99, 95)
    return gaps.withColumn("impact", K.lookup({"large_order": "Cannot answer questions on large orders"}, F.col("field"), "May affect query responses"))


@query("SELECT text, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark, d):
    return R.duplicates(table(spark, d, "documents"), "doc_id", "text")


_CONSISTENCY = """SELECT (SELECT count(*) FROM (SELECT url FROM pages GROUP BY url HAVING count(*) > 1)) AS duplicates, (SELECT count(DISTINCT lang) FROM documents) AS categories, (SELECT count(*) FROM pages WHERE url IS NULL OR trim(url) = '' OR html IS NULL) AS malformed"""


@query(f"SELECT *, round(((duplicates = 0)::INTEGER + (categories >= 3)::INTEGER + (malformed = 0)::INTEGER) / 3 * 100, 4) AS score FROM ({_CONSISTENCY})")
def consistency(spark, d):
    pages, docs = table(spark, d, "pages"), table(spark, d, "documents")
    one = pages.groupBy("url").count().agg(F.count_if(F.col("count") > 1).alias("duplicates"))
    two = docs.agg(F.count_distinct("lang").alias("categories"))
    three = pages.agg(F.count_if(F.col("url").isNull() | (F.trim("url") == "") | F.col("html").isNull()).alias("malformed"))
    row = gate.side_by_side(one, two, three)
    good = (F.col("duplicates") == 0).cast("int") + (F.col("categories") >= 3).cast("int") + (F.col("malformed") == 0).cast("int")
    return row.withColumn("score", F.round(good / 3 * 100, 4))


@query("""WITH s AS (SELECT count(*) AS documents, least(100, count(*) / (count(DISTINCT source) * 15) * 100) AS coverage, round(avg((text IS NOT NULL AND source IS NOT NULL)::INTEGER) * 100, 4) AS integrity FROM documents),
f AS (SELECT CASE WHEN a <= 1 THEN 'fresh' WHEN a <= 7 THEN 'recent' ELSE 'stale' END AS freshness FROM (SELECT floor((epoch(TIMESTAMP '1998-08-02') - epoch(max(o_orderdate))) / 86400) AS a FROM orders))
SELECT documents, CASE WHEN documents > 0 THEN 'healthy' ELSE 'empty' END AS health, freshness, round(coverage, 1) AS coverage, integrity, round(coverage * 0.4 + 85 * 0.3 + integrity * 0.3, 4) AS accuracy, round(CASE freshness WHEN 'fresh' THEN 100 WHEN 'recent' THEN 80 ELSE 40 END * 0.4 + round(coverage, 1) * 0.6, 4) AS quality,
 CASE WHEN coverage >= 90 THEN 'excellent' WHEN coverage >= 70 THEN 'good' ELSE 'needs_improvement' END AS status, coverage >= 90 AND integrity >= 95 AS ready FROM s, f""")
def health_card(spark, d):
    docs = table(spark, d, "documents").agg(
        F.count("*").alias("documents"), F.least(F.lit(100.0), F.count("*") / (F.count_distinct("source") * 15) * 100).alias("raw"),
        F.round(F.avg((F.col("text").isNotNull() & F.col("source").isNotNull()).cast("int")) * 100, 4).alias("integrity"),
    )
    last = table(spark, d, "orders").agg(F.max("o_orderdate").cast("timestamp").alias("at"))
    fresh = last.select(C.freshness(F.to_timestamp(F.lit("1998-08-02")), F.col("at"), ("fresh", "recent", "stale"), (1, 7)).alias("freshness"))
    row = gate.side_by_side(docs, fresh)
    points = K.lookup({"fresh": 100, "recent": 80, "stale": 40, "unknown": 20}, F.col("freshness"), 0)
    return row.select(
        "documents", F.when(F.col("documents") > 0, "healthy").otherwise("empty").alias("health"), "freshness", F.round("raw", 1).alias("coverage"), "integrity",
        F.round(F.col("raw") * 0.4 + 85 * 0.3 + F.col("integrity") * 0.3, 4).alias("accuracy"), F.round(points * 0.4 + F.round("raw", 1) * 0.6, 4).alias("quality"),
        C.ladder(F.col("raw"), ((90, "excellent"), (70, "good")), "needs_improvement").alias("status"), ((F.col("raw") >= 90) & (F.col("integrity") >= 95)).alias("ready"),
    )


_TERMS = ("the", "and", "der", "que", "les")


@query("""WITH w AS (SELECT len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS n, contains(lower(text), 'the')::INTEGER + contains(lower(text), 'and')::INTEGER + contains(lower(text), 'der')::INTEGER + contains(lower(text), 'que')::INTEGER + contains(lower(text), 'les')::INTEGER AS t, source FROM documents)
SELECT source, CASE WHEN avg(n) > 50 THEN 80 ELSE 60 END::DOUBLE AS text_coverage, round(avg(CASE WHEN n > 0 THEN t / n * 100 ELSE 0 END), 6) AS density, round(100 * 0.3 + 85 * 0.3 + CASE WHEN avg(n) > 50 THEN 80 ELSE 60 END * 0.2 + avg(CASE WHEN n > 0 THEN t / n * 100 ELSE 0 END) * 0.2, 4) AS overall FROM w GROUP BY 1""")
def text_quality(spark, d):
    n = F.size(T.words(F.col("text")))
    hits = sum((F.contains(F.lower("text"), F.lit(t)).cast("int") for t in _TERMS), F.lit(0))
    rows = table(spark, d, "documents").select("source", n.alias("n"), hits.alias("t"))
    cover, density = F.when(F.avg("n") > 50, 80.0).otherwise(60.0), F.avg(F.when(F.col("n") > 0, F.col("t") / F.col("n") * 100).otherwise(0.0))
    return rows.groupBy("source").agg(cover.alias("text_coverage"), F.round(density, 6).alias("density"), F.round(100 * 0.3 + 85 * 0.3 + cover * 0.2 + density * 0.2, 4).alias("overall"))


@query("SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def missing_entities(spark, d):
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    found = table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"))
    return R.missing_from(nations, found, "n_nationkey").select("n_name")


@query("SELECT t AS name FROM (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS t FROM part UNION SELECT DISTINCT lower(p_name) FROM part UNION SELECT DISTINCT lower(substr(p_brand, 7, 2)) FROM part UNION SELECT 'ee') WHERE NOT EXISTS (SELECT 1 FROM part p WHERE contains(lower(p.p_type), t))")
def missing_by_substring(spark, d):
    p = table(spark, d, "part")
    names = p.select(F.lower(F.element_at(F.split("p_name", " "), 1)).alias("name")).union(p.select(F.lower("p_name").alias("name"))).union(p.select(F.lower(F.substring("p_brand", 7, 2)).alias("name")))
    names = names.union(p.select(F.lit("ee").alias("name"))).distinct()
    return X.missing_by_substring(names, p.select("p_type").distinct(), "name", "p_type")


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 90 WHEN 'Brand#22' THEN 85 ELSE 50 END * CASE WHEN p_size > 25 THEN 1.0 ELSE 0.6 END AS relevance FROM part")
def lookup_join(spark, d):
    base = K.lookup({"Brand#11": 90.0, "Brand#22": 85.0}, F.col("p_brand"), 50.0)
    return table(spark, d, "part").select("p_partkey", (base * F.when(F.col("p_size") > 25, 1.0).otherwise(0.6)).alias("relevance"))


@query("""SELECT source, CASE WHEN n < 45 AND c < 3 THEN 'Add documents; Add languages' WHEN n < 45 THEN 'Add documents' WHEN c < 3 THEN 'Add languages' ELSE 'Nothing to do' END AS advice, n >= 45 AND c >= 3 AS ready FROM (SELECT source, count(*) AS n, count(DISTINCT lang) AS c FROM documents GROUP BY 1)""")
def recommendations(spark, d):
    s = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("c"))
    rules = ((F.col("n") < 45, F.lit("Add documents")), (F.col("c") < 3, F.lit("Add languages")))
    return s.select("source", C.recommendations(rules, "Nothing to do").alias("advice"), ((F.col("n") >= 45) & (F.col("c") >= 3)).alias("ready"))


@query("""SELECT doc_id, unnest(list_filter([CASE WHEN quality IS NULL THEN 'no label' END, CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)) AS issue FROM documents LEFT JOIN labels USING (doc_id)""")
def quality_issues(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    found = F.array_compact(F.array(F.when(F.col("quality").isNull(), "no label"), F.when(F.col("n_chars") < 200, "short"), F.when(F.col("toxic") == 1, "toxic")))
    return rows.select("doc_id", F.explode(found).alias("issue"))


@query("""WITH c AS (SELECT count(*) AS docs, round(avg((text IS NOT NULL)::INTEGER) * 100, 4) AS complete FROM documents), q AS (SELECT round(avg(quality) * 100, 4) AS quality FROM labels), s AS (SELECT round(avg((o_totalprice > 0)::INTEGER) * 100, 4) AS rate FROM orders)
SELECT * FROM (SELECT 'stage_orders' AS name, rate AS measured, 80.0::DOUBLE AS least FROM s UNION ALL SELECT 'document_count', docs::DOUBLE, 10 FROM c UNION ALL SELECT 'completeness', complete, 70 FROM c UNION ALL SELECT 'quality', quality, 99 FROM q), (SELECT true) t(x)
""".replace("SELECT * FROM (", "SELECT name, measured, least, measured >= least AS passed, CASE WHEN measured < least THEN name || ' is below ' || least::INTEGER END AS error FROM ("))
def gate_checks(spark, d):
    docs, labels, orders = table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "orders")
    measures = gate.side_by_side(
        orders.agg(F.round(F.avg((F.col("o_totalprice") > 0).cast("int")) * 100, 4).alias("stage_orders")),
        docs.agg(F.count("*").cast("double").alias("document_count"), F.round(F.avg(F.col("text").isNotNull().cast("int")) * 100, 4).alias("completeness")),
        labels.agg(F.round(F.avg("quality") * 100, 4).alias("quality")),
    )
    return gate.checks(measures, {"stage_orders": 80, "document_count": 10, "completeness": 70, "quality": 99})


@query("""SELECT source, count(*) AS documents, round(avg((coalesce(trim(text), '') <> '' AND coalesce(trim(source), '') <> '')::INT) * 100, 4) AS integrity, count(DISTINCT lang)::INTEGER AS types, round(avg(n_chars), 4) AS completeness, true AS near
FROM documents GROUP BY source""")
def merged_states(spark, d):
    """Health by source, merged from states of the documents by language; the sketch is within 5 % of the distinct texts."""
    docs = table(spark, d, "documents")
    none = F.lit(None).cast("string")
    parts = docs.groupBy("source", "lang").agg(*(c.alias(n) for n, c in health.state(F.col("text"), F.col("source"), F.col("lang"), none, F.col("n_chars"), F.lit(0.0)).items()))
    whole = health.merged(parts.withColumnRenamed("lang", "of"), "source")
    exact = docs.groupBy("source").agg(F.count_distinct(F.md5(F.coalesce("text", F.lit("")))).alias("exact"))
    near = F.abs(F.hll_sketch_estimate("contents") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.05 * F.col("exact"))
    return whole.join(exact, "source").select(
        "source", "documents", F.round(F.col("complete") / F.col("documents") * 100, 4).alias("integrity"), F.size("categories").alias("types"), F.round(F.col("completeness") / F.col("documents"), 4).alias("completeness"), near.alias("near")
    )
