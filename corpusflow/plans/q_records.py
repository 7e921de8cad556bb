"""Queries on records: upserts, rendering, extraction, checks, chunks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import extract as E
from ..functions import text as T
from ..operators import chunks as K
from ..operators import records as R
from .registry import query, spread, table



def as_of():
    return F.to_timestamp(F.lit("1998-08-02 00:00:00"))


@query("""WITH l AS (SELECT l_orderkey AS id, max({'a': l_shipdate, 'b': l_linenumber, 'c': l_extendedprice}).c AS price FROM lineitem GROUP BY ALL)
SELECT coalesce(l.id, o.o_orderkey) AS id, CASE WHEN l.id IS NULL THEN o.o_totalprice ELSE l.price END AS price FROM orders o FULL JOIN l ON l.id = o.o_orderkey""")
def upsert_by_key(spark, d):
    lines = table(spark, d, "lineitem")
    delta = lines.select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("price"), F.struct("l_shipdate", "l_linenumber", "l_extendedprice").alias("seq"))
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.lit(None).cast(delta.schema["seq"].dataType).alias("seq"))
    return R.upsert(base, delta, "id", "seq").select("id", "price")


@query("SELECT p_partkey, lower(replace(p_brand, ' ', '_')) || '_' || (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) AS id FROM part")
def slug_ids(spark, d):
    place = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1
    return table(spark, d, "part").select("p_partkey", R.slug(F.col("p_brand"), place).alias("id"))


@query("""SELECT p_partkey, concat_ws(' | ', 'Name: ' || p_name, 'Type: ' || p_type, CASE WHEN p_size > 25 THEN 'Content: ' || p_brand END) AS document,
  CASE WHEN p_name IS NOT NULL THEN 'Name: ' || p_name || ' | Type: metric | ' || p_brand ELSE p_brand END AS embedded FROM part""")
def stored_documents(spark, d):
    body = F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(" ")
    embedded = F.when(F.col("p_name").isNotNull(), F.concat(F.lit("Name: "), "p_name", F.lit(" | Type: metric | "), "p_brand")).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", R.stored_text((("Name", F.col("p_name")), ("Type", F.col("p_type")), ("Content", body))).alias("document"), embedded.alias("embedded"))


@query("SELECT regexp_extract(url, '://([^/]+)', 1) AS site, count(*) AS pages, count(DISTINCT url) AS urls FROM pages GROUP BY ALL")
def source_listing(spark, d):
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", "://([^/]+)", 1).alias("site")).agg(F.count("*").alias("pages"), F.count_distinct("url").alias("urls"))


_ROUTED = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',')"


@query(f"""SELECT p_partkey, {_ROUTED.format("'p_name=' || p_name, CASE WHEN p_type <> 'N/A' THEN 'p_type=' || p_type END")} AS primary_info, {_ROUTED.format("'p_size=' || p_size")} AS metric FROM part""")
def column_routing(spark, d):
    groups = R.routed({"primary_info": ("p_name", "p_type"), "metric": ("p_size",)})
    shown = {g: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",") for g, m in groups.items()}
    return table(spark, d, "part").select("p_partkey", *(c.alias(g) for g, c in shown.items()))


@query("""WITH a AS (SELECT l_partkey AS k, round(avg(l_extendedprice / l_quantity) + 0.000000001, 4) AS price FROM lineitem WHERE l_discount > 0.09 GROUP BY 1)
SELECT p_partkey, p_name, coalesce(a.price, round(p_retailprice, 4)) AS price FROM part LEFT JOIN a ON a.k = p_partkey""")
def overlay_merge(spark, d):
    found = table(spark, d, "lineitem").where("l_discount > 0.09").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")) + 1e-9, 4).alias("price"))
    parts = table(spark, d, "part").select("p_partkey", "p_name", F.round("p_retailprice", 4).alias("price"))
    return R.overlay(parts, found, "p_partkey", ("price",))


def record_text(spark, d):
    """Each part as labelled lines, some fields missing."""
    p = spread(table(spark, d, "part"), "p_partkey")
    ratio = F.concat((F.col("p_size") % 3).cast("string"), F.lit("."), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("%"))
    nav = F.concat(F.lit("₹"), F.col("p_partkey").cast("string"), F.lit(".5"))
    load = F.when(F.col("p_size") % 4 == 0, "Nil").when(F.col("p_size") % 4 == 1, F.concat((F.col("p_size") % 7).cast("string"), F.lit("%"))).otherwise(T.SENTINEL)
    risk = F.element_at(F.array(*map(F.lit, E.RISK_LEVELS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    sip = F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("₹"), F.format_number(F.col("p_size") * 100, 0)))
    back = F.concat(F.lit("1Y +"), F.col("p_size").cast("string"), F.lit(".5 % and -3.2% 3Y"))
    lines = (("Name", F.col("p_name")), ("NAV", nav), ("Expense Ratio", ratio), ("Exit Load", load), ("Minimum SIP", sip), ("Riskometer", risk), ("Returns", back))
    return p.select("p_partkey", R.labelled_text(lines).alias("text"))


_EXTRACTED = """SELECT p_partkey, '₹' || p_partkey || '.5' AS nav, (p_size % 3) || '.' || lpad(p_size::VARCHAR, 2, '0') || '%' AS expense_ratio,
  CASE WHEN p_size % 5 <> 0 THEN '₹' || p_size * 100 END AS min_sip, CASE p_size % 4 WHEN 0 THEN 'Nil' WHEN 1 THEN (p_size % 7) || '%' END AS exit_load,
  (['Very High', 'Moderately High', 'Moderately Low', 'Moderate', 'High', 'Low'])[(p_partkey % 6 + 1)::INTEGER] AS riskometer, p_size || '.5%' AS return_1y, '-3.2%' AS return_3y FROM part"""


@query(f"""WITH e AS ({_EXTRACTED}) SELECT *, round((5 + (min_sip IS NOT NULL)::INTEGER + (exit_load IS NOT NULL)::INTEGER) / 11 * 100, 1) AS extraction_confidence FROM e""")
def page_extraction(spark, d):
    fields = E.parsed_page(F.col("text"))
    wanted = ("nav", "expense_ratio", "min_sip", "exit_load", "riskometer", "return_1y", "return_3y", "extraction_confidence")
    return record_text(spark, d).select("p_partkey", *(fields[f].alias(f) for f in wanted))


@query(f"""WITH e AS ({_EXTRACTED}), u AS (UNPIVOT (SELECT p_partkey, nav, expense_ratio, min_sip, exit_load, riskometer, return_1y, return_3y FROM e) ON COLUMNS(* EXCLUDE (p_partkey)) INTO NAME field VALUE v)
SELECT field, count(*) AS extracted, round(count(*) / (SELECT count(*) FROM part) * 100, 4) AS rate FROM u GROUP BY field""")
def extraction_counts(spark, d):
    rows = page_extraction(spark, d).drop("extraction_confidence")
    fields = tuple(c for c in rows.columns if c != "p_partkey")
    return R.unpivoted(rows, "p_partkey", fields).groupBy("field").agg(F.count("value").alias("extracted"), F.round(F.count("value") / F.count("*") * 100, 4).alias("rate"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'Steel' WHEN contains(lower(p_type), 'brass') THEN 'Brass' ELSE 'Other' END AS material,
  regexp_extract(p_type || ' 12.5 % of ₹1,250.75', '(\\d+\\.?\\d*)\\s*%', 1) AS percent, replace(regexp_extract('₹1,250.75 ' || p_type, '₹\\s*([\\d,]+\\.?\\d*)', 1), ',', '') AS amount FROM part""")
def inferred_labels(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.coalesce(E.inferred(F.col("p_type"), (("steel", "Steel"), ("brass", "Brass"))), F.lit("Other")).alias("material"),
        E.percent_in(F.concat("p_type", F.lit(" 12.5 % of ₹1,250.75"))).alias("percent"), E.currency_in(F.concat(F.lit("₹1,250.75 "), "p_type")).alias("amount"),
    )


@query("""SELECT doc_id, concat_ws(',', CASE WHEN n_words < 30 THEN 'body' END, CASE WHEN quality IS NULL THEN 'quality' END) AS missing
FROM (SELECT d.doc_id, l.quality, len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS n_words FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def required_fields(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = docs.select("doc_id", F.when(F.size(T.words(F.col("text"))) >= 30, "there").alias("body"), "quality")
    return R.rejects(rows, ("body", "quality")).select("doc_id", "missing")


@query("""SELECT c_custkey, c_name FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey
WHERE m IS NULL OR floor((epoch(TIMESTAMP '1998-08-02') - epoch(m)) / 86400) > 30""")
def refresh_needed(spark, d):
    seen = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").cast("timestamp").alias("last_updated"))
    return R.needs_refresh(table(spark, d, "customer").select("c_custkey", "c_name"), seen, "c_custkey", as_of(), 30).select("c_custkey", "c_name")


@query("""SELECT o_orderkey, CASE WHEN age <= 1 THEN 'fresh' WHEN age <= 7 THEN 'recent' WHEN age <= 30 THEN 'acceptable' ELSE 'stale' END AS freshness,
  CASE WHEN o_totalprice >= 200000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'low' END AS size FROM (SELECT *, floor((epoch(TIMESTAMP '1998-08-02') - epoch(o_orderdate)) / 86400) AS age FROM orders)""")
def freshness_ladder(spark, d):
    price = C.ladder(F.col("o_totalprice"), ((200_000, "high"), (100_000, "medium")), "low")
    return table(spark, d, "orders").select("o_orderkey", C.freshness(as_of(), F.col("o_orderdate").cast("timestamp")).alias("freshness"), price.alias("size"))


# Checks

_PERCENT = "CASE WHEN NOT regexp_matches(v, '^\\d+\\.?\\d*%?$') THEN 0 WHEN TRY_CAST(regexp_extract(v, '(\\d+\\.?\\d*)', 1) AS DOUBLE) NOT BETWEEN 0 AND 5 THEN 50 ELSE 100 END::DOUBLE"


@query(f"SELECT l_orderkey, l_linenumber, {_PERCENT} AS score FROM (SELECT *, CASE WHEN l_linenumber = 3 THEN 'about ' ELSE '' END || (l_quantity / 8)::VARCHAR || '%' AS v FROM lineitem)")
def check_percentage(spark, d):
    v = F.concat(F.when(F.col("l_linenumber") == 3, "about ").otherwise(""), (F.col("l_quantity") / 8).cast("string"), F.lit("%"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.percentage(v, 0, 5)["score"].alias("score"))


@query("""SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 0 WHEN p_partkey * 10 NOT BETWEEN 100 AND 10000 THEN 75 ELSE 100 END::DOUBLE AS score, p_size % 9 = 0 AS failed,
  p_size % 9 <> 0 AND p_partkey * 10 NOT BETWEEN 100 AND 10000 AS warning FROM part""")
def check_currency(spark, d):
    v = F.concat(F.when(F.col("p_size") % 9 == 0, "$").otherwise("₹"), F.format_number(F.col("p_partkey") * 10, 0))
    c = C.currency(v, 100, 10_000)
    return table(spark, d, "part").select("p_partkey", c["score"].alias("score"), c["failed"].alias("failed"), c["warning"].alias("warning"))


@query("SELECT c_custkey, CASE WHEN trim(c_mktsegment) IN ('BUILDING', 'MACHINERY') THEN 100 ELSE 0 END::DOUBLE AS score FROM customer")
def check_enum(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.enum(F.col("c_mktsegment"), ("BUILDING", "MACHINERY"))["score"].alias("score"))


@query("""SELECT page_id, CASE WHEN NOT regexp_matches(trim(url), '^https?://[^\\s/$.?#].[^\\s]*$') THEN 0 WHEN lower(regexp_extract(url, '://([^/?#:]+)', 1)) NOT IN ('tionsh.example.net', 'ththe.example.com') THEN 75 ELSE 100 END::DOUBLE AS score FROM pages""")
def check_url(spark, d):
    return table(spark, d, "pages").select("page_id", C.url(F.col("url"), ("tionsh.example.net", "ththe.example.com"))["score"].alias("score"))


@query("""SELECT doc_id, CASE WHEN contains(lower(trim(text)), 'token') THEN 50 WHEN NOT regexp_matches(trim(text), '^[A-Z]') THEN 75 WHEN length(trim(text)) < 40 THEN 0 WHEN length(trim(text)) > 5000 THEN 75 ELSE 100 END::DOUBLE AS score FROM documents""")
def check_text(spark, d):
    return table(spark, d, "documents").select("doc_id", C.text(F.col("text"), 40, 5000, "^[A-Z]", ("token",))["score"].alias("score"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 0 ELSE 100 END::DOUBLE AS score FROM events")
def check_timestamp(spark, d):
    ts = F.col("ts")
    forms = F.element_at(F.array(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.date_format(ts, "dd.MM.yyyy")), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", forms.alias("s")).select("event_id", C.timestamp(F.col("s"))["score"].alias("score"))


CUSTOMER_CHECKS = (
    C.Check("c_name", "text", True, 5, 200, r"^[A-Za-z0-9 #-]+$"),
    C.Check("c_mktsegment", "enum", False, allowed=("BUILDING", "MACHINERY", "AUTOMOBILE")),
    C.Check("balance", "currency", False, 100, 5000),
)
_BALANCE = "CASE WHEN c_acctbal < 0 THEN 'Not available' ELSE '₹' || floor(c_acctbal)::BIGINT END"
_CHECKS = f"""b AS (SELECT *, {_BALANCE} AS balance FROM customer),
v AS (SELECT c_custkey, 'c_name' AS field, CASE WHEN NOT regexp_matches(trim(c_name), '^[A-Za-z0-9 #-]+$') THEN 75 WHEN length(trim(c_name)) < 5 THEN 0 ELSE 100 END::DOUBLE AS score, length(trim(c_name)) < 5 AS failed, NOT regexp_matches(trim(c_name), '^[A-Za-z0-9 #-]+$') AS warning FROM b
  UNION ALL SELECT c_custkey, 'c_mktsegment', CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 100 ELSE 0 END, c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE'), false FROM b
  UNION ALL SELECT c_custkey, 'balance', CASE WHEN c_acctbal < 0 THEN 100 WHEN floor(c_acctbal) BETWEEN 100 AND 5000 THEN 100 ELSE 75 END, false, c_acctbal < 0 OR floor(c_acctbal) NOT BETWEEN 100 AND 5000 FROM b)"""


def _customer_checks(spark, d):
    balance = F.when(F.col("c_acctbal") < 0, T.SENTINEL).otherwise(F.concat(F.lit("₹"), F.floor("c_acctbal").cast("string")))
    return C.checked(table(spark, d, "customer").withColumn("balance", balance), "c_custkey", CUSTOMER_CHECKS)


@query(f"WITH {_CHECKS} SELECT * FROM v")
def check_dispatch(spark, d):
    return _customer_checks(spark, d)


@query(f"""WITH {_CHECKS}, s AS (SELECT c_custkey, round(avg(score), 4) AS score, max(failed::INTEGER) AS f, sum(warning::INTEGER)::BIGINT AS warnings FROM v GROUP BY 1)
SELECT c_custkey, score, warnings, CASE WHEN f = 1 OR score < 50 THEN 'failed' WHEN score < 80 THEN 'warning' ELSE 'passed' END AS status FROM s""")
def record_scores(spark, d):
    return C.scored(_customer_checks(spark, d), "c_custkey")


@query(f"""WITH {_CHECKS}, s AS (SELECT c_custkey, avg(score) AS score, max(failed::INTEGER) AS f, sum(warning::INTEGER) AS w FROM v GROUP BY 1)
SELECT count(*) AS records, count(*) FILTER (f = 0 AND score >= 80) AS passed, count(*) FILTER (f = 1 OR score < 50) AS failed, sum(w)::BIGINT AS warnings, round(avg(score), 1) AS average_score FROM s""")
def validation_totals(spark, d):
    s = C.scored(_customer_checks(spark, d), "c_custkey")
    return s.agg(F.count("*").alias("records"), F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("warnings").alias("warnings"), F.round(F.avg("score"), 1).alias("average_score"))


@query(r"""WITH y AS (SELECT l_partkey, year(l_shipdate) AS y, avg(l_extendedprice / l_quantity) AS p FROM lineitem GROUP BY ALL), m AS (SELECT l_partkey, round(max(p) FILTER (y = 1994) / max(p) FILTER (y = 1993) * 100 - 100, 1) AS a, round(max(p) FILTER (y = 1996) / max(p) FILTER (y = 1993) * 100 - 100, 1) AS b FROM y GROUP BY 1)
SELECT l_partkey, round((CASE WHEN a IS NULL THEN 75 WHEN a BETWEEN -50 AND 100 THEN 100 ELSE 50 END + CASE WHEN b IS NULL THEN 75 WHEN b BETWEEN -50 AND 100 THEN 100 ELSE 50 END) / 2, 4)::DOUBLE AS score, coalesce(a NOT BETWEEN -50 AND 100, false) OR coalesce(b NOT BETWEEN -50 AND 100, false) AS failed FROM m""")
def check_returns_map(spark, d):
    price = table(spark, d, "lineitem").groupBy("l_partkey", F.year("l_shipdate").alias("y")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    at = lambda y: F.max(F.when(F.col("y") == y, F.col("p")))
    change = lambda y: F.when((at(y) / at(1993)).isNotNull(), F.concat(F.format_string("%.1f", F.round(at(y) / at(1993) * 100 - 100, 1)), F.lit("%")))
    both = price.groupBy("l_partkey").agg(F.map_from_arrays(F.array(F.lit("1Y"), F.lit("3Y")), F.array(change(1994), change(1996))).alias("m"))
    v = C.percentage_map(F.map_filter("m", lambda _, x: x.isNotNull()), ("1Y", "3Y"))
    return both.select("l_partkey", F.round(v["score"], 4).alias("score"), v["failed"].alias("failed"))


@query("""WITH q AS (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), s AS (SELECT l_suppkey, round(q * 100 / sum(q) OVER (PARTITION BY l_suppkey), 0) + CASE WHEN l_returnflag = 'A' THEN l_suppkey % 8 ELSE 0 END AS v FROM q),
t AS (SELECT l_suppkey, sum(v) AS total FROM s GROUP BY 1)
SELECT l_suppkey, CASE WHEN abs(total - 100) > 5 THEN 75 ELSE 100 END::DOUBLE AS score, round(CASE WHEN abs(total - 100) <= 5 THEN 100 ELSE total END, 4)::DOUBLE AS scaled FROM t""")
def check_allocation(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    v = F.round(F.col("q") * 100 / F.sum("q").over(W.partitionBy("l_suppkey")), 0) + F.when(F.col("l_returnflag") == "A", F.col("l_suppkey") % 8).otherwise(0)
    m = s.select("l_suppkey", "l_returnflag", v.alias("v")).groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "v"))).alias("m"))
    total = F.aggregate(F.map_values(C.renormalised(F.col("m"))), F.lit(0.0), lambda a, x: a + x)
    return m.select("l_suppkey", C.allocation_map(F.col("m"))["score"].alias("score"), F.round(total, 4).alias("scaled"))


# Chunks


def _part_chunks(spark, d):
    parts = (
        ("primary_001", "primary", "high", "Overview", (("name", "Name", F.col("p_name")), ("type", "Type", F.col("p_type")), ("category", "Brand", F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))))),
        ("metric_001", "metric", "high", "Cost", (("expense_ratio", "Price", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("₹"), F.col("p_size").cast("string")))), ("nav", "Size", F.when(F.col("p_size") > 10, F.col("p_size").cast("string"))))),
        ("performance_001", "performance", "medium", "History", (("historical_performance", "Key", F.col("p_partkey").cast("string")),)),
    )
    return K.typed_chunks(table(spark, d, "part"), "p_partkey", parts)


_CHUNKS = """c AS (SELECT p_partkey, 1 AS chunk_no, 'primary' AS chunk_type, 'high' AS priority, 'Overview:' || chr(10) || 'Name: ' || p_name || chr(10) || 'Type: ' || p_type || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Brand: ' || p_brand ELSE '' END AS content, 2 + (p_size % 2 = 0)::INTEGER AS n, 3 AS expected FROM part
 UNION ALL SELECT p_partkey, 2, 'metric', 'high', 'Cost:' || chr(10) || concat_ws(chr(10), CASE WHEN p_size % 3 = 0 THEN 'Price: ₹' || p_size END, CASE WHEN p_size > 10 THEN 'Size: ' || p_size END), (p_size % 3 = 0)::INTEGER + (p_size > 10)::INTEGER, 3 FROM part WHERE p_size % 3 = 0 OR p_size > 10
 UNION ALL SELECT p_partkey, 3, 'performance', 'medium', 'History:' || chr(10) || 'Key: ' || p_partkey, 1, 2 FROM part)"""


@query(f"WITH {_CHUNKS} SELECT p_partkey, chunk_no, chunk_type, content, greatest(1, length(content) // 4)::INTEGER AS token_count FROM c")
def typed_chunks(spark, d):
    return _part_chunks(spark, d).select("p_partkey", "chunk_no", "chunk_type", "content", "token_count")


def _scored_chunks(spark, d):
    c = _part_chunks(spark, d)
    return c.select("p_partkey", "chunk_id", "chunk_type", "chunk_no", "content", "token_count", K.chunk_completeness(F.col("chunk_type"), F.col("source_fields")).alias("completeness"), K.relevance(F.col("chunk_type"), F.col("priority")).alias("relevance"))


_SCORED = f"""{_CHUNKS}, s AS (SELECT *, greatest(1, length(content) // 4) AS tokens, n / expected * 100 AS completeness, CASE chunk_type WHEN 'primary' THEN 90.0 WHEN 'metric' THEN 85.0 ELSE 64.0 END AS relevance FROM c)"""


@query(f"WITH {_SCORED} SELECT p_partkey, chunk_no, round(completeness, 4) AS completeness, relevance::DOUBLE AS relevance, concat_ws(',', CASE WHEN length(trim(content)) < 10 THEN 'content_too_short' END, CASE WHEN tokens NOT BETWEEN 50 AND 800 THEN 'token_count' END) AS issues, round(completeness * 0.6 + relevance * 0.4, 4) AS quality FROM s")
def chunk_checks(spark, d):
    q = F.round(F.col("completeness") * 0.6 + F.col("relevance") * 0.4, 4)
    return _scored_chunks(spark, d).select("p_partkey", "chunk_no", F.round("completeness", 4).alias("completeness"), "relevance", K.chunk_issues(F.col("content"), F.col("token_count"), F.col("chunk_id"), F.col("chunk_type")).alias("issues"), q.alias("quality"))


@query(f"""WITH {_SCORED} SELECT p_partkey, count(*) AS total_chunks, sum(tokens)::BIGINT AS total_tokens, round(sum(tokens) / count(*), 4) AS average_size, round(avg(completeness), 4) AS completeness, round(avg(relevance), 4) AS relevance,
  round(least(100, avg(completeness) * 0.4 + avg(relevance) * 0.3 + (100 - abs(sum(tokens) / count(*) - 400)) * 0.3), 4) AS overall FROM s GROUP BY 1""")
def chunk_quality(spark, d):
    return K.quality(_scored_chunks(spark, d), "p_partkey")


_FIRST = "CASE WHEN len({w}) <= {n} THEN {t} ELSE array_to_string({w}[1:{n}], ' ') END"
_WORDS = "list_filter(string_split_regex({0}, '[ \\t\\n\\r]+'), lambda x: x <> '')"


@query(f"""WITH n AS (SELECT conv_id, turn, text, lag(text) OVER w AS p, lead(text) OVER w AS f FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, coalesce('Context: ' || nullif({_FIRST.format(w=_WORDS.format('p'), n=13, t='p')}, '') || chr(10) || chr(10), '') || text || coalesce(chr(10) || chr(10) || 'Related: ' || nullif({_FIRST.format(w=_WORDS.format('f'), n=6, t='f')}, ''), '') AS with_context FROM n""")
def neighbour_context(spark, d):
    return K.with_neighbours(table(spark, d, "conversations"), "conv_id", "turn", 13, "text").select("conv_id", "turn", "with_context")


@query(f"""WITH {_CHUNKS}, p AS (SELECT p_partkey, chunk_no, content, unnest(range(1, len(list_filter(string_split_regex(content, '[:]\\s*'), lambda x: trim(x) <> '')) + 1)) AS i FROM c)
SELECT p_partkey, chunk_no, (i - 1)::INTEGER AS part_no, list_filter(string_split_regex(content, '[:]\\s*'), lambda x: trim(x) <> '')[i] AS part FROM p""")
def chunk_parts(spark, d):
    return K.all_parts(_part_chunks(spark, d), pattern=T.BOUNDARIES[2]).select("p_partkey", "chunk_no", "part_no", "part")


@query("""WITH r AS (SELECT l_suppkey, l_partkey, l_extendedprice AS w, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem)
SELECT l_suppkey, 'Top Holdings:' || chr(10) || string_agg(l_partkey || ': ' || round(w, 2), chr(10) ORDER BY n) AS content FROM (SELECT l_suppkey, l_partkey, n, floor(w)::BIGINT AS w FROM r) WHERE n <= 10 GROUP BY 1""".replace("round(w, 2)", "w"))
def holdings_chunks(spark, d):
    """The ten largest lines of each supplier: pruned by rank before they meet, so no supplier's lines are collected."""
    order = W.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    top = table(spark, d, "lineitem").withColumn("n", F.row_number().over(order)).where("n <= 10")
    line = F.concat_ws(": ", F.col("l_partkey").cast("string"), F.floor("l_extendedprice").cast("string"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"])
    return top.groupBy("l_suppkey").agg(F.concat(F.lit("Top Holdings:\n"), F.array_join(lines, "\n")).alias("content"))
