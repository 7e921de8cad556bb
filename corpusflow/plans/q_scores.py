"""Queries on scores of whole stages and on functions that are given to SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks as C
from . import sql_surface
from .registry import query, table


@query("""WITH v AS (SELECT p_partkey, p_size || '%' AS p, '₹' || p_partkey * 7 AS a, CASE WHEN p_size % 3 = 0 THEN 'nil' ELSE p_size || '%' END AS l FROM part)
SELECT p_partkey, p_size <= 40 AS percent_ok, p_partkey * 7 BETWEEN 100 AND 10000 AS amount_ok, p_size % 3 = 0 OR p_size <= 10 AS load_ok, length(p_name) BETWEEN 3 AND 20 AS name_ok,
 CASE WHEN p_size <= 10 THEN p_size || '%' WHEN p_partkey * 7 BETWEEN 100 AND 10000 THEN '₹' || p_partkey * 7 END AS picked FROM part JOIN v USING (p_partkey)""")
def value_checks(spark, d):
    p, a = F.concat(F.col("p_size").cast("string"), F.lit("%")), F.concat(F.lit("₹"), (F.col("p_partkey") * 7).cast("string"))
    load = F.when(F.col("p_size") % 3 == 0, "nil").otherwise(p)
    picked = C.first_valid((p, C.valid_percentage(p, 10)), (a, C.valid_amount(a, 100, 10_000)))
    return table(spark, d, "part").select("p_partkey", C.valid_percentage(p, 40).alias("percent_ok"), C.valid_amount(a, 100, 10_000).alias("amount_ok"), C.valid_load(load).alias("load_ok"), C.valid_length(F.col("p_name"), 3, 20).alias("name_ok"), picked.alias("picked"))


@query("""WITH s AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS name, greatest(0, 100 - 20 * ((p_size % 4 = 0)::INTEGER + (p_size * 5 > 100)::INTEGER))::DOUBLE AS r, CASE WHEN p_size <= 10 THEN 100 ELSE 50 END AS e, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size * 100 BETWEEN 1000 AND 3000 THEN 100 ELSE 50 END AS m FROM part)
SELECT p_partkey, CASE WHEN name = '' THEN 0 ELSE round((r + e + coalesce(m, 0)) / (2 + (m IS NOT NULL)::INTEGER), 4) END::DOUBLE AS score FROM s""")
def post_clean_checks(spark, d):
    n = F.col("p_size")
    first = F.when(n % 4 == 0, F.concat(F.lit("about "), (n % 2).cast("string"))).otherwise(F.concat((n % 2).cast("string"), F.lit("%")))
    values = F.create_map(F.lit("1Y"), first, F.lit("3Y"), F.concat((n * 5).cast("string"), F.lit(".0%")), F.lit("5Y"), F.lit("Not available"))
    sip = F.when(n % 5 != 0, F.concat(F.lit("₹"), F.format_number(n * 100, 0)))
    parts = [C.returns_consistency(values), C.range_score(F.concat(n.cast("string"), F.lit("%")), 0, 10), C.range_score(sip, 1000, 3000)]
    return table(spark, d, "part").select("p_partkey", C.post_clean_score([F.when(n % 7 == 0, "").otherwise(F.col("p_name"))], parts).alias("score"))


@query("""SELECT p_partkey, round(c * 0.4 + e * 0.6, 4)::DOUBLE AS confidence, round(c * 0.3 + v * 0.4 + e * 0.3, 4)::DOUBLE AS quality, CASE WHEN c >= 80 AND e >= 80 AND v >= 80 THEN 'excellent' WHEN c * 0.4 + e * 0.6 >= 70 THEN 'good' WHEN c * 0.4 + e * 0.6 >= 50 THEN 'acceptable' ELSE 'needs_improvement' END AS status
FROM (SELECT p_partkey, (p_size * 2)::DOUBLE AS c, (p_partkey % 101)::DOUBLE AS e, (p_partkey * 3 % 101)::DOUBLE AS v FROM part)""")
def combined_scores(spark, d):
    confidence, quality, status = C.combined((F.col("p_size") * 2).cast("double"), (F.col("p_partkey") % 101).cast("double"), (F.col("p_partkey") * 3 % 101).cast("double"))
    return table(spark, d, "part").select("p_partkey", F.round(confidence, 4).alias("confidence"), F.round(quality, 4).alias("quality"), status.alias("status"))


@query("""SELECT label, round(d * 0.4 + greatest(0, 100 - 25 * m) * 0.3 + greatest(0, 100 - 15 * b) * 0.3, 4) AS score, CASE WHEN d * 0.4 + greatest(0, 100 - 25 * m) * 0.3 + greatest(0, 100 - 15 * b) * 0.3 >= 90 THEN 'excellent' WHEN d * 0.4 + greatest(0, 100 - 25 * m) * 0.3 + greatest(0, 100 - 15 * b) * 0.3 >= 80 THEN 'good' ELSE 'fair' END AS status
FROM (SELECT label, avg((len(embedding) = 64)::INTEGER) * 100 AS d, (label % 2)::INTEGER AS m, (label % 3)::INTEGER AS b FROM embeddings GROUP BY label)""")
def storage_validation(spark, d):
    share = F.avg((F.size("embedding") == 64).cast("int")) * 100
    rows = table(spark, d, "embeddings").groupBy("label").agg(share.alias("d"))
    score = C.storage_score(F.col("d"), F.col("label") % 2, F.col("label") % 3)
    return rows.select("label", F.round(score, 4).alias("score"), C.ladder(score, ((90, "excellent"), (80, "good")), "fair").alias("status"))


@query("""SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::INTEGER AS estimate, ('0x' || substr(md5(lang), 1, 8))::BIGINT % 384 AS dim, trim(regexp_replace(lower(source), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS source FROM documents""")
def sql_functions(spark, d):
    """The same functions, called from SQL text."""
    sql_surface.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("corpusflow_documents")
    return spark.sql("SELECT doc_id, token_estimate(text) AS estimate, hash_dimension(lang) AS dim, normalise_text(source) AS source FROM corpusflow_documents")
