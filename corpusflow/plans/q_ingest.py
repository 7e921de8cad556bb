"""Queries of the whole ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ingest
from .registry import query, table


@query()  # a composition; its parts have SQL, and tests hold the whole against them
def ingest_chunks(spark, d):
    rows = ingest.transform(table(spark, d, "pages").select("url", "html"))
    return rows.select("id", "chunk_type", "token_count", "completeness", "relevance", F.size("vector").alias("dimensions"))


@query("SELECT count(*) AS pages, count(*) FILTER (html IS NULL) AS empty FROM pages")
def ingest_sources(spark, d):
    return table(spark, d, "pages").agg(F.count("*").alias("pages"), F.count_if(F.col("html").isNull()).alias("empty"))
