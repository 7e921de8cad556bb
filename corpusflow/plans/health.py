"""Health of a growing collection from mergeable states.

A state holds what a set of rows adds to the health card: counts, sums, extremes, the small set of its categories, and
HyperLogLog sketches of what is too large for a set. States of disjoint sets of rows merge by sums, unions and maxima. The
folder of a bucket is never changed, so its state is computed once and kept beside it; the card of a version merges the
states of the folders that it lists. After an upsert only the buckets that it wrote are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import available
from ..sources.store import Collection

#: Size of the sketches: 2**12 registers, a standard error of about 1.6 %.
SKETCH_BITS = 12
#: Weights and fixed parts of the scores. Fixed values.
EXPECTED, ASSUMED, TYPES_WANTED = 15, 85.0, 3
COUNTS = ("documents", "complete", "well_formed")
SUMS = ("completeness", "relevance")


def state(content: Column, name: Column, category: Column, at: Column, completeness: Column, relevance: Column) -> dict[str, Column]:
    """Aggregates of the state of a set of rows."""
    there = available(content) & available(name)
    return {
        "documents": F.count("*"), "complete": F.count_if(there), "well_formed": F.count_if(there & available(category)), "completeness": F.coalesce(F.sum(completeness.cast("double")), F.lit(0.0)),
        "relevance": F.coalesce(F.sum(relevance.cast("double")), F.lit(0.0)), "newest": F.max(at.cast("string")), "categories": F.collect_set(category), "contents": F.hll_sketch_agg(F.md5(F.coalesce(content, F.lit(""))), SKETCH_BITS),
    }


def chunk_state() -> dict[str, Column]:
    """The state of the chunks that ``ingest`` writes."""
    return state(*(F.col(c) for c in ("content", "url", "chunk_type", "fetched_at", "completeness", "relevance")))


def merged(states: DataFrame, *by: str) -> DataFrame:
    """The state of all rows of ``states``, by columns."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*COUNTS, *SUMS)]
    return states.groupBy(*by).agg(*sums, F.max("newest").alias("newest"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("categories"), F.hll_union_agg("contents").alias("contents"))


def card(states: DataFrame, entities: int | None = None) -> DataFrame:
    """The health card of a state: documents, health, coverage, integrity, types, distinct (an estimate), duplicates (an
    estimate), consistency, accuracy, completeness, relevance, newest."""
    n, expected = F.col("documents"), EXPECTED * (entities or 1)
    share = lambda c: F.when(n > 0, F.round(c / n * 100, 4)).otherwise(0.0)
    coverage = F.least(F.lit(100.0), F.round(n / expected * 100, 4))
    distinct = F.least(n, F.coalesce(F.hll_sketch_estimate("contents"), F.lit(0)))
    repeated = n - distinct
    # Sketches err by some percent, so only more repeats than that count as duplicates.
    passed = (repeated <= 0.05 * n).cast("int") + (F.size("categories") >= TYPES_WANTED).cast("int") + (F.col("well_formed") == n).cast("int")
    mean = lambda c: F.when(n > 0, F.round(F.col(c) / n, 4))
    return states.select(
        "documents", F.when(n > 0, "healthy").otherwise("empty").alias("health"), coverage.alias("coverage"), share(F.col("complete")).alias("integrity"), F.size("categories").alias("types"), distinct.alias("distinct"),
        repeated.alias("duplicates"), F.round(passed / 3 * 100, 4).alias("consistency"), F.round(coverage * 0.4 + ASSUMED * 0.3 + share(F.col("complete")) * 0.3, 4).alias("accuracy"),
        mean("completeness").alias("completeness"), mean("relevance").alias("relevance"), "newest",
    )


def kept_states(collection: Collection, aggregates: dict[str, Column], version: str | None = None) -> DataFrame:
    """(folder, state) of the folders of a version, the current one by default. Those not yet known are computed, by one pass
    over them, and kept under ``states``."""
    entry = collection.current()
    listing = collection.listing(version or entry["version"]).where("folder is not null").select("folder")
    path = f"{collection.path}/states"
    known = [f"{path}/{n}" for n in collection.files.listed(path)]
    spark = collection.spark
    new = listing.join(spark.read.parquet(*known).select("folder"), "folder", "left_anti") if known else listing
    if folders := [r[0] for r in new.collect()]:  # names, a few bytes a bucket
        rows = spark.read.parquet(*(f"{collection.path}/{f}" for f in folders))
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"(data/[^/]+/_bucket=\d+)/[^/]*$", 1)
        each = rows.select("*", folder.alias("folder")).groupBy("folder").agg(*(c.alias(n) for n, c in aggregates.items()))
        each.write.parquet(f"{path}/{uuid.uuid4().hex}")
    held = [f"{path}/{n}" for n in collection.files.listed(path)]
    return spark.read.parquet(*held).join(listing, "folder", "left_semi") if held else rows_of_none(collection, aggregates)


def rows_of_none(collection: Collection, aggregates: dict[str, Column]) -> DataFrame:
    """States of an empty collection: none."""
    return collection.read().groupBy(F.lit("").alias("folder")).agg(*(c.alias(n) for n, c in aggregates.items()))


def health(collection: Collection, aggregates: dict[str, Column] | None = None, entities: int | None = None, version: str | None = None) -> DataFrame:
    """The card of a version, from kept states."""
    return card(merged(kept_states(collection, aggregates or chunk_state(), version)), entities)
