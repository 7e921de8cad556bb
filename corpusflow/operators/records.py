"""Records: upserts, merges, completeness, routing, rendering, refresh, rejects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import available


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins: the row of the greatest ``order`` for each key (any one of equal ones). One shuffle, with a
    map-side combine."""
    best = df.groupBy(key).agg(F.max_by(F.struct("*"), F.col(order)).alias("row"))
    return best.select("row.*")


def upsert(base: DataFrame, delta: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of ``delta`` replace those of ``base`` with their key; others are added."""
    fresh = last_per_key(delta, key, order) if order else delta
    kept = base.join(fresh.select(key), key, "left_anti")
    return kept.unionByName(fresh.select(base.columns))


def numbered(df: DataFrame, prefix: str, order: str, offset: int = 0) -> DataFrame:
    """Adds ids ``prefix`` + number, dense from ``offset`` on, in the order of a column (unique, so a rerun gives the same).

    Rows are dealt to range partitions; a row's number is its rank within its partition and the sizes of those before it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id())
    ranked = placed.withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy(order)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = W.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_rank") - 1 + offset
    return ranked.join(offsets, "_part").withColumn("new_id", F.concat(F.lit(prefix), number.cast("string"))).drop("_part", "_rank", "_before")


def filled(docs: DataFrame, text: str, embed: Callable[[Column], Column], metadata: str = "metadata", embedding: str = "embedding") -> DataFrame:
    """Defaults of rows that are added: an empty map where the metadata are null, and a vector of the text where the
    embedding is null; other texts are not embedded."""
    plain = F.create_map().cast(docs.schema[metadata].dataType)
    own = embed(F.when(F.col(embedding).isNull(), F.col(text)))
    return docs.withColumns({metadata: F.coalesce(metadata, plain), embedding: F.coalesce(F.col(embedding), own)})


def slug(name: Column, position: Column) -> Column:
    return F.concat_ws("_", F.lower(F.replace(name, F.lit(" "), F.lit("_"))), position.cast("string"))


def split_by(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for which the condition holds, and all others (null included)."""
    sure = F.coalesce(good, F.lit(False))
    return df.where(sure), df.where(~sure)


def rejects(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Adds ``missing``, the comma-joined required columns that are not available (empty for good rows)."""
    missing = F.array_compact(F.array(*(F.when(~available(F.col(c).cast("string")), F.lit(c)) for c in required)))
    return df.withColumn("missing", F.array_join(missing, ","))


def overlay(records: DataFrame, found: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Extracted values win over parsed ones where they are there."""
    new = found.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return records.join(new, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def merged_maps(first: Column, second: Column) -> Column:
    """Map with the second's values where it has them."""
    return F.map_zip_with(first, second, lambda _, a, b: F.coalesce(b, a))


def unwrapped(documents: DataFrame, record: str, fallback: dict[str, Column], required: str) -> DataFrame:
    """Records out of a nested container: the ``record`` struct where it is there, else one made of other parts of the
    container; those without the required field are left out. Fields that the fallback lacks are null in it."""
    names = documents.schema[record].dataType.fieldNames()
    made = F.struct(*(fallback.get(n, F.lit(None)).cast(documents.schema[record].dataType[n].dataType).alias(n) for n in names))
    rows = documents.withColumn(record, F.coalesce(F.col(record), made)).where(F.length(F.trim(F.col(f"{record}.{required}"))) > 0)
    return rows.select(*(c for c in documents.columns if c != record), f"{record}.*")


def rebuilt(old: DataFrame, enriched: DataFrame, key: str, content: str) -> DataFrame:
    """Rows of a rebuilt collection: old chunks with key and content, and enriched ones, which win over old ones of their key."""
    kept = old.where(F.col(key).isNotNull() & (F.length(content) > 0))
    return upsert(kept, enriched.select(*kept.columns), key)


def duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(text, copies, first_id) of texts that stand in several rows, null ones among them; keys are unique.

    Rows are grouped by a digest, so texts stay out of the shuffle; those of the few groups come back by their first key."""
    groups = df.groupBy(F.unhex(F.md5(text)).alias("digest")).agg(F.count("*").alias("copies"), F.min(key).alias("first_id")).where("copies > 1").drop("digest")
    return df.select(text, F.col(key).alias("first_id")).join(groups, "first_id").select(text, "copies", "first_id")


def labelled_text(pairs: tuple[tuple[str, Column], ...]) -> Column:
    """``Label: value`` lines of the values that are there, without repeats."""
    lines = F.array(*(F.when(available(v), F.concat(F.lit(f"{label}: "), v)) for label, v in pairs))
    return F.array_join(F.array_distinct(F.array_compact(lines)), "\n")


def stored_text(pairs: tuple[tuple[str, Column], ...]) -> Column:
    """``Label: value | Label: value``, blanks skipped."""
    return F.concat_ws(" | ", *(F.when(F.length(F.trim(v)) > 0, F.concat(F.lit(f"{label}: "), v)) for label, v in pairs))


def routed(groups: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """For each group of columns the map of those that are available."""

    def one(columns: tuple[str, ...]) -> Column:
        values = F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("string"))))
        return F.map_filter(values, lambda _, v: available(v))

    return {g: one(c) for g, c in groups.items()}


def needs_refresh(source: DataFrame, target: DataFrame, key: str, as_of: Column, days: int = 1, force: bool = False) -> DataFrame:
    """Source rows whose target is missing or older than ``days``."""
    seen = target.select(F.col(key).alias("_k"), F.col("last_updated"))
    joined = source.join(seen, source[key] == seen["_k"], "left")
    old = F.col("last_updated").isNull() | (F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("last_updated")) / 86_400) > days)
    return joined.where(F.lit(force) | old).drop("_k")


def unpivoted(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(key, field, value) with values as strings."""
    return df.select(key, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(key, list(columns), "field", "value")


def coverage(df: DataFrame, key: str, categories: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, category, available, required, coverage in percent, missing)."""
    fields = tuple(c for cs in categories.values() for c in cs)
    pairs = [(F.lit(f), F.lit(c)) for c, fs in categories.items() for f in fs]
    category = F.element_at(F.create_map(*(x for p in pairs for x in p)), F.col("field"))
    long = unpivoted(df, key, fields).select(key, "field", category.alias("category"), available(F.col("value")).alias("there"))
    return long.groupBy(key, "category").agg(
        F.count_if("there").alias("available"), F.count("*").alias("required"), F.round(F.count_if("there") / F.count("*") * 100, 1).alias("coverage"),
        F.array_join(F.sort_array(F.collect_list(F.when(~F.col("there"), F.col("field")))), ",").alias("missing"),
    )


def completeness(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, completeness in percent) from all fields, row by row and without a shuffle."""
    there = sum((available(F.col(f).cast("string")).cast("int") for f in fields), F.lit(0))
    return df.select(key, F.round(F.coalesce(there, F.lit(0)) / len(fields) * 100, 4).alias("completeness"))


def weighted_completeness(tiers: tuple[tuple[float, tuple[Column, ...]], ...], cap: float = 100) -> Column:
    """Weights of the available fields, capped."""
    return F.least(F.lit(float(cap)), sum((F.when(available(c), float(w)).otherwise(0.0) for w, cs in tiers for c in cs), F.lit(0.0)))


def field_gaps(df: DataFrame, key: str, fields: tuple[str, ...], report: float = 50, high: float = 25) -> DataFrame:
    """(field, availability in percent, severity) of fields below ``report`` percent."""
    share = F.round(F.avg(available(F.col("value")).cast("int")) * 100, 4)
    gaps = unpivoted(df, key, fields).groupBy("field").agg(share.alias("availability"))
    return gaps.where(F.col("availability") < report).withColumn("severity", F.when(F.col("availability") < high, "high").otherwise("medium"))


def shares(df: DataFrame, entity: str, group: str, value: str) -> DataFrame:
    """(entity, group, total, share in percent); entities with a total of 0 are left out. One shuffle on the entity."""
    by_group = df.groupBy(entity, group).agg(F.sum(value).alias("total"))
    return by_group.withColumn("whole", F.sum("total").over(W.partitionBy(entity))).where(F.col("whole") > 0).select(entity, group, "total", F.round(F.col("total") / F.col("whole") * 100, 4).alias("share"))


def missing_from(expected: DataFrame, found: DataFrame, column: str) -> DataFrame:
    return expected.join(found.select(column).distinct(), column, "left_anti")

