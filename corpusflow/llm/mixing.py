"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

A document's size is its number of words. Sources get weights by their rank in code point order (null last) and share
``share`` times all sizes; a target stops at ``cap`` times its source's size, and what is left over goes to the others
by weight until none is above (water-filling, solved in closed form with one window over the sources).

Each source queues its documents in the order of a seeded hash, then once more for the second pass. A document's
virtual finish time is the source's words up to and including it, divided by the source's target. All queues together
are ordered by finish time, and the mix is cut where the running total would exceed the budget.

No task holds a source: running totals are taken in hash buckets of about ``BUCKET_ROWS`` rows and added up over the
bucket sums, and the cut is found from a histogram of finish times, in which one narrow bin is then looked at row by row.

Defined cases: a null text has size 0; a null source is a source of its own; documents of size 0 take nothing; a
document is taken 0, 1 or 2 times, never in part; repeated rows are separate documents (which of several identical rows
is taken is open, how many is not); an empty table gives an empty table; a very long text is one document that is taken
or left whole; other columns pass through unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written

WEIGHTS = (5, 2, 1)
SHARE, CAP, SEED = 1.5, 2, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
#: About this many rows are summed in one window partition.
BUCKET_ROWS = 2000


def sizes(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shuffle_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Adds source_rank, weight, budget and target to (source, source_size, source_rows)."""
    every = W.partitionBy(F.lit(1))
    ranked = by_source.withColumn("source_rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(cap))
    before = every.orderBy(F.col("limit") / F.col("weight"), "source_rank").rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    return (
        ranked.withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("level", level)
        .withColumn("target", F.least(F.col("limit").cast("double"), F.max("level").over(every) * F.col("weight")))
        .drop("level", "limit")
    )


def finish_times(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds the source's columns, the bucket and finish_1, finish_2 to rows with _id, _source, _size and _key."""
    of = stats.select(F.col("source").alias("_s"), "source_size", "source_rows", "source_rank", "target")
    rows = rows.join(of, rows["_source"].eqNullSafe(of["_s"])).drop("_s")
    buckets = F.ceil(F.col("source_rows") / BUCKET_ROWS)
    rows = rows.withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)))
    within = W.partitionBy("source_rank", "_bucket").orderBy("_key", "_id", "_size").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("_upto", F.sum("_size").over(within))


def with_finish(rows: DataFrame, stats: DataFrame, slim: DataFrame) -> DataFrame:
    """Finish times of both passes; the buckets' sums come from the slim rows."""
    sums = finish_times(slim, stats).groupBy("source_rank", "_bucket").agg(F.sum("_size").alias("_sum"))
    before = W.partitionBy("source_rank").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col("source_rank").alias("_r"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    rows = finish_times(rows, stats)
    rows = rows.join(offsets, (rows["source_rank"] == offsets["_r"]) & (rows["_bucket"] == offsets["_b"])).drop("_r", "_b", "_bucket")
    upto = F.col("_before") + F.col("_upto")
    return rows.withColumns({
        "_finish_1": F.when(F.col("target") > 0, upto / F.col("target")).otherwise(0.0),
        "_finish_2": F.when(F.col("target") > 0, (F.col("source_size") + upto) / F.col("target")).otherwise(0.0),
    }).drop("_before", "_upto")


def place(finish: str, n: int) -> Column:
    return F.struct(F.col(finish).alias("finish"), F.col("source_rank"), F.lit(n).alias("pass"), F.col("_key"), F.col("_id"), F.col("_size"))


def cut(timed: DataFrame, budget: float, n_rows: int) -> tuple[int, object]:
    """The bin of finish times in which the budget ends, and the last place in it that is still taken (or None)."""
    bins = max(1, -(-n_rows // BUCKET_ROWS))
    entries = timed.select("_size", F.explode(F.array(place("_finish_1", 1), place("_finish_2", 2))).alias("place"))
    entries = entries.withColumn("bin", F.floor(F.col("place.finish") * bins))
    one = W.partitionBy(F.lit(1))
    upto = F.sum("size").over(one.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    histogram = entries.groupBy("bin").agg(F.sum("_size").alias("size")).withColumn("upto", upto)
    first_over = histogram.where(F.col("upto") > budget).orderBy("bin").select("bin", (F.col("upto") - F.col("size")).alias("before")).first()
    if first_over is None:
        return 1 << 62, None
    inside = entries.where(F.col("bin") == first_over["bin"])
    running = F.sum("_size").over(one.orderBy("place").rowsBetween(W.unboundedPreceding, 0)) + first_over["before"]
    last = inside.withColumn("running", running).where(F.col("running") <= budget).agg(F.max("place").alias("place")).first()["place"]
    return first_over["bin"], last


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED, keep_columns: bool = False) -> DataFrame:
    """One row a document: id, size, source_size, target, taken and copies, or (keep_columns) ``_doc``, all its columns, and ``_copies``."""
    if cap != 2:
        raise ValueError("documents are queued twice, so cap is 2")
    named = {"_id": F.col(id_col), "_source": F.col(source_col), "_size": sizes(F.col(text_col)), "_key": shuffle_key(F.col(id_col), F.col(text_col), seed)}
    slim = written(docs.select(*(c.alias(n) for n, c in named.items())), "mix-sizes")
    by_source = slim.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"), F.count("*").alias("source_rows"))
    stats = written(targets(by_source, weights, share, cap), "mix-targets")
    whole = stats.agg(F.max("budget").alias("budget"), F.sum("source_rows").alias("rows")).first()
    timed = written(with_finish(slim, stats, slim), "mix-times")
    bin_no, last = cut(timed, whole["budget"] or 0.0, whole["rows"] or 0)
    bins = max(1, -(-(whole["rows"] or 0) // BUCKET_ROWS))

    def taken(finish: str, n: int) -> Column:
        own = F.floor(F.col(finish) * bins)
        inside = F.lit(False)
        if last is not None:
            fields = timed.select(place(finish, n).alias("p")).schema["p"].dataType.fields
            inside = place(finish, n) <= F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(fields, last, strict=True)))
        return ((own < bin_no) | ((own == bin_no) & inside)).cast("int")

    copies = taken("_finish_1", 1) + taken("_finish_2", 2)
    if not keep_columns:
        return timed.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * copies).alias("taken"), copies.alias("copies"))
    whole_rows = docs.select(F.struct("*").alias("_doc"), *(c.alias(n) for n, c in named.items()))
    return with_finish(whole_rows, stats, slim).select("_doc", copies.alias("_copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns."""
    counted = mix(docs, id_col, source_col, text_col, keep_columns=True)
    return counted.where(F.col("_copies") > 0).select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws('|', 'mix-1', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS budget FROM r),
l AS (SELECT *, (budget - coalesce(sum(2 * source_size) OVER b, 0)::DOUBLE)
                / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS lvl
      FROM w WINDOW b AS (ORDER BY (2 * source_size)::DOUBLE / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least((2 * source_size)::DOUBLE, max(lvl) OVER () * weight) AS target FROM l),
q AS (SELECT d.doc_id, d.size, d.k, t.source_size, t.target, t.rk, t.budget,
             sum(d.size) OVER (PARTITION BY t.rk ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto,
             row_number() OVER () AS n
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT n, size, budget, rk, k, doc_id, p,
             CASE WHEN target > 0 THEN ((p - 1) * source_size + upto)::DOUBLE / target ELSE 0 END AS finish
      FROM q, (VALUES (1), (2)) AS v(p)),
c AS (SELECT n, size, sum(size) OVER (ORDER BY finish, rk, p, k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running, budget FROM e),
k AS (SELECT n, sum(CASE WHEN running <= budget THEN 1 ELSE 0 END)::INTEGER AS copies FROM c GROUP BY n)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * k.copies)::BIGINT AS taken, k.copies
FROM q JOIN k ON q.n = k.n
"""
