"""Running totals in a global order, without a task that holds a group.

Rows are dealt to range partitions of about equal size. Totals are taken within each part of a group and added up over
the parts, so a group of a third of all rows is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """The rows as a written table with ``part``, the number of their range partition, and ``at``, which rises in the order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return written(placed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ranged")


def earlier_all(placed: DataFrame, group: str, values: dict[str, Column], total: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Adds for each name the total of its value over the earlier rows of the row's group; null where there are none.

    ``placed`` comes from ``ranged``; ``total`` is ``F.sum``, or ``F.max`` for values that rise with ``at``. All values share
    the aggregation, the join and the sort."""
    names = list(values)
    table = placed.withColumns({f"_value_{n}": v for n, v in values.items()})
    sums = table.groupBy(group, "part").agg(*(total(F.col(f"_value_{n}")).alias(f"_sum_{n}") for n in names))
    before = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each part of a group
    carried = sums.select(group, "part", *(total(F.col(f"_sum_{n}")).over(before).alias(f"_carried_{n}") for n in names)).where(F.greatest(F.lit(False), *(F.col(f"_carried_{n}").isNotNull() for n in names)))
    within = W.partitionBy("part", group).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    rows = table.withColumns({f"_inside_{n}": total(F.col(f"_value_{n}")).over(within) for n in names}).join(carried, ["part", group], "left")

    def both(n: str) -> Column:
        inside, before_it = F.col(f"_inside_{n}"), F.col(f"_carried_{n}")
        return F.coalesce(inside + before_it, inside, before_it) if total is F.sum else F.coalesce(inside, before_it)

    return rows.withColumns({n: both(n) for n in names}).drop(*(f"{x}_{n}" for n in names for x in ("_value", "_inside", "_carried")))


def earlier(placed: DataFrame, group: str, name: str, value: Column, total: Callable[[Column], Column] = F.sum) -> DataFrame:
    """``earlier_all`` for one value."""
    return earlier_all(placed, group, {name: value}, total)
