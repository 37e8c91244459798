"""Running sums that no single task has to make alone.

A window over one key runs in one task.  Here the rows are first range-partitioned
by key and order, and each row gets the number of its part; sums within a part
come from a local window, and the totals of earlier parts of the same key are
added.  Totals are one row per key and part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.plans.storage import materialise

PART = "_part"


def split_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "ordered") -> DataFrame:
    """The rows with the number of the range they lie in, written once so that it never changes."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(parts, *keys, *order).withColumn(PART, F.spark_partition_id()), name)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column], reverse: bool = False) -> DataFrame:
    """Add, for each name, the sum of its column over the rows of the same keys up to and including this one.

    `df` comes from `split_in_order` by the same keys and order; with `reverse`
    the sum is over this row and all later ones.  The order must be strict, else rows
    that are equal in it may come either way round.
    """
    names = list(sums)
    totals = df.groupBy(*keys, PART).agg(*(F.sum(sums[n]).alias(n) for n in names))
    step = F.col(PART).desc() if reverse else F.col(PART).asc()
    before = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col(PART).alias("_p"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_o_{n}") for n in names))
    ordered = [o.desc() if reverse else o.asc() for o in order]
    local = Window.partitionBy(*keys, PART).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0)
    out = df.select("*", *(F.sum(sums[n]).over(local).alias(f"_l_{n}") for n in names))
    same = F.col(PART) == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return out.join(offsets, same).select(*(F.col(c) for c in df.columns), *((F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in names))
