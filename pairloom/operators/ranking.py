"""Places, running totals and quantiles in one order of all rows, in two levels.

The rows are sorted by ranges, as many as there are shuffle partitions. Counts and sums of the ranges, one row each, are
added up first; within a range the rows are numbered from there. No task ever holds more than its range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def running(df: DataFrame, order: list[str], totals: list[str] | tuple = (), place: str = "place") -> DataFrame:
    """``df`` with ``place`` (from 0) in the ascending order of columns ``order``, and ``<total>_so_far``, the row included.

    Rows equal in ``order`` have places next to each other, in no stated order, so ``order`` should end in something
    unique. Nulls come first, as Spark sorts them.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))  # ranges are drawn from a sample: made again, they might differ
    sums = ranged.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in totals])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = sums.select("_range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before{c}") for c in ("_n", *[f"_sum_{t}" for t in totals])])
    within = Window.partitionBy("_range").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(before), "_range").withColumn(place, F.row_number().over(within) - 1 + F.col("_before_n"))
    for c in totals:
        out = out.withColumn(f"{c}_so_far", F.sum(c).over(upto) + F.col(f"_before_sum_{c}"))
    return out.drop("_range", "_before_n", *[f"_before_sum_{c}" for c in totals])


def quantiles(values: DataFrame, value: str, by: str, shares: dict[str, float]) -> DataFrame:
    """(``by``, name...) with the exact quantile of each share, interpolated between the two values next to it.

    Rows are placed in the order of group and value, so a group that holds most of the rows is spread over many tasks, where
    an aggregate of all its values would sit in one. Nulls do not count; a group without values has no row; null is a group.
    """
    rows = values.where(F.col(value).isNotNull()).select(F.col(by), F.col(value).cast("double").alias("_v"))
    placed = materialize(running(rows, [by, "_v"]))
    first = materialize(placed.groupBy(by).agg(F.min("place").alias("_first"), F.count("*").alias("_n")))  # one row per group
    joined = placed.alias("p").join(first.alias("f"), F.col(f"p.{by}").eqNullSafe(F.col(f"f.{by}")))
    at = F.col("place") - F.col("_first")
    picks = []
    for name, share in shares.items():
        exact = (F.col("_n") - 1) * float(share)
        low = F.floor(exact)
        weight = F.when(at == low, 1 - (exact - low)).when(at == low + 1, exact - low)
        picks.append(F.sum(F.col("_v") * F.coalesce(weight, F.lit(0.0))).alias(name))
    return joined.groupBy(F.col(f"p.{by}").alias(by)).agg(*picks)
