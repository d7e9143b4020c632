"""Most frequent items among billions (problem 1): mergeable Misra-Gries summaries.

Each task folds its rows into at most ``capacity`` counters. Whenever there are more, the (capacity + 1)-th largest
counter is subtracted from all and those that fall to zero are dropped. Summaries merge the same way in two levels, so
no task ever holds more than ``capacity`` counters and one batch. With W the total weight, the subtractions add up to
an error of at most W / (capacity + 1); each item's true weight lies in [lower, lower + error], and every item whose
weight exceeds the error is in the summary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

#: Counters of the first summary and of the largest that is tried.
CAPACITY, MOST_CAPACITY = 4096, 65_536
MERGERS = 32


def _fold(counters: pd.Series, capacity: int) -> tuple[pd.Series, int]:
    """Subtract the (capacity + 1)-th largest counter from all and drop those that fall to zero."""
    if len(counters) <= capacity:
        return counters, 0
    at = len(counters) - capacity - 1
    cut = int(np.partition(counters.to_numpy(), at)[at])
    return counters[counters > cut] - cut, cut


def _summarize(capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters, error = pd.Series(dtype="int64"), 0
        for batch in batches:
            error += int(batch.loc[batch["item"].isna(), "weight"].sum())  # errors of merged summaries
            batch = batch[batch["item"].notna()]
            if len(batch):
                part = batch.groupby("item", sort=False)["weight"].sum()
                counters = part if not len(counters) else counters.add(part, fill_value=0).astype("int64")
                counters, cut = _fold(counters, capacity)
                error += int(cut)
        yield pd.DataFrame({"item": pd.Series(counters.index, dtype="object"), "weight": counters.to_numpy("int64")})
        yield pd.DataFrame({"item": pd.Series([None], dtype="object"), "weight": [error]})

    return run


def misra_gries(df: DataFrame, item: str, weight: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Summary of ``item`` weighted by ``weight`` (1 if none): (item, lower, upper), at most ``capacity`` rows.

    Null items, null weights and weights that are not positive do not count. An empty input gives an empty summary.
    Other columns of ``df`` are not looked at, so their names cannot clash.
    """
    weights = F.lit(1) if weight is None else F.col(weight)
    rows = df.select(F.col(item).alias("item"), weights.cast("long").alias("weight")).where("item IS NOT NULL AND weight > 0")
    kind = rows.schema["item"].dataType.simpleString()
    schema = f"item {kind}, weight long"
    local = rows.mapInPandas(_summarize(capacity), schema)
    merged = local.repartition(MERGERS).mapInPandas(_summarize(capacity), schema)
    final = merged.repartition(1).mapInPandas(_summarize(capacity), schema)
    error = F.max(F.when(F.col("item").isNull(), F.col("weight"))).over(Window.partitionBy(F.lit(0)))  # the summary is bounded
    return (
        final.withColumn("error", error)
        .where("item IS NOT NULL")
        .select("item", F.col("weight").alias("lower"), (F.col("weight") + F.col("error")).alias("upper"))
    )


def _counted(rows: DataFrame) -> DataFrame:
    """(item, weight): exact totals, the rows of one item and record counted once, those without a record each."""
    key = F.when(F.col("record").isNull(), F.monotonically_increasing_id())
    once = rows.withColumn("alone", key).groupBy("item", "record", "alone").agg(F.min("weight").alias("weight"))
    return once.groupBy("item").agg(F.sum("weight").alias("weight")).where("weight > 0")


def top_items(df: DataFrame, item: str, weight: str, record: str, n: int, capacity: int = CAPACITY, most: int = MOST_CAPACITY) -> DataFrame:
    """The ``n`` items of greatest total weight: (item, lower, upper, weight), ties by the smaller item.

    A ``record`` that occurs again with the same item counts once, with its least weight; rows without a record stand
    alone; null items and weights, and totals that are not positive, do not count. The summary is made over all rows,
    repeats included: a repeat can only raise a total, so whatever exceeds the summary's error without repeats is in it.
    Its items are then counted exactly, without repeats. If the n-th of these does not exceed the error, an item might be
    missing; the summary is then made again with four times the capacity, up to ``most`` counters, which bounds what the
    last merge and the broadcast hold. Beyond that the weights are too even for any summary of this size, and all items
    are counted by a group-by, whose ``lower`` and ``upper`` are the weight.
    """
    rows = df.select(F.col(item).alias("item"), F.col(weight).cast("long").alias("weight"), F.col(record).alias("record"))
    rows = rows.where("item IS NOT NULL AND weight IS NOT NULL")
    while True:
        capacity = min(capacity, most)
        summary = materialize(misra_gries(rows, "item", "weight", capacity))  # at most ``capacity`` rows
        exact = _counted(rows.join(F.broadcast(summary.select("item")), "item", "left_semi"))
        top = materialize(exact.join(F.broadcast(summary), "item").select("item", "lower", "upper", "weight").orderBy(F.desc("weight"), "item").limit(n))
        got = top.agg(F.count("*").alias("n"), F.min("weight").alias("least")).head()
        error = summary.agg(F.max(F.col("upper") - F.col("lower"))).head()[0]
        if error is None:  # no counter is left: either there is no weight, or all is spread too evenly
            sure = rows.where("weight > 0").isEmpty()
        else:
            sure = error == 0 or (got["n"] == n and got["least"] > error)
        if sure:
            return top
        if capacity >= most:
            return _counted(rows).orderBy(F.desc("weight"), "item").limit(n).select("item", F.col("weight").alias("lower"), F.col("weight").alias("upper"), "weight")
        capacity *= 4
