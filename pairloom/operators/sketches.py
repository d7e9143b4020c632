"""Count-Min and signed Count sketches as group-bys.

A sketch is a table (depth, bucket, cell) of three times ``width`` cells at most, made with partial sums on the map side,
and so mergeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import sketch_bucket, sketch_sign

DEPTHS = (0, 1, 2)
#: Cells of a sketch that goes to every task whole.
MOST_CELLS = 2_000_000


def width_for(capacity: int) -> int:
    return max(64, capacity)


def _hashed(keys: DataFrame, key: str, width: int) -> DataFrame:
    """A row per key with ``_buckets`` and ``_signs``, one of each per depth."""
    return keys.withColumns({"_buckets": F.array(*[sketch_bucket(key, d, width) for d in DEPTHS]), "_signs": F.array(*[sketch_sign(key, d) for d in DEPTHS])})


def sketch(df: DataFrame, key: str, value: str, width: int, signed: bool = False) -> DataFrame:
    """(depth, bucket, cell). Rows are summed per key first: a key is hashed once however often it occurs. Nulls do not count."""
    per_key = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.sum(value).alias("_v"))
    cells = _hashed(per_key, key, width).select("_v", F.posexplode(F.arrays_zip("_buckets", "_signs")).alias("depth", "c"))
    cells = cells.select("_v", "depth", F.col("c._buckets").alias("bucket"), F.col("c._signs").alias("sign"))
    amount = F.col("_v") * F.col("sign") if signed else F.col("_v")
    return cells.groupBy("depth", "bucket").agg(F.sum(amount).alias("cell"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("depth", "bucket").agg(F.sum("cell").alias("cell"))


def _dense(cells: DataFrame, width: int) -> DataFrame:
    """One row with an array of ``width`` cells per depth, those that nothing fell into 0."""
    places = cells.sparkSession.range(len(DEPTHS) * width).select(F.floor(F.col("id") / width).cast("int").alias("depth"), F.pmod("id", F.lit(width)).alias("bucket"))
    cell = F.struct("bucket", F.coalesce("cell", F.lit(0)).alias("cell"))
    full = places.join(cells, ["depth", "bucket"], "left").withColumn("c", cell)
    return full.agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("depth") == d, F.col("c")))), lambda x: x["cell"]).alias(f"_c{d}") for d in DEPTHS])


def estimate(keys: DataFrame, key: str, cells: DataFrame, width: int, signed: bool = False) -> DataFrame:
    """``keys`` (distinct) with ``estimate``: the middle of the three signed cells, or the least of the unsigned ones.

    A sketch of at most ``MOST_CELLS`` is one row of three arrays that goes to every task, so keys are not moved at all;
    a wider one is joined.
    """
    if len(DEPTHS) * width <= MOST_CELLS:
        seen = _hashed(keys, key, width).join(F.broadcast(_dense(cells, width)))  # one row
        found = [F.element_at(f"_c{d}", (F.col("_buckets")[d] + 1).cast("int")) * (F.col("_signs")[d] if signed else F.lit(1)) for d in DEPTHS]
        value = found[0] + found[1] + found[2] - F.least(*found) - F.greatest(*found) if signed else F.least(*found)
        return seen.select(*keys.columns, value.alias("estimate"))
    joined = _hashed(keys.select(key), key, width).select(key, F.posexplode("_buckets").alias("depth", "bucket"), "_signs").join(cells, ["depth", "bucket"], "left")
    amount = F.coalesce(F.col("cell"), F.lit(0)) * (F.element_at("_signs", F.col("depth") + 1) if signed else F.lit(1))
    found = joined.groupBy(key).agg(F.array_sort(F.collect_list(amount)).alias("_e"))
    return keys.join(found.select(key, F.col("_e")[1 if signed else 0].alias("estimate")), key)
