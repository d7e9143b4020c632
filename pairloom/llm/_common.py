"""What the operators of this subpackage share: reading tables, cutting lineage and checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import materialize

__all__ = ["collect_bounded", "materialize", "read", "semi_join"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collect_bounded(df: DataFrame, most: int, what: str) -> list:
    """Rows of a small table on the driver; an error rather than a silent cut where there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows")
    return rows


MOST_BROADCAST = 200_000


def semi_join(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi", most: int = MOST_BROADCAST) -> DataFrame:
    """Join with ``keys``, a materialized table of distinct keys: broadcast up to ``most`` rows, which are counted; shuffled beyond."""
    from pyspark.sql import functions as F

    return rows.join(F.broadcast(keys) if keys.count() <= most else keys.hint("merge"), on, how)
