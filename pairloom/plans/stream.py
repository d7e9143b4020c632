"""The pair stream: from stream specs to batches of cleaned, marked pairs, reproducible and resumable by batch number."""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import StreamSettings, StreamSpec
from ..functions.text import with_marker
from ..operators import filters, sampling
from ..sources import catalog
from ..storage import materialize
from ..streaming.windows import batch_stream


def usable_pairs(spark: SparkSession, shards: DataFrame, settings: StreamSettings, overlap: float | None = None) -> DataFrame:
    """(row_id, source, language, anchor_language, sampling_weight, anchor, positive) of all shards, cleaned, without held-out row groups.

    Files that share their two columns are one scan, which reads these columns only. ``overlap``: least Dice overlap of the
    sides' words, more than which is asked for. ``row_id`` names file and place, so it is the same on every run.
    """
    listed = sorted((r["anchor_column"], r["positive_column"], r["path"]) for r in shards.select("anchor_column", "positive_column", "path").collect())  # a catalog
    parts = [catalog.scan(spark, [p for *_, p in files], *columns, settings.holdout_row_groups) for columns, files in groupby(listed, key=lambda r: r[:2])]
    rows = reduce(DataFrame.unionByName, parts).withColumn("_p", catalog._plain("path")).drop("path")
    about = shards.select(catalog._plain("path").alias("_p"), "source", F.col("language_id").alias("language"), "anchor_language_id", F.coalesce("sampling_weight", F.lit(1.0)).alias("sampling_weight"))
    rows = filters.clean_pairs(rows, settings.max_chars).join(about, "_p")
    if overlap is not None:
        from ..functions.text import word_terms

        rows = filters.overlapping(rows.withColumns({"_a": word_terms("anchor"), "_b": word_terms("positive")}), "_a", "_b", overlap).drop("_a", "_b")
    own = F.when(F.coalesce("anchor_language_id", F.lit("")) == "", F.col("language")).otherwise(F.col("anchor_language_id"))
    return rows.select(F.concat_ws("#", "_p", "row_index").alias("row_id"), "source", "language", own.alias("anchor_language"), "sampling_weight", "anchor", "positive")


def group_table(rows: DataFrame) -> DataFrame:
    """(source, language, rows, source_weight) of usable pairs: what the schedule of batches is made from."""
    sums = rows.groupBy("source", "language").agg(F.count("*").alias("rows"), F.sum("sampling_weight").alias("_w"))
    per = sums.groupBy("source").agg((F.sum("_w") / F.sum("rows")).alias("source_weight"))
    return sums.drop("_w").join(per, "source")


def training_batches(spark: SparkSession, specs: list[StreamSpec], roots: dict[str, str], settings: StreamSettings, batches: int, *, mixed: bool = False, strict: bool = False, markers: bool = False, overlap: float | None = None) -> DataFrame:
    """(batch, slot, source, language, anchor, positive, row_id) of ``batches`` batches from ``settings.start_batch`` on.

    By default a batch is of one source and language, chosen in turns by rows and weights, and has no text twice; where
    that cannot be, ``strict`` is an error and otherwise the batch is filled up with repeats. ``mixed`` takes rows of all
    sources in turns instead; rows that repeat a text of their batch are left out of it. ``markers`` puts language markers
    before both sides. A batch depends on its number only, so a run that resumes equals one that was never interrupted.
    """
    shards = materialize(catalog.discover(spark, specs, roots, settings.seed))
    rows = materialize(usable_pairs(spark, shards, settings, overlap))
    groups = materialize(group_table(rows))
    if mixed:
        weights = groups.groupBy("source").agg((F.max("source_weight") * F.pow(F.sum("rows").cast("double"), F.lit(settings.source_temperature))).alias("weight"))
        placed = sampling.mixed_order(rows, weights, "row_id", batches * settings.batch_size, settings.start_batch * settings.batch_size, seed=settings.seed)
        placed = placed.withColumn("number", F.floor(F.col("place") / settings.batch_size))
        out = filters.batch_dedup(placed, settings.batch_size, "number", "place").drop("batch").withColumnRenamed("number", "batch")
        if strict and out.groupBy("batch").count().where(F.col("count") < settings.batch_size).head():
            raise ValueError(f"no unique batch of {settings.batch_size} rows in the mixture")
    else:
        plan = materialize(sampling.batch_plan(groups, batches, settings.start_batch, settings.source_temperature, settings.language_temperature, settings.seed))
        out = sampling.unique_batches(rows, plan, settings.batch_size, "row_id", strict, seed=settings.seed)
    if markers:
        out = out.withColumns({"anchor": with_marker("anchor", "anchor_language"), "positive": with_marker("positive", "language")})
    return out.select("batch", "slot", "source", "language", "anchor", "positive", "row_id")


def pair_stream(spark: SparkSession, batches: DataFrame, folder: str, per_trigger: int = 16, start: int = 0) -> DataFrame:
    """Planned batches written to ``folder`` once and read as an endless stream in their order; see ``windows.batch_stream``."""
    batches.write.mode("ignore").parquet(folder)
    return batch_stream(spark, spark.read.parquet(folder), per_trigger, start)


def unmarked(texts: DataFrame, text: str) -> DataFrame:
    """Rows whose text does not begin with a language marker, null ones included; a run that needs markers has none."""
    from ..functions.text import MARKER

    return texts.where(~F.coalesce(F.col(text).rlike(MARKER), F.lit(False)))
