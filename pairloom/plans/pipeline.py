"""Whole runs: frequency control, discovery with promotion, growth over windows, and evaluation."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DiscoverySettings
from ..operators import discovery, evaluate, selection, tokens, transitions
from ..sources import sinks, tables
from ..storage import materialize


def frequency_selection(spark: SparkSession, candidates: str, out: str, budget: int) -> dict:
    """The ``budget`` candidates of greatest support as a selection list in key order; its manifest, with the supports at the cut."""
    top = materialize(discovery.top_pairs(tables.candidates(spark, candidates).withColumnRenamed("captured_support", "support"), budget))
    edge = top.agg(F.min("support").alias("last"), F.max("next_support").alias("next"), F.count("*").alias("n")).head()
    if edge["n"] < budget:
        raise ValueError(f"only {edge['n']} candidates for {budget}")
    listed = top.orderBy("pair_key").select("pair_key", F.lit("frequency").alias("selector"), F.col("support").alias("support_estimate"))
    return sinks.write_list(listed, out, {"selector": "frequency", "last_support": edge["last"], "first_excluded_support": edge["next"]})


def materialize_selection(spark: SparkSession, selected: str, base: int, buckets: int, selector: str, size: int) -> DataFrame:
    """Slots of a checked selection, compacted in key order."""
    return transitions.compact(transitions.assign_slots(tables.selection(spark, selected, selector, size), base, buckets))


def corpus_pairs(texts: DataFrame, vocab: DataFrame, base: int, text: str = "text", language: str = "lang") -> DataFrame:
    """(pair_key, lang, n) of neighbouring words of a corpus that are tokens of the vocabulary.

    Words are counted in pairs before the vocabulary is joined, so the join is over distinct pairs and not over places.
    """
    pairs = tokens.adjacent_pairs(texts.select(F.col(language).alias("lang"), tokens.words(text).alias("t")), "t", "lang").groupBy("left", "right", "lang").agg(F.count("*").alias("n"))
    side = lambda name, to: vocab.select(F.col("piece").alias(name), F.col("token_id").alias(to))
    return pairs.join(side("left", "a"), "left").join(side("right", "b"), "right").select((F.col("a").cast("long") * base + F.col("b")).alias("pair_key"), "lang", "n")


def discover_and_promote(records: DataFrame, settings: DiscoverySettings, base: int, buckets: int, folder: str | Path | None = None) -> dict[str, DataFrame]:
    """Promotion at the end of a discovery: selected pairs, their reservations, the audit and their slots.

    With ``folder``, the candidate list and the selected vocabulary are written with manifests.
    """
    merged = materialize(discovery.merge_records(records))
    args = (settings.budget, settings.min_support, settings.per_language_quota, settings.per_language_min_support, settings.min_utility)
    selected = materialize(selection.promote(merged, *args))
    out = {
        "selected": selected,
        "memberships": selection.memberships(merged, selected, settings.per_language_quota, settings.per_language_min_support),
        "audit": selection.audit(merged, settings.budget, settings.min_support, settings.per_language_quota, settings.per_language_min_support, settings.min_utility, settings.candidate_capacity),
        "slots": transitions.compact(transitions.assign_slots(selected, base, buckets)),
    }
    if folder is not None:
        languages = merged.agg(F.max("lang_idx")).head()[0] or 0
        wide = merged.select((F.col("pair_key") * (languages + 1) + F.col("lang_idx")).alias("composite_key"), "pair_key", F.col("lang_idx").alias("language_index"), "utility", "probability_sum", F.col("support").alias("captured_support"), (F.col("probability_sum") / F.col("support")).alias("mean_probability"))
        sinks.write_list(wide.orderBy("pair_key", "language_index"), Path(folder) / "candidates.csv")
        ids = selected.withColumn("right_id", F.pmod("pair_key", F.lit(base))).withColumn("left_id", ((F.col("pair_key") - F.col("right_id")) / base).cast("long"))
        sinks.write_list(ids.orderBy("pair_key"), Path(folder) / "selected.csv", {"budget": settings.budget})
    return out


def grow_over_windows(records: DataFrame, existing: DataFrame, windows: list[int], min_support: int = 32, per_language_min_support: int = 8, folder: str | Path | None = None) -> DataFrame:
    """Existing keys and slots after a decision at each window with the one before it; with ``folder``, a manifest per decision."""
    for before, now in zip(windows, windows[1:]):
        half = lambda w: discovery.merge_records(records.where(F.col("window_id") == w))
        judged = materialize(selection.stable_growth(half(before), half(now), existing, min_support, per_language_min_support))
        existing = materialize(transitions.grow(existing, judged.where("outcome = 'selected'")).select("pair_key", "slot"))
        if folder is not None:
            counts = {r["outcome"]: r["n"] for r in selection.histogram(judged).collect()}
            sinks.write_json({"window": now, **counts}, Path(folder) / f"decision-{now}.json", overwrite=False)
    return existing


def compare_runs(spark: SparkSession, a: str, b: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """Paired comparison of two folders of result files."""
    one, two = (evaluate.main_scores(tables.results(spark, x)) for x in (a, b))
    return evaluate.bootstrap(evaluate.paired(one, two), resamples, seed)
