"""Selectors of pairs: which become vocabulary, and why the others do not.

Records are (pair_key, lang_idx, utility, probability_sum, support, positive_support), one row per pair and language.
Ranks are (utility, support, -key), greatest first, so every result is the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import lower_positive_rate, open_probability
from ..storage import materialize
from .discovery import roll_up

# Outcomes in the order in which they are tested.
REASONS = ("already_exact", "not_consecutive", "nonpositive_utility", "insufficient_support", "no_supported_positive_language")


def _order() -> list:
    return [F.desc("utility"), F.desc("support"), F.asc("pair_key")]


def promote(records: DataFrame, budget: int, min_support: int = 32, per_language_quota: int = 0, per_language_min_support: int = 8, min_utility: float = 0.0) -> DataFrame:
    """(pair_key, utility, support, reserved) of at most ``budget`` pairs.

    Only pairs of positive utility, at least ``min_utility``, are eligible. Each language reserves its best
    ``per_language_quota`` eligible pairs in which it has positive utility and enough support; the budget's rest goes to
    the best others of ``min_support``. Top-k limits come before ranks over all, so no rank is taken of more than
    ``budget`` rows in one task.
    """
    records = materialize(records)
    return _promote(records, materialize(_eligible(records, min_utility)), budget, min_support, per_language_quota, per_language_min_support)


def _eligible(records: DataFrame, min_utility: float) -> DataFrame:
    return roll_up(records).where((F.col("utility") > 0) & (F.col("utility") >= min_utility)).select("pair_key", "utility", "support")


def _promote(records: DataFrame, pairs: DataFrame, budget: int, min_support: int, quota: int, per_language_min_support: int) -> DataFrame:
    if quota <= 0:
        return pairs.where(F.col("support") >= min_support).orderBy(*_order()).limit(budget).withColumn("reserved", F.lit(False))
    own = records.select("pair_key", "lang_idx", F.col("utility").alias("_u"), F.col("support").alias("_n")).where(f"_u > 0 AND _n >= {per_language_min_support}")
    at = F.row_number().over(Window.partitionBy("lang_idx").orderBy(F.desc("_u"), F.desc("_n"), "pair_key"))
    wanted = own.join(pairs.select("pair_key"), "pair_key", "left_semi").withColumn("_at", at).where(F.col("_at") <= quota).select("pair_key").distinct()
    reserved = materialize(pairs.join(wanted, "pair_key", "left_semi").orderBy(*_order()).limit(budget).withColumn("reserved", F.lit(True)))
    rest = pairs.where(F.col("support") >= min_support).join(reserved.select("pair_key"), "pair_key", "left_anti")
    rest = rest.orderBy(*_order()).limit(budget).withColumn("reserved", F.lit(False))
    # reserved pairs first, then by rank: the first ``budget`` of at most twice as many rows
    return reserved.unionByName(rest).orderBy(F.desc("reserved"), *_order()).limit(budget)


def memberships(records: DataFrame, selected: DataFrame, per_language_quota: int, per_language_min_support: int = 8) -> DataFrame:
    """(pair_key, lang_idx): the languages that reserve a selected pair."""
    own = records.where((F.col("utility") > 0) & (F.col("support") >= per_language_min_support))
    at = F.row_number().over(Window.partitionBy("lang_idx").orderBy(*_order()))
    ranked = own.join(selected.select("pair_key"), "pair_key", "left_semi").withColumn("_at", at)
    return ranked.where(F.col("_at") <= per_language_quota).select("pair_key", "lang_idx")


def audit(records: DataFrame, budget: int, min_support: int, quota: int, per_language_min_support: int, min_utility: float = 0.0, capacity: int | None = None, languages: int | None = None) -> DataFrame:
    """One row: utility of the selection with the quota and without, what the quota displaced, and how full tables are.

    ``saturation`` is the number of pair-language records over the candidate table's ``capacity``, null without one.
    ``memberships`` counts the (pair, language) reservations, ``occupancy`` their share of ``quota`` places for each of
    ``languages`` (those that have a record, unless given), 0 without places.
    """
    records = materialize(records)
    pairs = materialize(_eligible(records, min_utility))
    free = materialize(_promote(records, pairs, budget, min_support, 0, per_language_min_support))
    held = materialize(_promote(records, pairs, budget, min_support, quota, per_language_min_support))
    a = free.agg(F.coalesce(F.sum("utility"), F.lit(0.0)).alias("global_utility"), F.count("*").alias("global_pairs"))
    b = held.agg(F.coalesce(F.sum("utility"), F.lit(0.0)).alias("reserved_utility"), F.count("*").alias("selected_pairs"), F.count_if("reserved").alias("reserved_pairs"))
    c = held.join(free.select("pair_key"), "pair_key", "left_anti").agg(F.count("*").alias("reservation_only"))
    d = free.join(held.select("pair_key"), "pair_key", "left_anti").agg(F.count("*").alias("global_only"))
    e = records.agg(F.count("*").alias("records"), F.count_distinct("lang_idx").alias("languages"))
    f = memberships(records, held, quota, per_language_min_support).agg(F.count("*").alias("memberships"), F.count_distinct("lang_idx").alias("languages_reserved"))
    one = a
    for other in (b, c, d, e, f):
        one = one.join(F.broadcast(other))  # a row each
    places = quota * (F.lit(languages) if languages is not None else F.col("languages"))
    return one.withColumns({
        "displaced_utility": F.col("global_utility") - F.col("reserved_utility"),
        "saturation": F.col("records") / F.lit(capacity).cast("double"),
        "occupancy": F.when(places > 0, F.col("memberships") / places).otherwise(0.0),
    })


def select_external(records: DataFrame, keys: DataFrame, minimum_support: int) -> DataFrame:
    """(pair_key, support, language_count, problem) of keys chosen elsewhere; a key is refused where ``problem`` is not null.

    Null keys are refused; a key that comes twice is refused as ``repeated``.
    """
    asked = keys.groupBy("pair_key").agg(F.count("*").alias("_times"))
    joined = asked.join(roll_up(records), "pair_key", "left")
    problem = (
        F.when(F.col("pair_key").isNull(), "null_key").when(F.col("_times") > 1, "repeated").when(F.col("support").isNull(), "unknown_pair")
        .when(F.col("utility") <= 0, "nonpositive_utility").when(F.col("support") < minimum_support, "insufficient_support")
    )
    return joined.select("pair_key", "support", "language_count", problem.alias("problem"))


def _positive(*thresholds: int) -> None:
    if min(thresholds) < 1:
        raise ValueError("support thresholds are 1 or more")


def _window(records: DataFrame, name: str, per_language_min_support: int) -> DataFrame:
    good = F.max(((F.col("utility") > 0) & (F.col("support") >= per_language_min_support)).cast("int"))
    out = records.groupBy("pair_key").agg(F.sum("utility").alias("u"), F.sum("support").alias("n"), F.sum("positive_support").alias("pos"), F.sum("probability_sum").alias("ps"), good.alias("lang"))
    return out.select("pair_key", *[F.col(c).alias(f"{name}_{c}") for c in ("u", "n", "pos", "ps", "lang")])


def _judged(prev: DataFrame, cur: DataFrame, existing: DataFrame, per_language_min_support: int) -> DataFrame:
    known = existing.select("pair_key").distinct().withColumn("known", F.lit(True))
    return _window(cur, "cur", per_language_min_support).join(_window(prev, "prev", per_language_min_support), "pair_key", "left").join(known, "pair_key", "left")


def _reason(min_support: int) -> Column:
    return (
        F.when(F.col("known"), "already_exact").when(F.col("prev_u").isNull(), "not_consecutive")
        .when((F.col("cur_u") <= 0) | (F.col("prev_u") <= 0), "nonpositive_utility")
        .when((F.col("cur_n") < min_support) | (F.col("prev_n") < min_support), "insufficient_support")
        .when((F.col("cur_lang") == 0) | (F.col("prev_lang") == 0), "no_supported_positive_language")
    )


def stable_growth(prev: DataFrame, cur: DataFrame, existing: DataFrame, min_support: int = 32, per_language_min_support: int = 8) -> DataFrame:
    """(pair_key, outcome) of every pair of ``cur``: ``selected`` or the first reason against it.

    A language with positive utility and support is needed in each window, not the same in both.
    """
    _positive(min_support, per_language_min_support)
    judged = _judged(prev, cur, existing, per_language_min_support)
    return judged.select("pair_key", F.coalesce(_reason(min_support), F.lit("selected")).alias("outcome"))


def sign_growth(prev: DataFrame, cur: DataFrame, existing: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(pair_key, outcome): pairs of positive utility in both windows whose share of positive evidence is above one half in both,
    by a bound that holds for all pairs of a window at once."""
    judged = _judged(prev, cur, existing, 0)
    n_cur = cur.agg(F.count_distinct("pair_key").alias("h_cur"))
    n_prev = prev.agg(F.count_distinct("pair_key").alias("h_prev"))
    judged = judged.join(F.broadcast(n_cur)).join(F.broadcast(n_prev))  # a row each
    sure = (lower_positive_rate("cur_pos", "cur_n", "h_cur", alpha) > 0.5) & (lower_positive_rate("prev_pos", "prev_n", "h_prev", alpha) > 0.5)
    outcome = F.when(F.col("known"), "already_exact").when(F.col("prev_u").isNull(), "not_consecutive").when((F.col("cur_u") <= 0) | (F.col("prev_u") <= 0), "nonpositive_utility")
    return judged.select("pair_key", outcome.when(~F.coalesce(sure, F.lit(False)), "insufficient_sign_evidence").otherwise("selected").alias("outcome"))


def l0_growth(cur: DataFrame, existing: DataFrame, min_support: int = 32, per_language_min_support: int = 8, open_threshold: float = 0.5) -> DataFrame:
    """(pair_key, outcome): pairs of one window whose gate is open with at least ``open_threshold`` at their mean probability."""
    _positive(min_support, per_language_min_support)
    known = existing.select("pair_key").distinct().withColumn("known", F.lit(True))
    judged = _window(cur, "cur", per_language_min_support).join(known, "pair_key", "left")
    opened = open_probability(F.greatest(F.least(F.col("cur_ps") / F.col("cur_n"), F.lit(1.0)), F.lit(0.0)))
    outcome = (
        F.when(F.col("known"), "already_exact").when(F.col("cur_u") <= 0, "nonpositive_utility").when(F.col("cur_n") < min_support, "insufficient_support")
        .when(F.col("cur_lang") == 0, "no_supported_positive_language").when(F.coalesce(opened, F.lit(0.0)) < open_threshold, "gate_closed")
    )
    return judged.select("pair_key", F.coalesce(outcome, F.lit("selected")).alias("outcome"))


def histogram(outcomes: DataFrame, reasons: tuple[str, ...] = REASONS) -> DataFrame:
    """(outcome, n) with a row for every reason, 0 where none has it."""
    every = outcomes.sparkSession.createDataFrame([(r,) for r in (*reasons, "selected")], "outcome string")
    return every.join(outcomes.groupBy("outcome").agg(F.count("*").alias("n")), "outcome", "left").na.fill(0)


def balanced_growth(prev: DataFrame, cur: DataFrame, existing: DataFrame, limit: int, min_support: int = 1, per_language_min_support: int = 1) -> DataFrame:
    """(pair_key, lang_idx, share, via): at most ``limit`` pairs, the languages' turns first, then by the best share.

    A pair counts for a language that has positive utility and support in both windows; its share there is the lesser of
    its shares of the language's utility. Languages take their quota in the order of their indices, skipping pairs taken
    before; what is left is filled by share. The turns are found in rounds: each language takes its best pairs except
    those that an earlier one took in the round before, until no round changes anything. After k rounds the first k
    languages are final, and the only state that does not change is that of taking turns one by one; mostly a few rounds do.
    """
    fine = stable_growth(prev, cur, existing, min_support, per_language_min_support).where("outcome = 'selected'").select("pair_key")
    good = lambda df, name: df.where((F.col("utility") > 0) & (F.col("support") >= per_language_min_support)).select("pair_key", "lang_idx", F.col("utility").alias(name))
    both = materialize(good(prev, "a").join(good(cur, "b"), ["pair_key", "lang_idx"]).join(fine, "pair_key", "left_semi"))
    sums = both.groupBy("lang_idx").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))  # one row per language
    both = materialize(both.join(sums, "lang_idx").select("pair_key", "lang_idx", F.least(F.col("a") / F.col("_a"), F.col("b") / F.col("_b")).alias("share")))
    spark = cur.sparkSession
    present = sorted(r["lang_idx"] for r in both.select("lang_idx").distinct().collect())  # languages of a model
    each, more = divmod(limit, max(1, len(present)))
    quotas = spark.createDataFrame([(lang, each + (turn < more)) for turn, lang in enumerate(present)], "lang_idx int, quota int")
    at = F.row_number().over(Window.partitionBy("lang_idx").orderBy(F.desc("share"), "pair_key"))
    taken, before = spark.createDataFrame([], "pair_key long, owner int"), None
    for _ in range(len(present) + 1):
        open_ = both.join(taken, "pair_key", "left").where(F.col("owner").isNull() | (F.col("owner") >= F.col("lang_idx")))
        # a constant bound of the rank lets Spark cut each task's rows before they are shuffled
        chosen = open_.withColumn("at", at).where(F.col("at") <= each + 1).join(quotas, "lang_idx").where("at <= quota").select("pair_key", "lang_idx", "share")
        chosen = materialize(chosen)
        taken = materialize(chosen.groupBy("pair_key").agg(F.min("lang_idx").alias("owner")))
        now = chosen.agg(F.count("*"), F.sum(F.xxhash64("pair_key", "lang_idx").cast("decimal(38,0)"))).head()
        if before == now:
            break
        before = now
    turns = chosen.withColumn("via", F.lit("language"))
    best = both.join(turns.select("pair_key"), "pair_key", "left_anti").groupBy("pair_key").agg(F.max_by("lang_idx", F.struct("share", -F.col("lang_idx"))).alias("lang_idx"), F.max("share").alias("share"))
    left = limit - turns.count()
    return turns.unionByName(best.orderBy(F.desc("share"), "pair_key").limit(max(0, left)).withColumn("via", F.lit("backfill")))
