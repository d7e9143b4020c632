"""Window metrics, tensor statistics and latency distributions."""

from __future__ import annotations

import math
from collections.abc import Callable
from time import perf_counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import BETA, GAMMA, ZETA, entropy, sigmoid
from .ranking import quantiles


def ratio(a, b) -> Column:
    """0 where the divisor is 0 or null."""
    return F.coalesce(F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b), F.lit(0.0))


def window_metrics(steps: DataFrame, interval: int = 100, step: str = "step") -> DataFrame:
    """Per window of ``interval`` steps: base tokens, candidate pairs, hits, merges and their ratios.

    ``steps`` has (step, base_tokens, candidate_pairs, hits, merged): sums of soft gates or counts of merges.
    """
    w = steps.groupBy(F.floor(F.col(step) / interval).alias("window_id")).agg(*[F.sum(c).alias(c) for c in ("base_tokens", "candidate_pairs", "hits", "merged")], F.count("*").alias("n_steps"))
    w = w.withColumn("effective_tokens", F.col("base_tokens") - F.col("merged"))
    return w.withColumn("compression", ratio("effective_tokens", "base_tokens")).withColumn("hit_rate", ratio("hits", "candidate_pairs")).withColumn("merge_rate", ratio("merged", "candidate_pairs"))


def _with_quantiles(values: DataFrame, value: str, by: str, aggregates: list[Column], shares: dict[str, float]) -> DataFrame:
    simple = values.where(F.col(value).isNotNull()).groupBy(by).agg(*aggregates).alias("a")
    exact = quantiles(values, value, by, shares).alias("q")
    joined = simple.join(exact, F.col(f"a.{by}").eqNullSafe(F.col(f"q.{by}")))
    return joined.select("a.*", *[f"q.{name}" for name in shares])


def statistics(values: DataFrame, value: str, by: str) -> DataFrame:
    """Mean, population deviation, least, median, greatest and share of positive values; groups without values have none.

    The median is exact and found by places in a sorted order, so a group of any size is spread over tasks.
    """
    x = F.col(value)
    plain = [F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("least"), F.max(x).alias("greatest"), F.avg((x > 0).cast("double")).alias("positive")]
    return _with_quantiles(values, value, by, plain, {"median": 0.5})


def latency(values: DataFrame, value: str, by: str) -> DataFrame:
    """Mean, sample deviation (0 for one value), median and deciles, interpolated and exact."""
    x = F.col(value)
    plain = [F.count("*").alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std")]
    return _with_quantiles(values, value, by, plain, {"median": 0.5, "p10": 0.1, "p90": 0.9})


def gradient_norms(values: DataFrame, value: str, tensor: str, group: str) -> DataFrame:
    """(group, norm): each tensor's squares are taken relative to its greatest size, so that none overflows."""
    x = F.abs(F.col(value).cast("double"))
    most = values.where(F.col(value).isNotNull()).groupBy(group, tensor).agg(F.max(x).alias("_m"))
    scaled = values.join(most, [group, tensor]).groupBy(group, tensor).agg(F.max("_m").alias("_m"), F.sum(F.when(F.col("_m") > 0, F.pow(x / F.col("_m"), F.lit(2.0))).otherwise(0.0)).alias("_s"))
    return scaled.groupBy(group).agg(F.sqrt(F.sum(F.col("_m") * F.col("_m") * F.col("_s"))).alias("norm"))


def clip_coefficient(norm, most: float) -> Column:
    return F.least(F.lit(1.0), ratio(F.lit(most), norm))


def parameter_group(name: str, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """Group of a parameter by ordered prefixes; a rule that begins with ``*`` is a suffix."""
    out = F.lit(other)
    for pattern, group in reversed(rules):
        hit = F.col(name).endswith(pattern[1:]) if pattern.startswith("*") else F.col(name).startswith(pattern)
        out = F.when(hit, group).otherwise(out)
    return out


def fusion_penalty(rows: DataFrame, dims: int, token: str = "token_id", vector: str = "vec") -> DataFrame:
    """One row: the mean distance of per-language rows from their token's centroid. Sums are of one row per token."""
    from ..functions.stats import divide, euclidean, sum_vectors

    centers = rows.groupBy(token).agg(sum_vectors(vector, dims).alias("_s"), F.count("*").alias("_n")).select(token, divide("_s", "_n", 1.0).alias("_c"))
    return rows.join(centers, token).agg(F.avg(euclidean(vector, "_c")).alias("penalty"))


def usage(routed: DataFrame, tokens: DataFrame, step: str = "step") -> DataFrame:
    """Per step what ``window_metrics`` adds up: (step, base_tokens, candidate_pairs, hits, merged).

    ``tokens`` has a row per token (step, sent_id), ``routed`` a row per pair with a row of its own (step, p): a pair's gate,
    0 or 1 under a matching. Candidate pairs are the places between tokens of a sentence.
    """
    counted = tokens.groupBy(step, "sent_id").agg(F.count("*").alias("_n")).groupBy(step).agg(F.sum("_n").alias("base_tokens"), F.sum(F.col("_n") - 1).alias("candidate_pairs"))
    used = routed.groupBy(step).agg(F.count("*").alias("hits"), F.sum("p").alias("merged"))
    return counted.join(used, step, "left").na.fill(0, ["hits", "merged"])


def touched(routed: DataFrame, bucket: str, interval: int = 100, step: str = "step", least: float = 0.5) -> DataFrame:
    """Per window the distinct buckets that pairs were routed to, and those selected with a gate of ``least`` or more."""
    w = routed.groupBy(F.floor(F.col(step) / interval).alias("window_id"), bucket).agg(F.max("p").alias("_p"))
    return w.groupBy("window_id").agg(F.count(bucket).alias("touched"), F.count_if((F.col("_p") >= least) & F.col(bucket).isNotNull()).alias("selected"))


def expected_l0(scores: DataFrame, bias: DataFrame, beta: float = BETA, gamma: float = GAMMA, zeta: float = ZETA) -> DataFrame:
    """One row: the mean probability that a hard-concrete gate is open, of pair scores (score) at the languages' mean bias (bias).

    Constants out of bounds are an error; so are scores or biases that are none, or not finite.
    """
    if not (beta > 0 and gamma < 0 < 1 < zeta):
        raise ValueError("hard-concrete constants out of bounds")
    bad = lambda df, c: df.agg(F.count("*").alias("n"), F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias("bad")).head()
    for df, c in ((scores, "score"), (bias, "bias")):
        found = bad(df, c)
        if not found["n"] or found["bad"]:
            raise ValueError(f"{c} is empty or not finite")
    mean = bias.agg(F.avg("bias").alias("_b"))
    shift = beta * math.log(-gamma / zeta)
    return scores.join(F.broadcast(mean)).agg(F.avg(sigmoid(F.col("score") + F.col("_b") - shift)).alias("expected_l0"))  # one row


def assignment_entropy(mixture: DataFrame, shares: str = "pi") -> DataFrame:
    """One row: the mean entropy of languages' shares of vocabularies (an array each); null without any."""
    return mixture.agg(F.avg(entropy(shares)).alias("entropy"))


def gate_penalty(rows: DataFrame, gate: str = "gate") -> DataFrame:
    """One row: the mean size of gates, 0 without any."""
    return rows.agg(F.coalesce(F.avg(F.abs(F.col(gate))), F.lit(0.0)).alias("penalty"))


def token_usage(tokens: DataFrame, token: str = "token_id", least: int | None = None) -> DataFrame:
    """(``token``, n): how often each token was used; with ``least``, only ids from there on, as learned ones are."""
    rows = tokens if least is None else tokens.where(F.col(token) >= least)
    return rows.groupBy(token).agg(F.count("*").alias("n"))


def timed(run: Callable[[], object], warm_ups: int = 3, repeats: int = 10) -> list[float]:
    """Seconds of ``repeats`` runs after ``warm_ups`` that do not count; ``run`` writes to a sink, so that all of it is done."""
    if warm_ups < 0 or repeats < 1:
        raise ValueError("at least one run is measured")
    for _ in range(warm_ups):
        run()
    out = []
    for _ in range(repeats):
        began = perf_counter()
        run()
        out.append(perf_counter() - began)
    return out


def mean_probability(pairs: DataFrame, p: str = "p") -> DataFrame:
    return pairs.agg(F.coalesce(F.avg(p), F.lit(0.0)).alias("mean_probability"))
