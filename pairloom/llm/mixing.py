"""Mixing sources to target weights (problem 7): weighted fair queueing.

Every source is a queue of its documents in a shuffled order, which is repeated, shuffled anew, up to the source's cap. A
document's virtual finish time is the number of tokens of its source up to and including it, divided by the source's
target weight. All are sorted by finish time, by ranges, which interleaves the sources in proportion to their weights; the
mixture is what comes before the budget is used up. The sums along the queues come from a sort by ranges as well
(``operators.ranking``), so a source that holds most of the rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import running
from ._common import collect_bounded, materialize

MOST_SOURCES = 100_000


def plan_mixture(tokens: dict[str, int], targets: dict[str, tuple[float, int]], budget: float | None = None) -> dict:
    """Budget, the virtual time at which it is used up, and the passes each source needs.

    Without a ``budget`` it is the greatest at which every source that has tokens reaches its share. With a greater one,
    exhausted sources fall short and the others share what they leave.
    """
    open_ = {s: (w, tokens[s] * r) for s, (w, r) in targets.items() if tokens.get(s) and w and w > 0 and r and r > 0}
    if not open_:
        return {"budget": 0.0, "until": 0.0, "passes": {}}
    ends = sorted((most / w, w, most) for w, most in open_.values())
    total = sum(w for w, _ in open_.values())
    if budget is None:
        until = ends[0][0]
        budget = until * total
    else:
        until, left, spent = 0.0, total, 0.0  # spent: what exhausted sources gave
        for end, w, most in ends:
            until = min((budget - spent) / left, end)
            if until < end:
                break
            left, spent = left - w, spent + most
            if left <= 1e-12:
                break
    passes = {s: min(int(targets[s][1]), int(-(-(until * w) // tokens[s])) or 1) for s, (w, _) in open_.items()}
    return {"budget": float(budget), "until": float(until), "passes": passes}


def mix(sized: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 0) -> DataFrame:
    """The mixture in its order: (position, doc_id, source, pass, n_tokens, virtual_finish, tokens_so_far).

    ``sized`` has (doc_id, source, n_tokens); documents of no tokens and sources without a target take no part. ``targets``
    has (source, target_share, max_repeats), at most ``MOST_SOURCES`` rows; a source named twice is an error. Ties of the
    finish time go by source, document and pass. Rows of one doc_id that occurs twice are two documents.
    """
    spark = sized.sparkSession
    rows = collect_bounded(targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL"), MOST_SOURCES, "the targets")
    goal = {r["source"]: (r["target_share"], r["max_repeats"]) for r in rows}
    if len(goal) < len(rows):
        raise ValueError("a source has two targets")
    named = F.broadcast(spark.createDataFrame([(s,) for s in goal], "source string"))  # at most MOST_SOURCES rows
    sized = materialize(sized.select("doc_id", "source", "n_tokens").where("n_tokens > 0").join(named, "source", "left_semi"))  # tokenized once
    sums = {r["source"]: (r["t"], r["n"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    plan = plan_mixture({s: t for s, (t, _) in sums.items()}, goal, budget)
    chosen = [(s, float(goal[s][0]), k) for s, k in plan["passes"].items()]
    queues = spark.createDataFrame(chosen, "source string, share double, passes int")  # at most MOST_SOURCES rows
    runs = sized.join(F.broadcast(queues), "source").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    runs = runs.withColumn("at", F.xxhash64(F.lit(seed), "pass", "source", "doc_id"))
    queued = materialize(running(runs, ["source", "pass", "at", "doc_id", "n_tokens"], ["n_tokens"]))
    first = queued.groupBy("source").agg(F.min(F.col("n_tokens_so_far") - F.col("n_tokens")).alias("before"))  # one row per source
    queued = queued.join(F.broadcast(first), "source").withColumn("virtual_finish", (F.col("n_tokens_so_far") - F.col("before")) / F.col("share"))
    queued = queued.where(F.col("virtual_finish") <= plan["until"] * (1 + 1e-12)).select("doc_id", "source", "pass", "n_tokens", "virtual_finish")
    placed = running(queued, ["virtual_finish", "source", "doc_id", "pass"], ["n_tokens"], place="position")
    return placed.where(F.col("n_tokens_so_far") <= plan["budget"] * (1 + 1e-9)).select(
        (F.col("position") + 1).alias("position"), "doc_id", "source", F.col("pass").alias("repeat"), "n_tokens", "virtual_finish", F.col("n_tokens_so_far").alias("tokens_so_far")
    )


def shares_reached(mixture: DataFrame, targets: DataFrame, sized: DataFrame) -> DataFrame:
    """One row per target: its share, the share reached, how often its most repeated document was used, and the tokens it could give.

    ``binds`` marks the source (or sources) whose tokens, repeated as often as allowed, run out first at its share: the
    default budget is the greatest at which it still reaches it. A source without rows has a reached share of 0 and does
    not bind; where the mixture is empty, all shares are 0.
    """
    used = mixture.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"), (F.max("repeat") + 1).alias("most_uses"))
    have = sized.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("_have"))
    out = targets.join(used, "source", "left").join(have, "source", "left").na.fill(0, ["n_texts", "n_tokens", "most_uses", "_have"])
    out = out.withColumn("tokens_available", F.col("_have") * F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)))
    every = Window.partitionBy(F.lit(0))  # one row per target
    total, until = F.sum("n_tokens").over(every), F.when((F.col("tokens_available") > 0) & (F.col("target_share") > 0), F.col("tokens_available") / F.col("target_share"))
    return out.withColumn("_until", until).select(
        "source", "target_share", "max_repeats", "n_texts", "n_tokens", F.when(total > 0, F.col("n_tokens") / total).otherwise(0.0).alias("share_reached"), "most_uses", "tokens_available",
        F.coalesce(F.col("_until") == F.min("_until").over(every), F.lit(False)).alias("binds"),
    )
