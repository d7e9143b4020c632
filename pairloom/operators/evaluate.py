"""Cross-lingual evaluation: nearest neighbours, similarity scores, macro averages and paired comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import spread
from ..functions.stats import cosine, euclidean, manhattan
from ..functions.text import eval_language
from ..storage import materialize
from .ranking import running

BLOCK = 4096


def nearest(queries: DataFrame, base: DataFrame, query_id: str, base_id: str, vector: str = "vec", block: int = BLOCK) -> DataFrame:
    """(query id, base id, similarity): for each query the base row of greatest cosine, ties by the smaller id.

    Both sides are cut into blocks of rows; every pair of blocks is one matrix product in one task that passes on one row
    per query. A stated query set against all rows, so nothing of size queries times base is ever a table.
    """
    def blocks(df: DataFrame, key: str, name: str) -> DataFrame:
        n = max(1, -(-df.count() // block))
        kept = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("vec"))
        return kept.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n

    left, n_left = blocks(queries, query_id, "qb")
    right, n_right = blocks(base, base_id, "bb")
    left = left.withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    right = right.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))

    def unit(x: pd.DataFrame) -> np.ndarray:
        m = np.stack(x["vec"].map(np.asarray)).astype(float)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def run(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"q": [], "b": [], "sim": []})
        b = b.sort_values("id", kind="stable")
        sim = np.round(unit(q) @ unit(b).T, 12)
        at = sim.argmax(axis=1)  # the first of equals: the smallest id
        return pd.DataFrame({"q": q["id"].to_numpy(), "b": b["id"].to_numpy()[at], "sim": sim[np.arange(len(q)), at]})

    met = left.groupBy("qb", "bb").cogroup(right.groupBy("qb", "bb")).applyInPandas(run, "q long, b long, sim double")
    best = met.groupBy("q").agg(F.max_by("b", F.struct("sim", -F.col("b"))).alias(base_id), F.max("sim").alias("similarity"))
    return best.withColumnRenamed("q", query_id)


def similarities(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cosine and the negated distances of two vector columns, row by row."""
    return pairs.withColumn("cosine", cosine(a, b)).withColumn("neg_manhattan", -manhattan(a, b)).withColumn("neg_euclidean", -euclidean(a, b))


def matching_scores(answers: DataFrame, gold: str, found: str) -> DataFrame:
    """One row: n, accuracy, and precision, recall and F1 per gold label, averaged by the labels' number of rows.

    A label that is never answered has a precision of 0, a null answer is wrong, a null gold does not count.
    """
    rows = answers.where(F.col(gold).isNotNull()).groupBy(F.col(gold).alias("_g"), F.col(found).alias("_f")).agg(F.count("*").alias("_c"))  # a row per pair of labels
    rows = materialize(rows)
    own = rows.groupBy("_g").agg(F.sum("_c").alias("_n"), F.coalesce(F.sum(F.when(F.col("_g") == F.col("_f"), F.col("_c"))), F.lit(0)).alias("_hit"))
    named = rows.where("_f IS NOT NULL").groupBy(F.col("_f").alias("_g")).agg(F.sum("_c").alias("_m"))
    per = own.join(named, "_g", "left").na.fill(0, ["_m"])
    n, m, hit = F.col("_n"), F.col("_m"), F.col("_hit")
    share = lambda x: F.sum(x) / F.sum(n)
    return per.agg(F.sum(n).alias("n"), share(hit).alias("accuracy"), share(n * F.when(m > 0, hit / m).otherwise(0.0)).alias("precision"), share(hit).alias("recall"), share(n * 2 * hit / (n + m)).alias("f1"))


def correlations(pairs: DataFrame, score: str, gold: str) -> DataFrame:
    """One row: n, Pearson's and Spearman's correlation; equal values share the mean of their ranks. Rows with a null do not count."""
    rows = materialize(pairs.where(F.col(score).isNotNull() & F.col(gold).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(gold).cast("double").alias("g")))

    def ranked(df: DataFrame, c: str) -> DataFrame:
        values = running(df.groupBy(c).agg(F.count("*").alias("_c")), [c], ["_c"])  # a row per distinct value
        ranks = values.select(c, (F.col("_c_so_far") - (F.col("_c") - 1) / 2).alias(f"r_{c}"))
        return df.join(ranks, c)

    return ranked(ranked(rows, "s"), "g").agg(F.count("*").alias("n"), F.corr("s", "g").alias("pearson"), F.corr("r_s", "r_g").alias("spearman"))


SIDES = {"sentence1": 0, "sentence2": 1, "query": 0, "document": 1}


def side_language(languages: str | Column, kind: str, side: str) -> Column:
    """Marker language of one side of a subset whose languages are an array: pairs have one or two, the side picks its own.

    Tasks of one text take the subset's first language whatever the row is in: a row's true language may be what is asked
    for. Null where pairs have none or more than two.
    """
    if kind in ("bitext", "sts", "retrieval") and side not in SIDES:
        raise ValueError(f"unknown side {side}")
    col = F.col(languages) if isinstance(languages, str) else languages
    at = SIDES.get(side, 0)
    n = F.size(col)
    if kind in ("bitext", "sts"):
        picked = F.when(n == 1, F.try_element_at(col, F.lit(1))).when(n == 2, F.try_element_at(col, F.lit(at + 1)))
    elif kind == "retrieval":
        picked = F.when(n == 2, F.try_element_at(col, F.lit(at + 1))).otherwise(F.try_element_at(col, F.lit(1)))
    else:
        picked = F.try_element_at(col, F.lit(1))
    return eval_language(picked)


def main_scores(items: DataFrame, preference: tuple[str, ...] = ("test", "dev", "validation")) -> DataFrame:
    """(task, hf_subset, main_score) of the first split that a task has, by preference, then by name; scores that are not finite do not count."""
    rank = F.lit(len(preference))
    for i, name in reversed(list(enumerate(preference))):
        rank = F.when(F.col("split") == name, F.lit(i)).otherwise(rank)
    good = items.where(F.col("main_score").isNotNull() & ~F.isnan("main_score") & (F.abs("main_score") < float("inf"))).withColumn("_r", F.struct(rank, F.col("split")))
    best = good.withColumn("_best", F.min("_r").over(Window.partitionBy("task"))).where("_r = _best")
    return best.groupBy("task", "hf_subset").agg(F.avg("main_score").alias("main_score"))


def macro(scores: DataFrame) -> DataFrame:
    """(task, score) per task, the mean of its subsets, and the plain mean over tasks as task ``all_tasks``."""
    per_task = scores.groupBy("task").agg(F.avg("main_score").alias("score"))
    return per_task.unionByName(per_task.agg(F.lit("all_tasks").alias("task"), F.avg("score").alias("score")))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(task, hf_subset, diff): differences in points on what both have."""
    on = ["task", "hf_subset"]
    return a.join(b.select(*on, F.col("main_score").alias("_b")), on).select(*on, (100 * (F.col("main_score") - F.col("_b"))).alias("diff"))


def bootstrap(diffs: DataFrame, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """One row: n, mean, win_rate, low and high, the 95 % percentile interval of the mean.

    Subsets are few (hundreds); resamples are rows. Each resample takes n of them by a hash of the seed, the resample and
    the draw; the drawn rows are summed by a join on the place.
    """
    one = Window.partitionBy(F.lit(0)).orderBy("task", "hf_subset")  # over subsets
    placed = diffs.withColumn("place", F.row_number().over(one) - 1)
    n = placed.count()
    total = placed.agg(F.count("*").alias("n"), F.avg("diff").alias("mean"), F.avg((F.col("diff") > 0).cast("double")).alias("win_rate"))
    spark = diffs.sparkSession
    draws = spark.range(resamples).withColumnRenamed("id", "r").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))))
    draws = draws.withColumn("place", F.conv(F.left(spread(seed, "r", "i"), F.lit(12)), 16, 10).cast("long") % max(n, 1))
    means = draws.join(placed.select("place", "diff"), "place").groupBy("r").agg(F.avg("diff").alias("m"))
    means = means.withColumn("at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("m", "r")) - 1)
    low, high = int(0.025 * resamples), int(0.975 * resamples) - 1
    ends = means.agg(F.max(F.when(F.col("at") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("at") == high, F.col("m"))).alias("high"))
    return total.join(F.broadcast(ends))  # a row each


def prune_subsets(scores: str, allowed: list[str]):
    """Array of structs without the entries of subsets that are not allowed; entries of no subset stay."""
    names = F.array(*[F.lit(a) for a in allowed])
    return F.filter(scores, lambda x: x["hf_subset"].isNull() | F.array_contains(names, x["hf_subset"]))
