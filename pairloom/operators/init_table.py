"""First embedding tables: joined models, principal components, and weights by rank."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def concat_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """(token_id, vec) of two tables over one vocabulary; a token that one of them lacks is an error to the caller, who can count."""
    return a.join(b.select("token_id", F.col("vec").alias("_b")), "token_id").select("token_id", F.concat(F.col("vec").cast("array<double>"), F.col("_b").cast("array<double>")).alias("vec"))


def family_table(base: DataFrame, rows: int, markers: int, dims: int) -> DataFrame:
    """The first ``rows`` tokens, then a vector of zeros for each marker."""
    zeros = base.sparkSession.range(rows, rows + markers).select(F.col("id").cast("int").alias("token_id"), F.array_repeat(F.lit(0.0), dims).alias("vec"))
    return base.where(F.col("token_id") < rows).select(F.col("token_id").cast("int"), F.col("vec").cast("array<double>")).unionByName(zeros)


def sif_weights(tokens: DataFrame, a: float = 5e-5, exponent: float = 1.0) -> DataFrame:
    """(token_id, weight): ``a / (a + p)`` with p Zipf's share of the token's rank, which is its place in the table."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("token_id"))  # one row per token of a vocabulary
    ranked = tokens.select("token_id", F.pow(rank.cast("double"), F.lit(-exponent)).alias("_z"))
    share = F.col("_z") / F.sum("_z").over(Window.partitionBy(F.lit(0)))
    return ranked.select("token_id", (a / (a + share)).alias("weight"))


def moments(table: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sum and matrix of products, added up in the tasks: ``dims`` squared numbers per partition reach the driver."""

    def run(batches):
        n, s, m = 0, np.zeros(dims), np.zeros((dims, dims))
        for b in batches:
            x = np.stack(b["vec"].map(np.asarray)).astype(float) if len(b) else np.zeros((0, dims))
            n, s, m = n + len(x), s + x.sum(axis=0), m + x.T @ x
        yield pd.DataFrame({"row": range(dims), "n": n, "s": s, "m": list(m)})

    parts = table.select("vec").where("vec IS NOT NULL").mapInPandas(run, "row int, n long, s double, m array<double>")
    sums = parts.groupBy("row").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.array(*[F.sum(F.col("m")[i]) for i in range(dims)]).alias("m"))
    rows = sorted(sums.collect(), key=lambda r: r["row"])
    return rows[0]["n"], np.array([r["s"] for r in rows]), np.array([r["m"] for r in rows])


def initial_table(table: DataFrame, dims: int, target: int, a: float = 5e-5, exponent: float = 1.0) -> DataFrame:
    """(token_id, vec): projections on ``target`` principal components after the leading hundredth is dropped, times the weight by rank."""
    drop = math.ceil(target / 100)
    n, s, m = moments(table, dims)
    if target + drop > min(dims, n):
        raise ValueError("too few dimensions or rows")
    mean = s / n
    values, vectors = np.linalg.eigh((m - n * np.outer(mean, mean)) / max(1, n - 1))
    kept = vectors[:, np.argsort(-values, kind="stable")[drop : drop + target]]
    kept = kept * np.where(kept[np.abs(kept).argmax(axis=0), np.arange(target)] < 0, -1.0, 1.0)  # one of two equal signs

    def run(batches):
        for b in batches:
            x = np.stack(b["vec"].map(np.asarray)).astype(float) - mean
            yield pd.DataFrame({"token_id": b["token_id"], "vec": list((x @ kept) * b["weight"].to_numpy()[:, None])})

    weighted = table.select("token_id", "vec").join(sif_weights(table, a, exponent), "token_id")
    return weighted.mapInPandas(run, f"token_id {dict(table.dtypes)['token_id']}, vec array<double>")
