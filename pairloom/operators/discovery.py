"""Utility and frequency of token pairs: exact by group-by, and the bounded observers in the order of their calls."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import SKETCH_A, SKETCH_B, SKETCH_SIGN


def utility(p: str = "p", gradient: str = "grad") -> Column:
    return -F.col(p) * F.col(gradient)


def finite(x: str) -> Column:
    return F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(F.col(x)) < float("inf"))


def by_pair_language(obs: DataFrame, value: str = "utility", p: str = "p") -> DataFrame:
    """(pair_key, lang_idx, utility, probability_sum, support, positive_support) of observations; values that are not finite do not count."""
    rows = obs.where(finite(value) & F.col("pair_key").isNotNull() & F.col("lang_idx").isNotNull())
    u = F.col(value)
    return rows.groupBy("pair_key", "lang_idx").agg(F.sum(u).alias("utility"), F.sum(p).alias("probability_sum"), F.count("*").alias("support"), F.count_if(u > 0).alias("positive_support"))


def once(records: DataFrame, record: str = "record_id") -> DataFrame:
    """Usable window records: none of key, language, utility and support null, a repeated record counted once."""
    usable = records.where("pair_key IS NOT NULL AND lang_idx IS NOT NULL AND utility IS NOT NULL AND support IS NOT NULL")
    kept = [c for c in ("window_id", "pair_key", "lang_idx", "utility", "probability_sum", "support", "positive_support") if c in records.columns]
    return usable.groupBy(record).agg(F.min(F.struct(*kept)).alias("r")).select(record, "r.*")


def merge_records(records: DataFrame, *by: str) -> DataFrame:
    """Records of one pair and language, and of one ``by``, added up."""
    return records.groupBy(*by, "pair_key", "lang_idx").agg(*[F.sum(c).alias(c) for c in ("utility", "probability_sum", "support", "positive_support")])


def roll_up(records: DataFrame, *by: str) -> DataFrame:
    """Per pair: utility, probability_sum, support, positive_support, language_count, mean_probability."""
    out = records.groupBy(*by, "pair_key").agg(
        *[F.sum(c).alias(c) for c in ("utility", "probability_sum", "support", "positive_support")], F.count_distinct("lang_idx").alias("language_count")
    )
    return out.withColumn("mean_probability", F.when(F.col("support") > 0, F.col("probability_sum") / F.col("support")))


def with_languages(records: DataFrame) -> DataFrame:
    """Nested view: one row per pair with its languages in order."""
    entry = F.struct("lang_idx", "utility", "probability_sum", "support", "positive_support")
    return records.groupBy("pair_key").agg(F.array_sort(F.collect_list(entry)).alias("languages"))


def first_ranked(sums: DataFrame, top: int) -> DataFrame:
    """Of each call's (pair, language) sums the ``top`` of greatest size, ties by the smaller key."""
    at = F.row_number().over(Window.partitionBy("call_id").orderBy(F.desc(F.abs("utility")), "pair_key", "lang_idx"))
    return sums.withColumn("_at", at).where(F.col("_at") <= top).drop("_at")


def top_per_call(obs: DataFrame, top: int, value: str = "utility", p: str = "p") -> DataFrame:
    """Per call the ``top`` (pair, language) sums of greatest size, ties by the smaller key, added up over the calls."""
    rows = obs.where(finite(value))
    sums = rows.groupBy("call_id", "pair_key", "lang_idx").agg(F.sum(value).alias("utility"), F.sum(p).alias("probability_sum"), F.count("*").alias("support"))
    return first_ranked(sums, top).groupBy("pair_key", "lang_idx").agg(*[F.sum(c).alias(c) for c in ("utility", "probability_sum", "support")])


def pressure(obs: DataFrame, top: int) -> DataFrame:
    """One row: groups seen per call, and those beyond ``top`` that a bounded observer would not transfer."""
    per_call = obs.groupBy("call_id").agg(F.count_distinct("pair_key", "lang_idx").alias("n"))
    return per_call.agg(F.sum("n").alias("unique_groups"), F.sum(F.greatest(F.col("n") - top, F.lit(0))).alias("dropped"))


def top_pairs(pairs: DataFrame, k: int, support: str = "support") -> DataFrame:
    """The ``k`` pairs of greatest support, ties by the smaller key, and in ``next_support`` that of the first one left out."""
    ranked = pairs.orderBy(F.desc(support), "pair_key").limit(k + 1)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(support), "pair_key")  # over k + 1 rows
    out = ranked.withColumn("rank", F.row_number().over(order)).withColumn("_next", F.when(F.col("rank") == k + 1, F.col(support)))
    out = out.withColumn("next_support", F.max("_next").over(Window.partitionBy(F.lit(0))))
    return out.where(F.col("rank") <= k).drop("_next")


def _cells(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and signs of keys, three rows each, with 64-bit arithmetic that wraps."""
    with np.errstate(over="ignore"):
        wide = keys.astype("int64")
        buckets = np.stack([(wide * np.int64(a) + np.int64(b)) % np.int64(width) for a, b in zip(SKETCH_A, SKETCH_B)])
        signs = np.stack([((wide * np.array(s, "uint64").astype("int64") + np.int64(b)) & 1) * 2 - 1 for s, b in zip(SKETCH_SIGN, SKETCH_B)])
    return buckets, signs


@dataclass
class BoundedObserver:
    """Utility or frequency of pairs in fixed memory, in the order of the calls.

    Each call sums its observations, passes on the ``top`` of greatest size and updates a sketch, which sees everything.
    Kept keys add what they get; a new key is let in while there is room, or in place of the least kept one if its
    estimate from the sketch is greater. This is sequential by nature and runs where its calls do, per stream; the exact
    group-bys above are the distributed form.
    """

    capacity: int
    top: int
    languages: int = 1
    frequency: bool = False
    kept: dict[int, list] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("unique", "dropped", "transferred", "retained", "free", "replaced", "rejected"), 0))

    def __post_init__(self):
        self.width = max(64, self.capacity)
        self.cells = np.zeros((3, self.width))
        self.heap: list[tuple] = []

    def _rank(self, key: int) -> tuple:
        u, _, n = self.kept[key]
        return (n, -key) if self.frequency else (u, n, -key)

    def observe(self, pair_keys, lang_idx=None, p=None, gradient=None) -> None:
        keys = np.asarray(pair_keys, "int64")
        if self.frequency:
            groups, counts = np.unique(keys, return_counts=True)
            sums, mass = counts.astype(float), np.zeros(len(groups))
        else:
            lang, prob = np.asarray(lang_idx, "int64"), np.asarray(p, float)
            value = -prob * np.asarray(gradient, float)
            good = np.isfinite(value)
            groups, at = np.unique(keys[good] * self.languages + lang[good], return_inverse=True)
            sums, mass, counts = np.bincount(at, value[good], len(groups)), np.bincount(at, prob[good], len(groups)), np.bincount(at, minlength=len(groups))
        self.counters["unique"] += len(groups)
        order = np.lexsort((groups, -np.abs(sums)))[: self.top]
        self.counters["dropped"] += max(0, len(groups) - self.top)
        self.counters["transferred"] += len(order)
        buckets, signs = _cells(groups, self.width)
        for d in range(3):
            np.add.at(self.cells[d], buckets[d], sums if self.frequency else sums * signs[d])
        seen = self.cells[np.arange(3)[:, None], buckets]
        estimates = seen.min(axis=0) if self.frequency else np.median(seen * signs, axis=0)
        chosen = sorted(order, key=lambda i: groups[i])
        for i in chosen:
            key = int(groups[i])
            if key in self.kept:
                entry = self.kept[key]
                entry[0] += 0.0 if self.frequency else float(sums[i])
                entry[1] += float(mass[i])
                entry[2] = max(entry[2], int(estimates[i])) if self.frequency else entry[2] + int(counts[i])
                heapq.heappush(self.heap, (self._rank(key), key))
                self.counters["retained"] += 1
        new = [i for i in chosen if int(groups[i]) not in self.kept]
        for i in sorted(new, key=lambda i: (-estimates[i], -counts[i], groups[i])):
            self._admit(int(groups[i]), 0.0 if self.frequency else float(sums[i]), float(mass[i]), int(estimates[i]) if self.frequency else int(counts[i]), float(estimates[i]))

    def _admit(self, key: int, value: float, mass: float, count: int, estimate: float) -> None:
        if len(self.kept) < self.capacity:
            self.counters["free"] += 1
        else:
            while self.heap[0][1] not in self.kept or self.heap[0][0] != self._rank(self.heap[0][1]):
                heapq.heappop(self.heap)
            least = self.heap[0][1]
            if ((estimate, -key) if self.frequency else (estimate, count, -key)) <= self._rank(least):
                self.counters["rejected"] += 1
                return
            heapq.heappop(self.heap)
            del self.kept[least]
            self.counters["replaced"] += 1
        self.kept[key] = [value, mass, count]
        heapq.heappush(self.heap, (self._rank(key), key))

    def snapshot(self) -> list[dict]:
        """Records in the order of their composite keys."""
        out = []
        for key in sorted(self.kept):
            u, mass, n = self.kept[key]
            pair, lang = (key, -1) if self.frequency else divmod(key, self.languages)
            out.append({"composite_key": key, "pair_key": pair, "lang_idx": lang, "utility": u, "probability_sum": mass, "support": n})
        return out

    def state(self) -> dict:
        return {"capacity": self.capacity, "top": self.top, "languages": self.languages, "frequency": self.frequency, "kept": {k: list(v) for k, v in self.kept.items()}, "cells": self.cells.tolist()}

    @classmethod
    def load(cls, state: dict) -> BoundedObserver:
        out = cls(state["capacity"], state["top"], state["languages"], state["frequency"])
        out.kept = {int(k): list(v) for k, v in state["kept"].items()}
        out.cells = np.array(state["cells"])
        if out.cells.shape != (3, out.width) or len(out.kept) > out.capacity:
            raise ValueError("the state does not fit its settings")
        out.heap = [(out._rank(k), k) for k in out.kept]
        heapq.heapify(out.heap)
        return out
