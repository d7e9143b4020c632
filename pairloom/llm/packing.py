"""Filling fixed-capacity containers (problem 6): lexical retrieval packing.

Documents are spread over shards of about ``SHARD_ROWS`` by a hash. Each shard builds a BM25 inverted index over the token
ids of its documents. The largest unused document seeds a container; its unused neighbours, best score first, are added
as long as they fit; what room is left is filled with the largest unused documents that still fit. A document larger than
the capacity fills whole containers and its rest is packed like a document. Sizes are those of a public tokenizer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import collect_bounded, materialize

SHARD_ROWS = 2_000
MOST_LIMITS = 1_000
K1, B = 1.2, 0.75


class Index:
    """BM25 inverted index of one shard."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], sizes: np.ndarray):
        self.terms, n = terms, len(terms)
        flat = np.concatenate(terms) if n else np.zeros(0, "int64")
        doc = np.repeat(np.arange(n), [len(t) for t in terms])
        tf = (np.concatenate(counts) if n else np.zeros(0)).astype("float32")
        order = np.argsort(flat, kind="stable")
        self.doc = doc[order].astype("int32")
        self.ids, first = np.unique(flat[order], return_index=True)
        self.start = np.append(first, len(flat))
        df = np.diff(self.start)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype("float32")
        norm = K1 * (1 - B + B * sizes / max(sizes.mean(), 1e-9)) if n else sizes
        tf = tf[order]
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])
        self.n = n
        self.near: dict[int, np.ndarray] = {}

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents that share a term with ``seed``, best score first, itself included. Kept, as each capacity asks again."""
        if seed not in self.near:
            score = self.scores(seed)
            found = np.flatnonzero(score > 0)
            self.near[seed] = found[np.argsort(-score[found], kind="stable")].astype("int32")
        return self.near[seed]

    def scores(self, seed: int) -> np.ndarray:
        at = np.searchsorted(self.ids, self.terms[seed])
        spans = [slice(self.start[i], self.start[i + 1]) for i in at]
        if not spans:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)


def fill(index: Index, sizes: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Containers of one shard as lists of (document, first token, tokens)."""
    containers = []
    left = sizes % capacity  # what is packed of each document after its full containers
    left[(sizes > 0) & (sizes <= capacity)] = sizes[(sizes > 0) & (sizes <= capacity)]
    for d in np.flatnonzero(sizes > capacity):
        containers += [[(int(d), k * capacity, capacity)] for k in range(sizes[d] // capacity)]
    offset = sizes - left
    order = np.lexsort((np.arange(len(left)), -left))  # largest first
    ranked = left[order]
    unused = ranked > 0
    place = np.empty(len(order), "int64")
    place[order] = np.arange(len(order))
    by_size = -ranked  # ascending
    for rank in range(len(order)):
        if not unused[rank]:
            continue
        seed = int(order[rank])
        unused[rank] = False
        chosen, room = [seed], capacity - int(left[seed])
        smallest = int(ranked[unused][-1]) if room and unused.any() else capacity + 1
        if room >= smallest:
            near = index.neighbours(seed)
            near = near[(left[near] <= room) & unused[place[near]]]
            while len(near):
                pick = int(near[0])
                chosen.append(pick)
                unused[place[pick]] = False
                room -= int(left[pick])
                near = near[1:]
                near = near[left[near] <= room]
            while room > 0:  # the largest unused documents that still fit
                fits = np.flatnonzero(unused[np.searchsorted(by_size, -room, "left") :])
                if not len(fits):
                    break
                r = int(fits[0]) + int(np.searchsorted(by_size, -room, "left"))
                unused[r] = False
                chosen.append(int(order[r]))
                room -= int(ranked[r])
        containers.append([(d, int(offset[d]), int(left[d])) for d in chosen])
    return containers


def pack(sized: DataFrame, limits: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(limit_id, capacity_tokens, container_id, slot, doc_id, first_token, n_tokens), every token of every text once per limit.

    ``sized`` has (doc_id, n_tokens, terms, terms_tf), see ``with_sizes``; documents of no tokens take no room and have no
    row. ``limits`` has (limit_id, capacity_tokens), at most ``MOST_LIMITS`` rows; capacities that are null or not
    positive are left out. Container ids are unique within a limit. A doc_id that occurs twice is two documents.
    """
    caps = collect_bounded(limits.select("limit_id", "capacity_tokens").where("capacity_tokens > 0"), MOST_LIMITS, "the limits")
    caps = sorted((r["limit_id"], r["capacity_tokens"]) for r in caps)
    sized = materialize(sized.where("n_tokens > 0").select("doc_id", "n_tokens", "terms", "terms_tf"))
    shards = max(1, -(-sized.count() // shard_rows))

    def run(shard: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values(["doc_id", "n_tokens"], kind="stable")
        sizes, ids = docs["n_tokens"].to_numpy("int64"), docs["doc_id"].to_numpy()
        index = Index(list(docs["terms"]), list(docs["terms_tf"]), sizes)
        rows = []
        for limit, capacity in caps:
            for k, container in enumerate(fill(index, sizes, capacity)):
                rows += [(limit, capacity, int(shard[0]) << 32 | k, slot, ids[d], first, n) for slot, (d, first, n) in enumerate(container)]
        return pd.DataFrame(rows, columns=["limit_id", "capacity_tokens", "container_id", "slot", "doc_id", "first_token", "n_tokens"])

    schema = "limit_id int, capacity_tokens int, container_id long, slot int, doc_id long, first_token long, n_tokens long"
    shard = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(shards)).alias("shard")
    return sized.select("*", shard).groupBy("shard").applyInPandas(run, schema)


def fill_rates(packed: DataFrame) -> DataFrame:
    """Per limit: containers, tokens, the share of their room that is used, and the fewest containers that could do."""
    out = packed.groupBy("limit_id", "capacity_tokens").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    room = F.col("n_containers") * F.col("capacity_tokens")
    return out.select("*", (F.col("n_tokens") / room).alias("fill_rate"), F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"))
