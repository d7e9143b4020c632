"""Sentence vectors from token vectors: a registry of pooling modes.

Tokens come as rows (sent_id, pos, lang_idx, token_id) or, best, as one row per sentence (sent_id, lang_idx, token_ids).
Vectors are arrays of numbers. Tokens are counted per sentence before any vector is joined to them. A table of vectors of
checked size goes to every worker and is multiplied in Arrow batches, so that no vector is ever shuffled; a larger one is
joined, and sums are taken per dimension by Spark's own aggregation, which combines them before the shuffle. Tokens
without a vector have no part in a mean.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import MIX_A, MIX_B, pair_hash, pair_key
from ..functions.stats import divide, dot, l2_normalize, sigmoid, softmax, sum_vectors

SENT = ["sent_id", "lang_idx"]
LEAST_COLLAPSE, LEAST_WEIGHT = 1e-3, 1e-6


#: Bytes of a table of vectors that goes to every worker whole.
MOST_TABLE_BYTES = 128 << 20


def long_form(tokens: DataFrame) -> DataFrame:
    """Rows (sent_id, lang_idx, pos, token_id) of either form of tokens."""
    return tokens.select(*SENT, F.posexplode("token_ids").alias("pos", "token_id")) if "token_ids" in tokens.columns else tokens


def _counted(tokens: DataFrame) -> DataFrame:
    """(sent_id, lang_idx, token_id, _c): how often a token stands in a sentence."""
    return long_form(tokens).groupBy(*SENT, "token_id").agg(F.count("*").alias("_c"))


def lookup(tokens: DataFrame, table: DataFrame, on: str | list[str] = "token_id") -> DataFrame:
    return tokens.join(table, on)


def _pool(rows: DataFrame, vector: str, dims: int, weight: Column | None = None, least: float = 1.0) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    out = rows.withColumn("_w", w).groupBy(*SENT).agg(sum_vectors(vector, dims, "_w").alias("_sum"), F.sum("_w").alias("_den"))
    return out.select(*SENT, divide("_sum", "_den", least).alias("h"))


#: Bytes of a pair that names its vector: key, score and place of the vector.
PAIR_BYTES = 20


def _fits(dims: int, *tables: DataFrame | None, pairs: DataFrame | None = None) -> bool:
    """Whether tables of vectors, and ``pairs`` that name theirs, are small enough together to go to every worker."""
    size = 8 * dims * sum(t.count() for t in tables if t is not None)
    return size + (0 if pairs is None else PAIR_BYTES * pairs.count()) <= MOST_TABLE_BYTES


def _matrix(table: DataFrame, key: str, vector: str, dims: int, *more: str) -> tuple[np.ndarray, ...]:
    """(keys in order, their vectors, columns ``more``) of a table that fits; rows without a vector are left out."""
    rows = table.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"), *[F.col(c).cast("double").alias(c) for c in more]).toArrow()
    keys = rows["k"].to_numpy()
    order = np.argsort(keys, kind="stable")
    flat = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(keys), dims)
    return keys[order], flat[order], *[rows[c].to_numpy()[order] for c in more]


def _at(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys among the known ones, and which are known."""
    if not len(known):
        return np.zeros(len(keys), int), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def _pair_table(exact: DataFrame, merged: DataFrame | None, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys in order, scores, places of their vectors, vectors) of compiled pairs; those without a vector are left out."""
    if merged is None:
        keys, vectors, scores = _matrix(exact, "pair_key", "m", dims, "score")
        return keys, scores, np.arange(len(keys), dtype="int32"), vectors
    known, vectors = _matrix(merged, "row", "m", dims)
    rows = exact.select(F.col("pair_key").cast("long"), F.col("score").cast("double"), F.col("row").cast("long")).where("row IS NOT NULL").toArrow()
    keys, scores = rows["pair_key"].to_numpy(), rows["score"].to_numpy()
    at, found = _at(known, rows["row"].to_numpy())
    order = np.argsort(keys, kind="stable")
    order = order[found[order]]
    return keys[order], scores[order], at[order].astype("int32"), vectors


def _shared_table(table: DataFrame, dims: int):
    """(keys, matrix) of (_key, _vec), one row per key, as a broadcast, if the table is small enough to be one; else None."""
    return table.sparkSession.sparkContext.broadcast(_matrix(table, "_key", "_vec", dims)) if _fits(dims, table) else None


def _products(shared):
    """UDF of (keys, weights, shares): the weighted sum of a row's vectors, how many keys have one, and the sum of their shares."""

    def run(keys: pd.Series, weights: pd.Series, shares: pd.Series) -> pd.Series:
        known, matrix = shared.value
        out = np.zeros((len(keys), matrix.shape[1] + 2))
        for row, (k, w, d) in enumerate(zip(keys, weights, shares)):
            if k is None or not len(k):
                continue
            at, found = _at(known, np.asarray(k, "int64"))
            out[row, :-2] = np.asarray(w, float)[found] @ matrix[at[found]]
            out[row, -2] = found.sum()
            out[row, -1] = np.asarray(d, float)[found].sum()
        return pd.Series(list(out))

    return F.pandas_udf(run, "array<double>").asNondeterministic()  # so that a filter of its result does not run it twice


def _ratio(summed: DataFrame, dims: int, least: float) -> DataFrame:
    return summed.where(F.element_at("_s", -2) > 0).select(*SENT, divide(F.slice("_s", 1, dims), F.element_at("_s", -1), least).alias("h"))


def weighted(rows: DataFrame, table: DataFrame, dims: int, least: float) -> DataFrame:
    """(sent_id, lang_idx, h): sum of ``_w`` times the vector of ``_key`` over the sum of ``_d``, of rows (sent_id, lang_idx, _key, _w, _d).

    ``table`` has (_key, _vec), one row per key. Rows whose key it lacks do not count; a sentence with no other has no row.
    """
    shared = _shared_table(table, dims)
    if shared is not None:
        lists = rows.groupBy(*SENT).agg(F.collect_list(F.struct("_key", "_w", "_d")).alias("_l"))
        parts = [F.col(f"_l.{c}") for c in ("_key", "_w", "_d")]
        summed = lists.select(*SENT, _products(shared)(*parts).alias("_s"))
        return _ratio(summed, dims, least)
    few = rows.groupBy(*SENT, "_key").agg(F.sum("_w").alias("_w"), F.sum("_d").alias("_d"))
    out = few.join(table, "_key").groupBy(*SENT).agg(sum_vectors("_vec", dims, "_w").alias("_sum"), F.sum("_d").alias("_den"))
    return out.select(*SENT, divide("_sum", "_den", least).alias("h"))


def mean(tokens, emb, dims, **_) -> DataFrame:
    table = emb.select(F.col("token_id").cast("long").alias("_key"), F.col("vec").alias("_vec"))
    if "token_ids" in tokens.columns:
        shared = _shared_table(table, dims)
        if shared is not None:  # a sentence is one row already: nothing is shuffled
            ones = F.transform("token_ids", lambda x: F.lit(1.0))
            summed = tokens.select(*SENT, _products(shared)(F.col("token_ids").cast("array<long>"), ones, ones).alias("_s"))
            return _ratio(summed, dims, 1.0)
    rows = _counted(tokens).select(*SENT, F.col("token_id").cast("long").alias("_key"), F.col("_c").cast("double").alias("_w"), F.col("_c").cast("double").alias("_d"))
    return weighted(rows, table, dims, 1.0)


def centroid(tokens, emb, dims, centroids, **_) -> DataFrame:
    """Mean less the language's centroid (lang_idx, c)."""
    return mean(tokens, emb, dims).join(centroids, "lang_idx").select(*SENT, F.zip_with("h", "c", lambda a, b: a - b).alias("h"))


def diagonal(tokens, emb, dims, scales, **_) -> DataFrame:
    return mean(tokens, emb, dims).join(scales, "lang_idx").select(*SENT, F.zip_with("h", "s", lambda a, b: a * b).alias("h"))


def lowrank(tokens, emb, dims, factors, **_) -> DataFrame:
    """``h + (h L) R`` with (lang_idx, l, r): arrays of rank rows; ``l[k]`` and ``r[k]`` are vectors."""
    out = mean(tokens, emb, dims).join(factors, "lang_idx").withColumn("_p", F.transform("l", lambda row: dot(F.col("h"), row)))
    delta = F.aggregate(F.zip_with("_p", "r", lambda p, row: F.transform(row, lambda x: x * p)), F.transform("h", lambda x: F.lit(0.0)), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    return out.select(*SENT, F.zip_with("h", delta, lambda a, b: a + b).alias("h"))


def bilinear(tokens, emb, dims, codes, code_dims, readout, **_) -> DataFrame:
    """``h + mean code * readout``: (token_id, code) and (lang_idx, readout: code_dims rows of vectors)."""
    base, code = mean(tokens, emb, dims), mean(tokens, codes.select("token_id", F.col("code").alias("vec")), code_dims).withColumnRenamed("h", "_code")
    out = base.join(code, SENT).join(readout, "lang_idx")
    delta = F.aggregate(F.zip_with("_code", "readout", lambda c, row: F.transform(row, lambda x: x * c)), F.transform("h", lambda x: F.lit(0.0)), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    return out.select(*SENT, F.zip_with("h", delta, lambda a, b: a + b).alias("h"))


def _gate(codes: DataFrame, lang_codes: DataFrame, tokens: DataFrame) -> DataFrame:
    joined = _counted(tokens).join(codes, "token_id").join(lang_codes, "lang_idx")
    return joined.withColumn("_g", 2.0 * sigmoid(dot("code", "lang_code")))


def gate(tokens, emb, dims, codes, lang_codes, **_) -> DataFrame:
    return _pool(lookup(_gate(codes, lang_codes, tokens), emb), "vec", dims, F.col("_g") * F.col("_c"), LEAST_WEIGHT)


def senses(tokens, emb, dims, codes, lang_codes, probes, sense_vectors, code_dims, hard: bool = False, base: Callable | None = None, **more) -> DataFrame:
    """``h + mean of softmax((a * v) probes) senses``; ``probes`` and ``sense_vectors`` are lists of vectors. ``hard`` takes the best sense alone."""
    start = (base or mean)(tokens, emb, dims, codes=codes, lang_codes=lang_codes, **more)
    bound = _gate(codes, lang_codes, tokens).withColumn("_b", F.zip_with("lang_code", "code", lambda a, b: a * b))
    logits = F.array(*[dot(F.col("_b"), F.array(*[F.lit(float(x)) for x in p])) for p in probes])
    bound = bound.withColumn("_l", logits)
    best = F.array_position("_l", F.array_max("_l"))
    weights = F.transform("_l", lambda x, i: F.when(i + 1 == best, 1.0).otherwise(0.0)) if hard else softmax("_l")
    mixed = _pool(bound.withColumn("_w8", weights), "_w8", len(probes), F.col("_c").cast("double")).withColumnRenamed("h", "_m")
    delta = F.array(*[sum((F.col("_m")[k] * float(v[i]) for k, v in enumerate(sense_vectors)), F.lit(0.0)) for i in range(dims)])
    return start.join(mixed, SENT).select(*SENT, F.zip_with("h", delta, lambda a, b: a + b).alias("h"))


def gate_senses(tokens, emb, dims, **more) -> DataFrame:
    return senses(tokens, emb, dims, base=gate, **more)


def split(tokens, emb, dims, rows, gate_value: float = 0.5, **_) -> DataFrame:
    """``(1 - g) E + g row`` where (lang_idx, token_id, row) has one, else ``E``."""
    joined = lookup(_counted(tokens), emb).join(rows, ["lang_idx", "token_id"], "left")
    mixed = F.when(F.col("row").isNull(), F.col("vec").cast("array<double>")).otherwise(F.zip_with("vec", "row", lambda e, r: e * (1 - gate_value) + r * gate_value))
    return _pool(joined.withColumn("vec", mixed), "vec", dims, F.col("_c").cast("double"))


def fuse(tokens, emb, dims, rows, **_) -> DataFrame:
    return split(tokens, emb, dims, rows, 1.0)


def ngram(tokens, emb, dims, table, buckets: int, orders: tuple[int, ...] = (2,), gates: DataFrame | None = None, **_) -> DataFrame:
    """Tokens and hashed n-grams together; with ``gates`` (lang_idx, gate) an n-gram counts by its sigmoid. ``table``: (bucket, row)."""
    from ..functions.keys import ngram_hash

    if not orders or min(orders) < 2 or buckets < 1:
        raise ValueError("orders are 2 or more, buckets 1 or more")
    one = lookup(_counted(tokens), emb).select(*SENT, F.col("vec").cast("array<double>").alias("vec"), F.col("_c").cast("double").alias("_g"))
    for n in orders:
        names = [f"_{k}" for k in range(n)]
        grams = token_grams(tokens, n).groupBy(*SENT, *names).agg(F.count("*").alias("_c"))
        found = grams.withColumn("bucket", ngram_hash(names, buckets)).join(table, "bucket")
        found = found.join(gates, "lang_idx").withColumn("_g", sigmoid("gate") * F.col("_c")) if gates is not None else found.withColumn("_g", F.col("_c").cast("double"))
        one = one.unionByName(found.select(*SENT, F.col("row").cast("array<double>").alias("vec"), "_g"))
    return _pool(one, "vec", dims, F.col("_g"), LEAST_WEIGHT)


def token_grams(tokens: DataFrame, n: int) -> DataFrame:
    """(sent_id, lang_idx, _0, ..., _n-1): every run of ``n`` tokens; from arrays without a shuffle, else by a window."""
    if "token_ids" in tokens.columns:
        t = F.col("token_ids")
        runs = F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.slice(t, i, n)))
        grams = tokens.select(*SENT, F.explode(runs).alias("_gram"))
        return grams.select(*SENT, *[F.col("_gram")[k].alias(f"_{k}") for k in range(n)])
    w = Window.partitionBy("sent_id").orderBy("pos")
    ids = [F.col("token_id"), *[F.lead("token_id", k).over(w) for k in range(1, n)]]
    return tokens.select(*SENT, *[c.alias(f"_{k}") for k, c in enumerate(ids)]).where(F.col(f"_{n - 1}").isNotNull())


def _word_sums(shared, opens: bool):
    """UDF of (keys, words): the sum over a row's words of the means of their vectors, and twice the number of words that have one.
    ``words`` numbers each key's word, or, with ``opens``, tells the keys that open one."""

    def run(keys: pd.Series, words: pd.Series) -> pd.Series:
        known, matrix = shared.value
        out = np.zeros((len(keys), matrix.shape[1] + 2))
        for row, (k, w) in enumerate(zip(keys, words)):
            if k is None or not len(k):
                continue
            at, found = _at(known, np.asarray(k, "int64"))
            w = np.cumsum(np.asarray(w, bool)) if opens else np.asarray(w, "int64")
            _, place, pieces = np.unique(w[found], return_inverse=True, return_counts=True)
            out[row, :-2] = (1.0 / pieces[place]) @ matrix[at[found]]
            out[row, -2:] = len(pieces)
        return pd.Series(list(out))

    return F.pandas_udf(run, "array<double>").asNondeterministic()


def wordpool(tokens, emb, dims, **_) -> DataFrame:
    """Mean over words of the mean over their pieces; ``tokens`` has ``word``, or in arrays ``opens``: whether a token opens one."""
    listed = "token_ids" in tokens.columns
    shared = _shared_table(emb.select(F.col("token_id").cast("long").alias("_key"), F.col("vec").alias("_vec")), dims)
    if shared is not None:
        if listed:
            lists, parts = tokens, (F.col("token_ids").cast("array<long>"), F.col("opens"))
        else:
            lists = tokens.groupBy(*SENT).agg(F.collect_list(F.struct(F.col("token_id").cast("long").alias("k"), F.col("word").cast("long").alias("w"))).alias("_l"))
            parts = (F.col("_l.k"), F.col("_l.w"))
        return _ratio(lists.select(*SENT, _word_sums(shared, listed)(*parts).alias("_s")), dims, 1.0)
    if listed:
        from .tokens import word_ids

        long = tokens.select(*SENT, F.posexplode(F.arrays_zip("token_ids", "opens")).alias("pos", "_x")).select(*SENT, "pos", "_x.token_ids", "_x.opens")
        tokens = word_ids(long.withColumnRenamed("token_ids", "token_id"), "sent_id", F.col("opens"))
    words = lookup(tokens, emb).groupBy(*SENT, "word").agg(sum_vectors("vec", dims).alias("_s"), F.count("*").alias("_n"))
    return _pool(words.select(*SENT, divide("_s", "_n", 1.0).alias("vec")), "vec", dims)


def vocabmoe(tokens, emb, dims, slots, mixture, **_) -> DataFrame:
    """``E + sum of the language's shares times the token's deltas``: (token_id, deltas: vectors) and (lang_idx, pi)."""
    joined = lookup(_counted(tokens), emb).join(slots, "token_id", "left").join(mixture, "lang_idx", "left")
    parts = F.zip_with("pi", "deltas", lambda p, d: F.transform(d, lambda x: x * p))
    delta = F.aggregate(parts, F.transform("vec", lambda x: F.lit(0.0)), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    mixed = F.when(F.col("deltas").isNull() | F.col("pi").isNull(), F.col("vec").cast("array<double>")).otherwise(F.zip_with("vec", delta, lambda a, b: a + b))
    return _pool(joined.withColumn("vec", mixed), "vec", dims, F.col("_c").cast("double"))


def idfpool(tokens, emb, dims, weights, **_) -> DataFrame:
    """Weighted by (lang_idx, token_id, weight); tokens without a weight count 0."""
    w = (F.coalesce(F.col("weight"), F.lit(0.0)) * F.col("_c")).alias("_w")
    joined = _counted(tokens).join(weights, ["lang_idx", "token_id"], "left").select(*SENT, F.col("token_id").cast("long").alias("_key"), w, w.alias("_d"))
    return weighted(joined, emb.select(F.col("token_id").cast("long").alias("_key"), F.col("vec").alias("_vec")), dims, LEAST_WEIGHT)


def adjacent(tokens: DataFrame) -> DataFrame:
    """(sent_id, lang_idx, pos, left, right) of the token rows."""
    after = F.lead("token_id").over(Window.partitionBy("sent_id").orderBy("pos"))
    return tokens.select(*SENT, "pos", F.col("token_id").alias("left"), after.alias("right")).where("right IS NOT NULL")


def edge_codes(emb: DataFrame, left, right, weight) -> DataFrame:
    """(token_id, left_code, right_code) of projections of ``rank`` rows: ``tanh(left e)``, and ``tanh(right e) weight / sqrt(rank)``."""
    left, right, scale = np.asarray(left, float), np.asarray(right, float), np.asarray(weight, float) / np.sqrt(len(weight))

    def run(batches):
        for b in batches:
            x = np.array(b["vec"].tolist(), float).reshape(len(b), left.shape[1])
            yield pd.DataFrame({"token_id": b["token_id"], "left_code": list(np.tanh(x @ left.T)), "right_code": list(np.tanh(x @ right.T) * scale)})

    return emb.select("token_id", "vec").mapInPandas(run, f"token_id {dict(emb.dtypes)['token_id']}, left_code array<double>, right_code array<double>")


def route(pairs: DataFrame, base: int, exact: DataFrame | None = None, hashed: DataFrame | None = None, buckets: int = 0, codes: DataFrame | None = None) -> DataFrame:
    """Pairs with their ``score`` and the key of their row, ``_row``: the exact table (pair_key, score, ...) first (four times the
    pair's key and 1), the hashed one (bucket, score, ...) for those it lacks (four times the bucket and 2). A pair with
    neither is dropped: it is a boundary. With ``codes``, see ``edge_codes``, the product of the two tokens' codes is added
    to the score; a token without a vector has none."""
    keyed = pairs.withColumn("pair_key", pair_key("left", "right", base)).withColumns({"_xs": F.lit(None).cast("double"), "_row": F.lit(None).cast("long")})
    if exact is not None:
        keyed = keyed.drop("_xs", "_row").join(exact.select("pair_key", F.col("score").cast("double").alias("_xs")), "pair_key", "left")
        keyed = keyed.withColumn("_row", F.when(F.col("_xs").isNotNull(), F.col("pair_key") * 4 + 1))
    if hashed is not None:
        keyed = keyed.withColumn("bucket", F.when(F.col("_xs").isNull(), pair_hash("left", "right", buckets))).join(hashed.select("bucket", F.col("score").cast("double").alias("_hs")), "bucket", "left")
        keyed = keyed.withColumn("_row", F.coalesce("_row", F.when(F.col("_hs").isNotNull(), F.col("bucket").cast("long") * 4 + 2))).withColumn("_xs", F.coalesce("_xs", "_hs")).drop("bucket", "_hs")
    keyed = keyed.where("_xs IS NOT NULL")
    if codes is not None:  # once per pair that occurs, however often it does
        side = lambda name: codes.select(F.col("token_id").alias(name), F.col(f"{name}_code").alias(f"_{name}"))
        edges = keyed.select("left", "right").distinct().join(side("left"), "left").join(side("right"), "right").select("left", "right", dot("_left", "_right").alias("_edge"))
        keyed = keyed.join(edges, ["left", "right"]).withColumn("_xs", F.col("_xs") + F.col("_edge")).drop("_edge")
    return keyed.withColumnRenamed("_xs", "score")


def _biased(routed: DataFrame, bias: DataFrame | None, shared_bias: float | None) -> DataFrame:
    if bias is not None and shared_bias is None:
        return routed.join(bias, "lang_idx", "left").withColumn("score", F.col("score") + F.coalesce("bias", F.lit(0.0)))
    return routed.withColumn("score", F.col("score") + shared_bias) if shared_bias is not None else routed


def collapse(tokens, emb, dims, base: int, exact=None, hashed=None, buckets: int = 0, bias: DataFrame | None = None, shared_bias: float | None = None, hard: Callable | None = None, codes: DataFrame | None = None, merged: DataFrame | None = None, **_) -> DataFrame:
    """``N / D``: tokens count 1 less half of what the pairs they are in take, pairs count their gate; ``D`` is tokens less gates.

    The gate is the sigmoid of the pair's score and the language's bias, or ``shared_bias``: it depends on pair and
    language only. So pairs are counted per sentence, routed by their scores alone, and take half their gate from each of
    their two tokens; vectors come in last, once per token or pair of a sentence. With ``hard``, which sets gates of 0 and
    1 that share no token, a pair replaces its tokens, and places are kept.

    ``exact`` has each pair's vector as ``m``, or, where pairs share vectors, names it by ``row`` of ``merged`` (row, m).

    If tokens come as arrays and all tables fit on a worker, the same is done sentence by sentence and nothing is shuffled.
    """
    if "token_ids" in tokens.columns and (_fits(dims, emb, exact, hashed) if merged is None else _fits(dims, emb, merged, hashed, pairs=exact)):
        return _collapse_locally(tokens, emb, dims, base, exact, hashed, buckets, bias, shared_bias, hard is not None, codes, merged)
    if merged is not None:
        exact = exact.join(merged.where("m IS NOT NULL"), "row").drop("row")
    tables = [emb.select((F.col("token_id").cast("long") * 4).alias("_key"), F.col("vec").cast("array<double>").alias("_vec"))]
    if exact is not None:
        tables.append(exact.select((F.col("pair_key") * 4 + 1).alias("_key"), F.col("m").cast("array<double>").alias("_vec")))
    if hashed is not None:
        tables.append(hashed.select((F.col("bucket").cast("long") * 4 + 2).alias("_key"), F.col("m").cast("array<double>").alias("_vec")))
    table = reduce(DataFrame.unionByName, tables)
    taken = 0.5 if hard is None else 1.0
    if hard is None:
        pairs = token_grams(tokens, 2).groupBy(*SENT, F.col("_0").alias("left"), F.col("_1").alias("right")).agg(F.count("*").alias("_c"))
    else:
        pairs = adjacent(long_form(tokens)).withColumn("_c", F.lit(1))
    routed = _biased(route(pairs, base, exact, hashed, buckets, codes), bias, shared_bias).withColumn("p", sigmoid("score"))
    if hard is not None:
        routed = hard(routed)
    p = F.col("p") * F.col("_c")
    zero = F.lit(0.0)
    parts = F.array(
        F.struct(F.col("_row").alias("_key"), p.alias("_w"), (-p).alias("_d")),
        F.struct((F.col("left").cast("long") * 4).alias("_key"), (-taken * p).alias("_w"), zero.alias("_d")),
        F.struct((F.col("right").cast("long") * 4).alias("_key"), (-taken * p).alias("_w"), zero.alias("_d")),
    )
    routed = routed.where("p > 0").select(*SENT, F.explode(parts).alias("_x")).select(*SENT, "_x.*")
    own = long_form(tokens).select(*SENT, (F.col("token_id").cast("long") * 4).alias("_key"), F.lit(1.0).alias("_w"), F.lit(1.0).alias("_d"))
    return weighted(own.unionByName(routed), table, dims, LEAST_COLLAPSE)


def _collapse_locally(tokens, emb, dims, base, exact, hashed, buckets, bias, shared_bias, hard, codes, merged) -> DataFrame:
    from .matching import best_matching

    none = (np.zeros(0, "int64"), np.zeros((0, dims)), np.zeros(0))
    no_pairs = (np.zeros(0, "int64"), np.zeros(0), np.zeros(0, "int32"), np.zeros((0, dims)))
    biases = {r["lang_idx"]: r["bias"] for r in bias.collect()} if bias is not None and shared_bias is None else {}  # one row per language
    sides = None
    if codes is not None:
        rank = codes.select(F.size("left_code")).head()
        rank = rank[0] if rank else 0
        sides = (*_matrix(codes, "token_id", "left_code", rank), _matrix(codes, "token_id", "right_code", rank)[1])
    shared = tokens.sparkSession.sparkContext.broadcast((_matrix(emb, "token_id", "vec", dims), no_pairs if exact is None else _pair_table(exact, merged, dims), none if hashed is None else _matrix(hashed, "bucket", "m", dims, "score"), sides))

    def run(ids: pd.Series, langs: pd.Series) -> pd.Series:
        (known, vectors), (pair_keys, pair_scores, pair_places, pair_rows), (rows, row_vectors, row_scores), edge = shared.value
        out = np.zeros((len(ids), dims + 2))
        for n, (x, lang) in enumerate(zip(ids, langs)):
            if x is None or not len(x):
                continue
            x = np.asarray(x, "int64")
            left, right = x[:-1], x[1:]
            at, hit = _at(pair_keys, left * base + right)
            if buckets:
                bucket_at, bucket_hit = _at(rows, np.abs(left * MIX_A + right * MIX_B) % buckets)
            else:
                bucket_at, bucket_hit = at, np.zeros(len(at), bool)
            bucket_hit &= ~hit
            score = np.full(len(left), -np.inf)
            score[hit], score[bucket_hit] = pair_scores[at[hit]], row_scores[bucket_at[bucket_hit]]
            if edge is not None:
                (a, has_a), (b, has_b) = _at(edge[0], left), _at(edge[0], right)
                both = has_a & has_b
                score[both] += np.einsum("ij,ij->i", edge[1][a[both]], edge[2][b[both]])
                score[~both] = -np.inf
            score += shared_bias if shared_bias is not None else biases.get(lang) or 0.0
            p = best_matching(score).astype(float) if hard else 1.0 / (1.0 + np.exp(-score))
            own, found = _at(known, x)
            w = np.ones(len(x))
            w[:-1] -= p * (1.0 if hard else 0.5)
            w[1:] -= p * (1.0 if hard else 0.5)
            used, in_bucket = hit & (p > 0), bucket_hit & (p > 0)
            out[n, :-2] = w[found] @ vectors[own[found]] + p[used] @ pair_rows[pair_places[at[used]]] + p[in_bucket] @ row_vectors[bucket_at[in_bucket]]
            out[n, -2] = found.sum() + used.sum() + in_bucket.sum()
            out[n, -1] = found.sum() - p[used].sum() - p[in_bucket].sum()
        return pd.Series(list(out))

    summed = tokens.select(*SENT, F.pandas_udf(run, "array<double>").asNondeterministic()(F.col("token_ids").cast("array<long>"), F.col("lang_idx")).alias("_s"))
    return _ratio(summed, dims, LEAST_COLLAPSE)


def _map_pairs(routed: DataFrame) -> DataFrame:
    """Gates of 0 and 1: the best matching of each sentence's scores. Gaps between pairs are boundaries."""
    from .matching import edge_matching

    lists = routed.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "score"))).alias("_e"))
    first = F.col("_e")[0]["pos"]
    lists = lists.withColumn("_f", first).withColumn("_scores", F.map_from_entries("_e")).withColumn("_places", F.sequence(first, F.element_at("_e", -1)["pos"]))
    lists = lists.withColumn("_filled", F.transform("_places", lambda i: F.try_element_at("_scores", i)))
    chosen = lists.select("sent_id", "_f", edge_matching("_filled").alias("_m")).select("sent_id", F.posexplode("_m").alias("_k", "_on"), "_f").where("_on").select("sent_id", (F.col("_f") + F.col("_k")).alias("pos"), F.lit(1.0).alias("_one"))
    return routed.join(chosen, ["sent_id", "pos"], "left").withColumn("p", F.coalesce("_one", F.lit(0.0))).drop("_one")


def collapse_online(tokens, emb, dims, **more) -> DataFrame:
    """Pairs of the best matching replace their tokens; vectors of length 1.

    With ``hashed`` and ``codes``, every pair has a score: of its bucket, its language and the low-rank product of its tokens.
    """
    out = collapse(tokens, emb, dims, hard=_map_pairs, **more)
    return out.select(*SENT, l2_normalize("h").alias("h"))


def collapse_online_compiled(tokens, emb, dims, exact, **more) -> DataFrame:
    """The same from compiled pairs: only those of the exact table have a score, the others are boundaries."""
    return collapse_online(tokens, emb, dims, exact=exact, **{k: v for k, v in more.items() if k not in ("hashed", "buckets", "codes")})


def collapse_reclaimed(tokens, emb, dims, rules, **more) -> DataFrame:
    """Reclaimed tokens (token_id, left, right) are taken apart first, and places closed up."""
    parts = long_form(tokens).join(rules.select("token_id", F.col("left").alias("_l"), F.col("right").alias("_r")), "token_id", "left")
    ids = F.when(F.col("_l").isNull(), F.array("token_id")).otherwise(F.array("_l", "_r"))
    wide = parts.select(*SENT, "pos", F.posexplode(ids).alias("_k", "token_id"))
    at = F.row_number().over(Window.partitionBy("sent_id").orderBy("pos", "_k")) - 1
    return collapse(wide.withColumn("pos", at).drop("_k"), emb, dims, **more)


def collapse_recursive(tokens, emb, dims, rules: list[dict], **more) -> DataFrame:
    """Tokens merged by the rules first; ``emb`` has the merged tokens' vectors too."""
    from .matching import retokenize

    if "token_ids" in tokens.columns:
        lists = tokens.select(*SENT, F.col("token_ids").cast("array<int>").alias("_t"))
    else:
        placed = tokens.groupBy(*SENT).agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("_t"))
        lists = placed.select(*SENT, F.transform("_t", lambda t: t["token_id"].cast("int")).alias("_t"))
    merged = lists.select(*SENT, retokenize("_t", rules).alias("token_ids"))
    return collapse(merged, emb, dims, **more) if "base" in more else mean(merged, emb, dims)


MODES: dict[str, Callable[..., DataFrame]] = {
    "none": mean, "marker": mean, "centroid": centroid, "diag": diagonal, "lowrank": lowrank, "bilinear": bilinear, "senses": senses,
    "hard": lambda *a, **k: senses(*a, hard=True, **k), "gate": gate, "gate_senses": gate_senses, "split": split,
    "ngram": ngram, "ngram3": lambda *a, **k: ngram(*a, orders=(2, 3), **k), "wordpool": wordpool, "ngram_gate": ngram, "fuse": fuse, "vocabmoe": vocabmoe,
    "collapse": collapse, "collapse_shared": collapse, "collapse_dynamic": collapse, "collapse_reclaimed": collapse_reclaimed,
    "collapse_online": collapse_online, "collapse_online_compiled": collapse_online_compiled, "collapse_recursive": collapse_recursive, "idfpool": idfpool,
}


def pool(mode: str, tokens: DataFrame, emb: DataFrame, dims: int, **tables) -> DataFrame:
    """(sent_id, lang_idx, h) under a mode of ``MODES``. ``marker`` expects the marker's row among the tokens."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    return MODES[mode](tokens, emb, dims, **tables)
