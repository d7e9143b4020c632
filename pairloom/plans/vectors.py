"""Queries over vectors, evaluation, telemetry and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.keys import key_left, key_right, pair_key
from ..functions.stats import cosine
from ..operators import evaluate, init_table, matching, objective, pooling, telemetry, tokens, transitions
from ..sources import model, sinks
from ..storage import materialize, scratch, spread
from ..streaming import windows
from .corpus import WORD_LIST
from .registry import query, read

DIMS, BASE, BUCKETS = 64, 1 << 20, 128

#: Token ids are digests of the words, modulo the number of vectors, so that both engines can make them.
TOK = f"""nv AS (SELECT count(*) AS nv FROM embeddings), d AS (SELECT doc_id, coalesce(lang_idx, -1) AS lang_idx, {WORD_LIST} AS w FROM documents LEFT JOIN languages ON lang = lang_code),
    p0 AS (SELECT doc_id AS sent_id, lang_idx, unnest(range(len(w))) AS pos, unnest(w) AS token FROM d),
    ids AS (SELECT token, ('0x' || left(md5(token), 7))::BIGINT % nv AS token_id FROM (SELECT DISTINCT token FROM p0), nv), tok AS (SELECT sent_id, lang_idx, pos, token, token_id FROM p0 JOIN ids USING (token)),
    emb AS (SELECT vec_id AS token_id, embedding::DOUBLE[] AS vec, embedding[1]::DOUBLE AS v0, embedding[64]::DOUBLE AS v63, list_sum(embedding::DOUBLE[]) AS vs, list_sum(list_transform(embedding::DOUBLE[], lambda x, i: x * i)) AS vw FROM embeddings)"""
#: First and last element, the sum of all, and the sum weighted by place, of which no other vector has all.
_V = ("v0", "v63", "vs", "vw")
_H = {"v0": ("h0", 5), "v63": ("h63", 5), "vs": ("hsum", 4), "vw": ("hwt", 3)}


def _out(expr: str = "sum(w * {v}) / greatest(sum(w), {least})", least: str = "1") -> str:
    return ", ".join(f"round({expr.format(v=v, least=least)}, {n}) + 0.0 AS {h}" for v, (h, n) in _H.items())


def tok(spark, d, **more):
    """(sent_id, lang_idx, token_ids): a row per document, cut into words once however often it is read. ``more``: arrays of what functions say of each word."""
    langs = read(spark, d, "languages").select(F.col("lang_code").alias("lang"), "lang_idx")
    n = read(spark, d, "embeddings").count()
    ids = F.transform("_w", lambda w: F.conv(F.left(F.md5(w), F.lit(7)), 16, 10).cast("long") % n)
    said = [F.transform("_w", f).alias(name) for name, f in more.items()]
    cut = spread(read(spark, d, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", tokens.words("text").alias("_w"))
    t = cut.select("doc_id", "lang", ids.alias("token_ids"), *said).join(langs, "lang", "left")
    return materialize(t.select(F.col("doc_id").alias("sent_id"), F.coalesce("lang_idx", F.lit(-1)).alias("lang_idx"), "token_ids", *more))


def emb(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("token_id"), F.col("embedding").alias("vec"))


def _few(pooled):
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    weighted = F.transform("h", lambda x, i: x * (i + 1))
    out = {"h0": (F.col("h")[0], 5), "h63": (F.col("h")[63], 5), "hsum": (total("h"), 4), "hwt": (total(weighted), 3)}
    return pooled.select("sent_id", "lang_idx", *[(F.round(x, n) + 0.0).alias(name) for name, (x, n) in out.items()])


_MEAN = f"{TOK}, m AS (SELECT sent_id, lang_idx, avg(v0) AS v0, avg(v63) AS v63, avg(vs) AS vs, avg(vw) AS vw FROM tok JOIN emb USING (token_id) GROUP BY 1, 2)"


@query(f"WITH {TOK} SELECT sent_id, lang_idx, {_out()} FROM (SELECT *, 1.0::DOUBLE AS w FROM tok JOIN emb USING (token_id)) GROUP BY 1, 2")
def mean_pool(spark, d):
    return _few(pooling.pool("none", tok(spark, d), emb(spark, d), DIMS))


@query(f"WITH {_MEAN} SELECT sent_id, m.lang_idx, {_out('m.{v} - e.{v}')} FROM m JOIN emb e ON e.token_id = m.lang_idx")
def centroid_shift(spark, d):
    c = emb(spark, d).select(F.col("token_id").cast("int").alias("lang_idx"), F.col("vec").alias("c"))
    return _few(pooling.pool("centroid", tok(spark, d), emb(spark, d), DIMS, centroids=c))


@query(f"WITH {_MEAN} SELECT sent_id, m.lang_idx, round(m.v0 * e.v0, 5) + 0.0 AS h0, round(m.v63 * e.v63, 5) + 0.0 AS h63 FROM m JOIN emb e ON e.token_id = m.lang_idx")
def diagonal_scale(spark, d):
    s = emb(spark, d).select(F.col("token_id").cast("int").alias("lang_idx"), F.col("vec").alias("s"))
    return _few(pooling.pool("diag", tok(spark, d), emb(spark, d), DIMS, scales=s)).select("sent_id", "lang_idx", "h0", "h63")


#: Whole mean vectors, an element a row first.
_WHOLE = f"""{TOK}, few AS (SELECT sent_id, lang_idx, token_id, count(*) AS c FROM tok GROUP BY ALL), long AS (SELECT sent_id, lang_idx, c, unnest(range(64)) AS i, unnest(vec) AS x FROM few JOIN emb USING (token_id)),
    av AS (SELECT sent_id, lang_idx, i, sum(x * c) / sum(c) AS x FROM long GROUP BY ALL), mv AS (SELECT sent_id, lang_idx, list(x ORDER BY i) AS h FROM av GROUP BY 1, 2)"""


@query(f"""
    WITH {_WHOLE}, p AS (SELECT sent_id, lang_idx, h, list_inner_product(h, l.vec) AS p FROM mv JOIN emb l ON l.token_id = mv.lang_idx),
    o AS (SELECT sent_id, lang_idx, h[1] + p * r.v0 AS v0, h[64] + p * r.v63 AS v63, list_sum(h) + p * r.vs AS vs, list_sum(list_transform(h, lambda x, i: x * i)) + p * r.vw AS vw FROM p JOIN emb r ON r.token_id = p.lang_idx + 1)
    SELECT sent_id, lang_idx, {_out('{v}')} FROM o""")
def lowrank_shift(spark, d):
    e = emb(spark, d)
    l, r = (e.select((F.col("token_id") - k).cast("int").alias("lang_idx"), F.array("vec").alias(name)) for k, name in ((0, "l"), (1, "r")))  # noqa: E741
    return _few(pooling.pool("lowrank", tok(spark, d), e, DIMS, factors=l.join(r, "lang_idx")))


@query(f"""
    WITH {_MEAN} SELECT sent_id, m.lang_idx, {_out('m.{v} + m.v0 * a.{v} + m.v63 * b.{v}')} FROM m JOIN emb a ON a.token_id = m.lang_idx JOIN emb b ON b.token_id = m.lang_idx + 1""")
def bilinear_shift(spark, d):
    e = emb(spark, d)
    a, b = (e.select((F.col("token_id") - k).cast("int").alias("lang_idx"), F.col("vec").alias(name)) for k, name in ((0, "a"), (1, "b")))
    readout = a.join(b, "lang_idx").select("lang_idx", F.array("a", "b").alias("readout"))
    return _few(pooling.pool("bilinear", tok(spark, d), e, DIMS, codes=_codes(spark, d), code_dims=2, readout=readout))


def _seen(t):
    """(lang_idx, token_id) that occur at least twice: where languages have rows of their own."""
    return pooling.long_form(t).groupBy("lang_idx", "token_id").agg(F.count("*").alias("n")).where("n >= 2").drop("n")


_SEEN = "seen AS (SELECT lang_idx, token_id FROM tok GROUP BY 1, 2 HAVING count(*) >= 2)"


@query(f"WITH {TOK}, {_SEEN} SELECT sent_id, lang_idx, {_out(least='0.000001')} FROM (SELECT tok.*, {', '.join(_V)}, CASE WHEN s.token_id IS NULL THEN 0 ELSE 1.0 / (1 + tok.token_id % 10) END AS w FROM tok JOIN emb USING (token_id) LEFT JOIN seen s ON s.lang_idx = tok.lang_idx AND s.token_id = tok.token_id) GROUP BY 1, 2")
def weighted_pool_idf(spark, d):
    t = tok(spark, d)
    w = _seen(t).withColumn("weight", 1.0 / (1 + F.col("token_id") % 10))
    return _few(pooling.pool("idfpool", t, emb(spark, d), DIMS, weights=w))


def _own_rows(spark, d, t):
    e = emb(spark, d)
    own = _seen(t).withColumn("_at", (F.col("token_id") + 7) % e.count())
    return own.join(e.select(F.col("token_id").alias("_at"), F.col("vec").alias("row")), "_at").drop("_at")


def _split_sql(g: float) -> str:
    mix = lambda c: f"CASE WHEN s.token_id IS NULL THEN e.{c} ELSE {1 - g} * e.{c} + {g} * r.{c} END AS {c}"
    joined = "FROM tok t JOIN emb e ON t.token_id = e.token_id LEFT JOIN seen s ON s.lang_idx = t.lang_idx AND s.token_id = t.token_id, nv JOIN emb r ON r.token_id = (t.token_id + 7) % nv"
    return f"WITH {TOK}, {_SEEN} SELECT sent_id, lang_idx, {_out()} FROM (SELECT t.sent_id, t.lang_idx, {', '.join(map(mix, _V))}, 1.0::DOUBLE AS w {joined}) GROUP BY 1, 2"


@query(_split_sql(0.25))
def split_gate_pool(spark, d):
    t = tok(spark, d)
    return _few(pooling.pool("split", t, emb(spark, d), DIMS, rows=_own_rows(spark, d, t), gate_value=0.25))


@query(_split_sql(1.0))
def fuse_pool(spark, d):
    t = tok(spark, d)
    return _few(pooling.pool("fuse", t, emb(spark, d), DIMS, rows=_own_rows(spark, d, t)))


@query(f"""
    WITH {TOK}, mx AS (SELECT t.sent_id, t.lang_idx, {', '.join(f'e.{v} + CASE WHEN s.token_id IS NULL THEN 0 ELSE 0.25 * a.{v} + 0.75 * b.{v} END AS {v}' for v in _V)}, 1.0::DOUBLE AS w
        FROM tok t JOIN emb e ON t.token_id = e.token_id LEFT JOIN (SELECT DISTINCT token_id FROM tok WHERE token_id < {BUCKETS}) s ON s.token_id = t.token_id, nv JOIN emb a ON a.token_id = (t.token_id + 1) % nv JOIN emb b ON b.token_id = (t.token_id + 2) % nv)
    SELECT sent_id, lang_idx, {_out()} FROM mx GROUP BY 1, 2""")
def vocabmoe_pool(spark, d):
    """Tokens with a slot (those of the ``BUCKETS`` smallest ids) add two deltas by their language's shares."""
    e = emb(spark, d)
    n = e.count()
    at = lambda k: e.select(F.pmod(F.col("token_id") - k, F.lit(n)).alias("token_id"), F.col("vec").alias(f"_{k}"))
    slots = at(1).join(at(2), "token_id").where(F.col("token_id") < BUCKETS).select("token_id", F.array("_1", "_2").alias("deltas"))
    mixture = spark.range(-1, 30).select(F.col("id").cast("int").alias("lang_idx"), F.array(F.lit(0.25), F.lit(0.75)).alias("pi"))
    return _few(pooling.pool("vocabmoe", tok(spark, d), e, DIMS, slots=slots, mixture=mixture))


def _ngram_sql(weight: str = "1.0") -> str:
    return f"""
    WITH {TOK}, g AS (SELECT sent_id, lang_idx, token_id AS a, lead(token_id) OVER (PARTITION BY sent_id ORDER BY pos) AS b FROM tok),
    x AS (SELECT sent_id, lang_idx, {', '.join(_V)}, 1.0::DOUBLE AS w FROM tok JOIN emb USING (token_id) UNION ALL
          SELECT sent_id, lang_idx, {', '.join(_V)}, {weight} FROM g JOIN emb ON emb.token_id = ((a * 40503 * 2654435761 + b * 40503 + 1) % {BUCKETS}) WHERE b IS NOT NULL)
    SELECT sent_id, lang_idx, {_out(least='0.000001')} FROM x GROUP BY 1, 2"""


def _bucket_rows(spark, d):
    return emb(spark, d).where(F.col("token_id") < BUCKETS).select(F.col("token_id").alias("bucket"), F.col("vec").alias("row"))


@query(_ngram_sql())
def ngram_pool(spark, d):
    return _few(pooling.pool("ngram", tok(spark, d), emb(spark, d), DIMS, table=_bucket_rows(spark, d), buckets=BUCKETS))


@query(_ngram_sql("1 / (1 + exp(-(lang_idx % 5 - 2) * 0.3))"))
def ngram_gate_pool(spark, d):
    gates = _bias(spark).withColumnRenamed("bias", "gate")
    return _few(pooling.pool("ngram_gate", tok(spark, d), emb(spark, d), DIMS, table=_bucket_rows(spark, d), buckets=BUCKETS, gates=gates))


@query(f"""
    WITH {TOK}, o AS (SELECT *, sum((length(token) >= 4)::INT) OVER (PARTITION BY sent_id ORDER BY pos) AS word FROM tok),
    i AS (SELECT sent_id, lang_idx, word, {', '.join(f'avg({v}) AS {v}' for v in _V)}, 1.0::DOUBLE AS w FROM o JOIN emb USING (token_id) GROUP BY 1, 2, 3) SELECT sent_id, lang_idx, {_out()} FROM i GROUP BY 1, 2""")
def wordpool(spark, d):
    return _few(pooling.pool("wordpool", tok(spark, d, opens=lambda w: F.length(w) >= 4), emb(spark, d), DIMS))


def _codes(spark, d):
    return emb(spark, d).select("token_id", F.array(F.col("vec")[0].cast("double"), F.col("vec")[63].cast("double")).alias("code"))


def _lang_codes(spark):
    return spark.range(-1, 30).select(F.col("id").cast("int").alias("lang_idx"), F.array((F.col("id") + 1) * 0.1, F.lit(1.0)).alias("lang_code"))


_GATED = f"{TOK}, gt AS (SELECT sent_id, lang_idx, {', '.join(_V)}, 2.0 / (1 + exp(-(v0 * (lang_idx + 1) * 0.1 + v63))) AS w FROM tok JOIN emb USING (token_id))"


@query(f"WITH {_GATED} SELECT sent_id, lang_idx, {_out(least='0.000001')} FROM gt GROUP BY 1, 2")
def gate_pool(spark, d):
    return _few(pooling.pool("gate", tok(spark, d), emb(spark, d), DIMS, codes=_codes(spark, d), lang_codes=_lang_codes(spark)))


#: Two senses: all ones, and a ramp. A token's shares follow from its code, bound to the language's.
_SENSES = {"v0": "s0 + s1 / 64", "v63": "s0 + s1", "vs": "64 * s0 + 32.5 * s1", "vw": f"2080 * s0 + {sum(i * i for i in range(1, 65)) / 64} * s1"}


def _senses_sql(share: str, base: str) -> str:
    out = ", ".join(f"round({base.format(v=v)} + {_SENSES[v].replace('s0', 'avg(s)').replace('s1', 'avg(1 - s)')}, {n}) + 0.0 AS {h}" for v, (h, n) in _H.items())
    return f"WITH {_GATED}, sn AS (SELECT *, (v0 * (lang_idx + 1) * 0.1) AS l0, -v63 AS l1 FROM gt), sh AS (SELECT *, {share} AS s FROM sn) SELECT sent_id, lang_idx, {out} FROM sh GROUP BY 1, 2"


def _with_senses(spark, d, mode):
    more = {"probes": [[1.0, 0.0], [0.0, -1.0]], "sense_vectors": [[1.0] * DIMS, [(i + 1) / DIMS for i in range(DIMS)]], "code_dims": 2}
    return _few(pooling.pool(mode, tok(spark, d), emb(spark, d), DIMS, codes=_codes(spark, d), lang_codes=_lang_codes(spark), **more))


@query(_senses_sql("1 / (1 + exp(l1 - l0))", "avg({v})"))
def senses_pool(spark, d):
    return _with_senses(spark, d, "senses")


@query(_senses_sql("(l0 >= l1)::INT", "avg({v})"))
def hard_senses_pool(spark, d):
    return _with_senses(spark, d, "hard")


@query(_senses_sql("1 / (1 + exp(l1 - l0))", "sum(w * {v}) / greatest(sum(w), 0.000001)"))
def gate_senses_pool(spark, d):
    return _with_senses(spark, d, "gate_senses")


def _exact(spark, d, t, least: int = 1):
    """Pair rows of the pairs that occur at least so often: score and merged vector."""
    e = emb(spark, d)
    seen = pooling.token_grams(t, 2).groupBy(F.col("_0").alias("left"), F.col("_1").alias("right")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    seen = seen.withColumn("score", ((F.col("left") + F.col("right")) % 7 - 3) * 0.5).withColumn("_at", (F.col("left") + F.col("right")) % e.count())
    seen = seen.join(e.select(F.col("token_id").alias("_at"), F.col("vec").alias("m")), "_at")
    return seen.select(pair_key("left", "right", BASE).alias("pair_key"), "score", "m")


def _named(t, n: int, least: int):
    """The pairs that occur at least so often: key, score and the id of the vector, of ``n``, that they merge to. Pairs are numbers from the start."""
    ids, rest = F.col("token_ids"), F.greatest(F.size("token_ids") - 1, F.lit(0))
    keys = F.zip_with(F.slice(ids, F.lit(1), rest), F.slice(ids, F.lit(2), rest), lambda a, b: pair_key(a, b, BASE))
    seen = t.select(F.explode(keys).alias("pair_key")).groupBy("pair_key").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    both = key_left("pair_key", BASE) + key_right("pair_key", BASE)
    return seen.select("pair_key", ((both % 7 - 3) * 0.5).alias("score"), (both % n).alias("row"))


def _bias(spark):
    return spark.range(-1, 30).select(F.col("id").cast("int").alias("lang_idx"), ((F.col("id") % 5 - 2) * 0.3).alias("bias"))


_ROUTED = f"{TOK}, g AS (SELECT sent_id, lang_idx, pos, token_id AS a, lead(token_id) OVER (PARTITION BY sent_id ORDER BY pos) AS b, nv FROM tok, nv)"


def _collapse_sql(routed: str, bias: str = "(lang_idx % 5 - 2) * 0.3", routes: str = _ROUTED) -> str:
    columns = ", ".join(_V)
    return f"""
    WITH {routes}, rt AS ({routed}), pr AS (SELECT *, 1 / (1 + exp(-(score + {bias}))) AS p FROM rt),
    tk AS (SELECT sent_id, pos, sum(p) / 2 AS taken FROM (SELECT sent_id, pos, p FROM pr UNION ALL SELECT sent_id, pos + 1, p FROM pr) GROUP BY 1, 2),
    x AS (SELECT t.sent_id, t.lang_idx, {columns}, 1 - coalesce(taken, 0) AS w, 1.0::DOUBLE AS c FROM tok t JOIN emb USING (token_id) LEFT JOIN tk ON tk.sent_id = t.sent_id AND tk.pos = t.pos
          UNION ALL SELECT sent_id, lang_idx, {columns}, p, -p FROM pr JOIN emb ON emb.token_id = pr.m)
    SELECT sent_id, lang_idx, {_out('sum(w * {v}) / greatest(sum(c), 0.001)')} FROM x GROUP BY 1, 2"""


_ALL = "SELECT sent_id, lang_idx, pos, ((a + b) % 7 - 3) * 0.5 AS score, (a + b) % nv AS m FROM g WHERE b IS NOT NULL"


@query(_collapse_sql(_ALL))
def collapse_pool(spark, d):
    t = tok(spark, d)
    return _few(pooling.pool("collapse", t, emb(spark, d), DIMS, base=BASE, exact=_exact(spark, d, t), bias=_bias(spark)))


@query(_collapse_sql(_ALL, "0.2"))
def collapse_shared(spark, d):
    t = tok(spark, d)
    return _few(pooling.pool("collapse_shared", t, emb(spark, d), DIMS, base=BASE, exact=_exact(spark, d, t), shared_bias=0.2))


def _hashed(spark, d):
    return emb(spark, d).where(F.col("token_id") < BUCKETS).select(F.col("token_id").alias("bucket"), ((F.col("token_id") % 5 - 2) * 0.4).alias("score"), F.col("vec").alias("m"))


_TIERS = f"{_ROUTED}, often AS (SELECT a, b FROM g WHERE b IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)"


@query(_collapse_sql(f"""{_ALL} AND EXISTS (SELECT 1 FROM often o WHERE o.a = g.a AND o.b = g.b) UNION ALL SELECT sent_id, lang_idx, pos, (k % 5 - 2) * 0.4, k
    FROM (SELECT *, abs(a * 2654435761 + b * 40503) % {BUCKETS} AS k FROM g WHERE b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM often o WHERE o.a = g.a AND o.b = g.b))""", routes=_TIERS))
def collapse_two_tier(spark, d):
    """Pairs that occur once are not in the exact table and share hashed rows."""
    t = tok(spark, d)
    return _few(pooling.pool("collapse_dynamic", t, emb(spark, d), DIMS, base=BASE, exact=_exact(spark, d, t, 2), hashed=_hashed(spark, d), buckets=BUCKETS, bias=_bias(spark)))


def _reclaimed(spark, d):
    """Of the smallest ids every eighth is reclaimed for the two after it."""
    return spark.range(0, BUCKETS, 8).select(F.col("id").alias("token_id"), (F.col("id") + 1).alias("left"), (F.col("id") + 2).alias("right"))


_TAKEN_APART = f"token_id < {BUCKETS} AND token_id % 8 = 0"
_WIDE = f"""{TOK.replace('tok AS (', 'tok0 AS (')}, wide AS (SELECT sent_id, lang_idx, pos, 0 AS k, CASE WHEN {_TAKEN_APART} THEN token_id + 1 ELSE token_id END AS token_id FROM tok0 UNION ALL SELECT sent_id, lang_idx, pos, 1, token_id + 2 FROM tok0 WHERE {_TAKEN_APART}),
    tok AS (SELECT sent_id, lang_idx, row_number() OVER (PARTITION BY sent_id ORDER BY pos, k) - 1 AS pos, token_id FROM wide), g AS (SELECT sent_id, lang_idx, pos, token_id AS a, lead(token_id) OVER (PARTITION BY sent_id ORDER BY pos) AS b, nv FROM tok, nv)"""


@query(_collapse_sql(f"SELECT sent_id, lang_idx, pos, (k % 5 - 2) * 0.4 AS score, k AS m FROM (SELECT *, abs(a * 2654435761 + b * 40503) % {BUCKETS} AS k FROM g WHERE b IS NOT NULL)", routes=_WIDE))
def collapse_reclaimed(spark, d):
    return _few(pooling.pool("collapse_reclaimed", tok(spark, d), emb(spark, d), DIMS, base=BASE, rules=_reclaimed(spark, d), hashed=_hashed(spark, d), buckets=BUCKETS, bias=_bias(spark)))


@query()
def collapse_recursive(spark, d):
    """Merges of one generation first: the pairs that occur most, with vectors of the ids after the last."""
    e, t = emb(spark, d), tok(spark, d)
    n = e.count()
    often = pooling.token_grams(t, 2).groupBy(F.col("_0").alias("l"), F.col("_1").alias("r")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "l", "r").limit(200).collect()
    rules = [{"token_id": n + k, "left": x["l"], "right": x["r"], "generation": 1, "active": True, "span": [x["l"], x["r"]]} for k, x in enumerate(often)]
    merged = e.where(F.col("token_id") < len(rules)).select((F.col("token_id") + n).alias("token_id"), "vec")
    return _few(pooling.pool("collapse_recursive", t, e.unionByName(merged), DIMS, rules=rules, base=BASE, hashed=_hashed(spark, d), buckets=BUCKETS, bias=_bias(spark)))


def _projections(spark, d):
    rng, rank = np.random.default_rng(7), 32
    left, right = rng.uniform(-1, 1, (2, rank, DIMS)) * np.sqrt(6 / (rank + DIMS))
    return pooling.edge_codes(emb(spark, d), left, right, rng.normal(size=rank))


@query()
def collapse_online(spark, d):
    """Every pair has a score; projections and weights of rank 32 are drawn with a fixed seed, in the bounds of their first values."""
    return _few(pooling.pool("collapse_online", tok(spark, d), emb(spark, d), DIMS, base=BASE, hashed=_hashed(spark, d), buckets=BUCKETS, codes=_projections(spark, d), bias=_bias(spark)))


@query()
def collapse_online_compiled(spark, d):
    """Only pairs that occur at least twice were compiled; the others are boundaries."""
    t, e = tok(spark, d), emb(spark, d)
    exact = materialize(_named(t, e.count(), 2))
    merged = e.select(F.col("token_id").alias("row"), F.col("vec").alias("m"))
    return _few(pooling.pool("collapse_online_compiled", t, e, DIMS, base=BASE, exact=exact, merged=merged, bias=_bias(spark)))


def _edges(spark, d):
    """(doc_id, scores): scores of the edges between neighbouring words, from digests of the words."""
    ids = F.transform(tokens.words("text"), lambda w: F.conv(F.left(F.md5(w), F.lit(7)), 16, 10).cast("long"))
    least = F.greatest(F.size("ids") - 1, F.lit(0))
    scores = F.zip_with(F.slice("ids", F.lit(1), least), F.slice("ids", F.lit(2), least), lambda a, b: ((a + 3 * b) % 11 - 5) * 0.3)
    return spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", ids.alias("ids")).where("size(ids) > 0").select("doc_id", scores.alias("scores"))


_SCORED = f"""w AS (SELECT doc_id, list_transform({WORD_LIST}, lambda x: ('0x' || left(md5(x), 7))::BIGINT) AS ids FROM documents),
    e AS (SELECT doc_id, list_transform(range(1, len(ids)), lambda i: ((ids[i] + 3 * ids[i + 1]) % 11 - 5) * 0.3::DOUBLE) AS s FROM w WHERE len(ids) > 0)"""


@query(f"""
    WITH {_SCORED}, r AS (SELECT doc_id, len(s) AS n_edges, list_reduce(list_prepend({{'b0': 0.0::DOUBLE, 'b1': 0.0::DOUBLE, 'n0': 0, 'n1': 0, 's': 0.0::DOUBLE}}, list_transform(s, lambda x: {{'b0': 0.0::DOUBLE, 'b1': 0.0::DOUBLE, 'n0': 0, 'n1': 0, 's': x::DOUBLE}})),
        lambda a, x: {{'b0': a.b1, 'b1': CASE WHEN a.b0 + x.s > a.b1 THEN a.b0 + x.s ELSE a.b1 END, 'n0': a.n1, 'n1': CASE WHEN a.b0 + x.s > a.b1 THEN a.n0 + 1 ELSE a.n1 END, 's': 0.0::DOUBLE}}) AS m FROM e)
    SELECT doc_id, n_edges::INT AS n_edges, m.n1 AS n_merged FROM r""")
def map_matching(spark, d):
    m = _edges(spark, d).select("doc_id", matching.edge_matching("scores").alias("m"))
    return m.select("doc_id", F.size("m").alias("n_edges"), F.size(F.filter("m", lambda x: x)).alias("n_merged"))


@query(f"""
    WITH {_SCORED}, r AS (SELECT doc_id, list_reduce(list_prepend({{'p': 0.0::DOUBLE, 'q': 0.0::DOUBLE, 's': 0.0::DOUBLE}}, list_transform(s, lambda x: {{'p': 0.0::DOUBLE, 'q': 0.0::DOUBLE, 's': x::DOUBLE}})),
        lambda a, x: {{'p': a.q, 'q': greatest(a.q, a.p + x.s) + ln(1 + exp(-abs(a.q - a.p - x.s))), 's': 0.0::DOUBLE}}) AS z FROM e) SELECT doc_id, round(z.q, 6) AS log_z FROM r""")
def log_partition(spark, d):
    return _edges(spark, d).select("doc_id", F.round(matching.log_normalizer("scores"), 6).alias("log_z"))


@query(f"""
    WITH {_SCORED}, r AS (SELECT doc_id, list_reduce(list_prepend({{'p': 0.0::DOUBLE, 'q': 0.0::DOUBLE, 'm': 0.0::DOUBLE, 'n': 0.0::DOUBLE, 's': 0.0::DOUBLE}}, list_transform(s, lambda x: {{'p': 0.0::DOUBLE, 'q': 0.0::DOUBLE, 'm': 0.0::DOUBLE, 'n': 0.0::DOUBLE, 's': x::DOUBLE}})),
        lambda a, x: {{'p': a.q, 'q': greatest(a.q, a.p + x.s) + ln(1 + exp(-abs(a.q - a.p - x.s))), 'm': a.n, 'n': a.n + (a.m + 1 - a.n) / (1 + exp(a.q - a.p - x.s)), 's': 0.0::DOUBLE}}) AS z FROM e) SELECT doc_id, round(z.n, 6) AS expected FROM r""")
def expected_merges(spark, d):
    """The sum of the edges' marginals: how many merges a text has on average over its matchings."""
    m = _edges(spark, d).select("doc_id", matching.edge_marginals("scores").alias("m"))
    return m.select("doc_id", F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x), 6).alias("expected"))


@query(f"""
    WITH w AS (SELECT doc_id, list_transform({WORD_LIST}, lambda x: ('0x' || left(md5(x), 7))::BIGINT % 1000) AS ids FROM documents),
    r AS (SELECT doc_id, list_reduce(list_prepend({{'p': -1::BIGINT, 'n': 0, 'x': -1::BIGINT}}, list_transform(ids, lambda x: {{'p': -1::BIGINT, 'n': 0, 'x': x}})),
        lambda a, x: CASE WHEN a.p >= 0 AND (a.p + x.x) % 5 = 0 THEN {{'p': -1::BIGINT, 'n': a.n + 1, 'x': 0::BIGINT}} ELSE {{'p': x.x, 'n': a.n + CASE WHEN a.p >= 0 THEN 1 ELSE 0 END, 'x': 0::BIGINT}} END) AS z FROM w)
    SELECT doc_id, (z.n + CASE WHEN z.p >= 0 THEN 1 ELSE 0 END)::INT AS n_tokens FROM r""")
def retokenize(spark, d):
    """Rules for every fifth sum of two ids; merges go from the left and do not overlap."""
    rules = [{"token_id": 1000 + 1000 * a + b, "left": a, "right": b, "generation": 1, "active": True, "span": [a, b]} for a in range(1000) for b in range(-a % 5, 1000, 5)]
    ids = F.transform(tokens.words("text"), lambda w: (F.conv(F.left(F.md5(w), F.lit(7)), 16, 10).cast("long") % 1000).cast("int"))
    return spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", matching.retokenize(ids, rules).alias("t")).select("doc_id", F.size("t").alias("n_tokens"))


def _batches(spark, d):
    """Batches of 256 neighbouring vectors, each with the one of the next id but one for its partner."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    both = e.select("vec_id", F.col("embedding").alias("anchor")).join(e.select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("positive")), "vec_id")
    return both.select(F.floor(F.col("vec_id") / 256).alias("batch_id"), (F.col("vec_id") % 256).cast("int").alias("slot"), "anchor", "positive")


_PAIRED = "bt AS (SELECT a.vec_id // 256 AS batch_id, a.vec_id % 256 AS slot, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS p FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 2)"


@query(f"""
    WITH {_PAIRED}, sc AS (SELECT x.batch_id, x.slot AS i, y.slot AS j, 17 * list_cosine_similarity(x.a, y.p) AS s FROM bt x JOIN bt y USING (batch_id)),
    rz AS (SELECT batch_id, i, ln(sum(exp(s))) AS z FROM sc GROUP BY 1, 2), cz AS (SELECT batch_id, j, ln(sum(exp(s))) AS z FROM sc GROUP BY 1, 2)
    SELECT sc.batch_id, round(-0.5 * (avg(s - rz.z) + avg(s - cz.z)), 6) AS loss, count(*) AS n FROM sc JOIN rz ON rz.batch_id = sc.batch_id AND rz.i = sc.i JOIN cz ON cz.batch_id = sc.batch_id AND cz.j = sc.j WHERE sc.i = sc.j GROUP BY 1""")
def contrastive_loss(spark, d):
    return objective.batch_losses(_batches(spark, d), 17.0).withColumn("loss", F.round("loss", 6))


@query()
def utility_gradient(spark, d):
    """Utilities of gates of one half between each vector and the next, from the batches' gradients."""
    g = objective.vector_gradients(_batches(spark, d), 17.0).where("side = 0")
    b = _batches(spark, d).select("batch_id", "slot", F.col("anchor").alias("left"), F.col("positive").alias("right"))
    term = F.zip_with("dh", F.zip_with("left", "right", lambda x, y: (x.cast("double") + y) * -0.5), lambda x, y: x * y)
    u = -0.5 * F.aggregate(term, F.lit(0.0), lambda s, x: s + x) / 1.5
    return g.join(b, ["batch_id", "slot"]).select("batch_id", "slot", F.round(u, 9).alias("utility"))


@query("""
    WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), b AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 <> 0),
    s AS (SELECT q.vec_id, b.vec_id AS base_id, list_cosine_similarity(q.v, b.v) AS sim FROM q, b)
    SELECT vec_id, base_id, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 12) DESC, base_id) AS rk FROM s) WHERE rk = 1""")
def bitext_top1(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    base = e.where("vec_id % 50 <> 0").withColumnRenamed("vec_id", "base_id")
    return evaluate.nearest(e.where("vec_id % 50 = 0"), base, "vec_id", "base_id").withColumn("similarity", F.round("similarity", 6))


@query("""
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id, a.v AS x, b.v AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, round(list_cosine_similarity(x, y), 6) AS cosine, round(-list_distance(x, y), 5) AS neg_euclidean, round(-list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))), 5) AS neg_manhattan FROM p""")
def sts_metrics(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    p = evaluate.similarities(e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id"), "x", "y")
    return p.select("vec_id", F.round("cosine", 6).alias("cosine"), F.round("neg_euclidean", 5).alias("neg_euclidean"), F.round("neg_manhattan", 5).alias("neg_manhattan"))


@query(f"""
    WITH q AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), b AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 <> 0),
    s AS (SELECT q.vec_id, q.label AS gold, b.label AS found, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, b.v), 12) DESC, b.vec_id) AS rk FROM q, b), t AS (SELECT gold, found FROM s WHERE rk = 1),
    l AS (SELECT gold AS label, count(*) AS n FROM t GROUP BY 1), f AS (SELECT found AS label, count(*) AS m FROM t GROUP BY 1), h AS (SELECT gold AS label, count(*) AS hit FROM t WHERE gold = found GROUP BY 1)
    SELECT sum(n)::BIGINT AS n, round(sum(coalesce(hit, 0)) / sum(n), 9) AS accuracy, round(sum(n * coalesce(hit / m, 0)) / sum(n), 9) AS "precision", round(sum(n * coalesce(hit / n, 0)) / sum(n), 9) AS recall, round(sum(n * 2 * coalesce(hit, 0) / (n + coalesce(m, 0))) / sum(n), 9) AS f1
    FROM l LEFT JOIN f USING (label) LEFT JOIN h USING (label)""")
def bitext_f1(spark, d):
    """Scores of the nearest neighbours' labels as answers to the queries' own."""
    e = read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    near = evaluate.nearest(e.where("vec_id % 50 = 0"), e.where("vec_id % 50 <> 0").withColumnRenamed("vec_id", "base_id"), "vec_id", "base_id")
    answers = near.join(e.select("vec_id", F.col("label").alias("gold")), "vec_id").join(e.select(F.col("vec_id").alias("base_id"), F.col("label").alias("found")), "base_id")
    out = evaluate.matching_scores(answers, "gold", "found")
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("""
    WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT round(list_cosine_similarity(a.v, b.v), 9) AS s, -abs(a.label - b.label)::DOUBLE AS g FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
    r AS (SELECT s, g, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rs, rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2.0 AS rg FROM p)
    SELECT count(*) AS n, round(corr(s, g), 6) AS pearson, round(corr(rs, rg), 6) AS spearman FROM r""")
def sts_correlation(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("x"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("other"), F.col("x").alias("y")), "vec_id")
    p = p.select(F.round(cosine("x", "y"), 9).alias("score"), (-F.abs(F.col("label") - F.col("other"))).cast("double").alias("gold"))
    out = evaluate.correlations(p, "score", "gold")
    return out.select("n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


def _scores(spark, d, column: str):
    return read(spark, d, "eval_items").select("task", F.col("split_name").alias("split"), F.col("lang").alias("hf_subset"), ((F.col(column) * 7919 % 1000) / 1000).alias("main_score"))


def _main_sql(column: str, name: str) -> str:
    return f"{name} AS (SELECT task, lang AS hf_subset, avg(({column} * 7919 % 1000) / 1000) AS main_score FROM eval_items WHERE split_name = 'test' GROUP BY 1, 2)"


@query(f"WITH {_main_sql('item_id', 'a')}, t AS (SELECT task, avg(main_score) AS score FROM a GROUP BY 1) SELECT task, round(score, 9) AS score FROM t UNION ALL SELECT 'all_tasks', round(avg(score), 9) FROM t")
def macro_scores(spark, d):
    return evaluate.macro(evaluate.main_scores(_scores(spark, d, "item_id"))).withColumn("score", F.round("score", 9))


@query(f"WITH {_main_sql('item_id', 'a')}, {_main_sql('bitext_id', 'b')} SELECT task, hf_subset, round(100 * (a.main_score - b.main_score), 6) AS diff FROM a JOIN b USING (task, hf_subset)")
def paired_diff(spark, d):
    a, b = (evaluate.main_scores(_scores(spark, d, c)) for c in ("item_id", "bitext_id"))
    return evaluate.paired(a, b).withColumn("diff", F.round("diff", 6))


@query(f"""
    WITH {_main_sql('item_id', 'a')}, {_main_sql('bitext_id', 'b')}, df AS (SELECT task, hf_subset, 100 * (a.main_score - b.main_score) AS diff FROM a JOIN b USING (task, hf_subset)),
    pl AS (SELECT diff, row_number() OVER (ORDER BY task, hf_subset) - 1 AS place FROM df), k AS (SELECT count(*) AS n FROM df),
    dr AS (SELECT r, ('0x' || left(md5('0|' || r || '|' || i), 12))::BIGINT % n AS place FROM (SELECT unnest(range(2000)) AS r), k, range(k.n) t(i)),
    ms AS (SELECT r, avg(diff) AS m FROM dr JOIN pl USING (place) GROUP BY 1), o AS (SELECT m, row_number() OVER (ORDER BY m, r) - 1 AS pos FROM ms)
    SELECT count(*) AS n, round(avg(diff), 6) AS mean, round(avg((diff > 0)::INT), 6) AS win_rate, (SELECT round(m, 6) FROM o WHERE pos = 50) AS low, (SELECT round(m, 6) FROM o WHERE pos = 1949) AS high FROM df""")
def bootstrap_ci(spark, d):
    a, b = (evaluate.main_scores(_scores(spark, d, c)) for c in ("item_id", "bitext_id"))
    return evaluate.bootstrap(evaluate.paired(a, b), 2000).select("n", *[F.round(c, 6).alias(c) for c in ("mean", "win_rate", "low", "high")])


@query("""
    WITH s AS (SELECT task, bitext_id, list_sort(list_distinct(list(lang))) AS langs FROM eval_items GROUP BY 1, 2)
    SELECT task, bitext_id, array_to_string(langs, '-') AS subset FROM s WHERE len(list_filter(langs, lambda x: x NOT IN ('eng_Latn', 'fra_Latn', 'deu_Latn', 'rus_Cyrl'))) = 0""")
def subset_filter(spark, d):
    from ..operators.filters import subset_allowed

    s = read(spark, d, "eval_items").groupBy("task", "bitext_id").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    return s.where(subset_allowed("langs", ["eng_Latn", "fra_Latn", "deu_Latn", "rus_Cyrl"])).select("task", "bitext_id", F.array_join("langs", "-").alias("subset"))


@query("""
    WITH s AS (SELECT task, bitext_id, list_sort(list_distinct(list(lang))) AS langs FROM eval_items GROUP BY 1, 2)
    SELECT task, bitext_id, CASE len(langs) WHEN 1 THEN langs[1] WHEN 2 THEN langs[1] END AS first_side, CASE len(langs) WHEN 1 THEN langs[1] WHEN 2 THEN langs[2] END AS second_side, langs[1] AS only_side FROM s""")
def side_languages(spark, d):
    s = read(spark, d, "eval_items").groupBy("task", "bitext_id").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    side = lambda kind, name: evaluate.side_language("langs", kind, name)
    return s.select("task", "bitext_id", side("bitext", "sentence1").alias("first_side"), side("sts", "sentence2").alias("second_side"), side("classification", "text").alias("only_side"))


@query("SELECT 'embeddings' AS name, count(*) AS rows, (count(vec_id) + count(label) + sum(len(embedding)))::BIGINT AS numbers FROM embeddings UNION ALL SELECT 'vocab', count(*), count(token_id) FROM vocab")
def saved_model(spark, d):
    """Two tables saved as a model, loaded again under its checks, and counted."""
    folder = scratch(spark, "model")
    model.save_model(folder, {"dims": DIMS}, {name: read(spark, d, name) for name in ("embeddings", "vocab")})
    model.load_model(spark, folder)
    return model.inventory(spark, folder).select("name", "rows", "numbers")


@query("""
    SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS std, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.9), 4) AS p90
    FROM events WHERE value IS NOT NULL GROUP BY 1""")
def latency_quantiles(spark, d):
    out = telemetry.latency(read(spark, d, "events"), "value", "event_type")
    return out.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "median", "p10", "p90")])


@query("""
    SELECT lang_idx, count(*) AS n, round(avg(utility), 6) AS mean, round(stddev_pop(utility), 6) AS std, min(utility) AS least, round(quantile_cont(utility, 0.5), 6) AS median, max(utility) AS greatest, round(avg((utility > 0)::INT), 9) AS positive
    FROM window_records WHERE utility IS NOT NULL GROUP BY 1""")
def tensor_stats(spark, d):
    out = telemetry.statistics(read(spark, d, "window_records"), "utility", "lang_idx")
    return out.select("lang_idx", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "least", F.round("median", 6).alias("median"), "greatest", F.round("positive", 9).alias("positive"))


@query("""
    WITH s AS (SELECT event_id // 100 AS window_id, count(*) AS n_steps, sum(10 + user_id % 7)::BIGINT AS base_tokens, sum(9 + user_id % 7)::BIGINT AS candidate_pairs, sum(user_id % 7)::BIGINT AS hits, sum(user_id % 3)::BIGINT AS merged FROM events GROUP BY 1)
    SELECT *, base_tokens - merged AS effective_tokens, round((base_tokens - merged) / base_tokens, 9) AS compression, round(hits / candidate_pairs, 9) AS hit_rate, round(merged / candidate_pairs, 9) AS merge_rate FROM s""")
def window_telemetry(spark, d):
    u = F.col("user_id")
    steps = read(spark, d, "events").select(F.col("event_id").alias("step"), (10 + u % 7).alias("base_tokens"), (9 + u % 7).alias("candidate_pairs"), (u % 7).alias("hits"), (u % 3).alias("merged"))
    out = telemetry.window_metrics(steps, 100)
    return out.select("window_id", "n_steps", "base_tokens", "candidate_pairs", "hits", "merged", "effective_tokens", *[F.round(c, 9).alias(c) for c in ("compression", "hit_rate", "merge_rate")])


@query("""
    WITH r AS (SELECT token_id, 1.0 / row_number() OVER (ORDER BY token_id) AS z FROM vocab) SELECT token_id, round(0.00005 / (0.00005 + z / sum(z) OVER ()), 9) AS weight FROM r""")
def sif_weights(spark, d):
    return init_table.sif_weights(read(spark, d, "vocab")).withColumn("weight", F.round("weight", 9))


@query()
def pca_init(spark, d):
    whole = read(spark, d, "embeddings").select(F.col("vec_id").alias("token_id"), F.col("embedding").alias("vec"))
    out = init_table.initial_table(whole, DIMS, 16)
    return out.select("token_id", *[F.round(F.abs(F.col("vec")[i]), 5).alias(f"v{i}") for i in (0, 15)])


@query("""
    WITH m AS (SELECT lang_idx, window_id, max(abs(utility)) AS m FROM window_records WHERE utility IS NOT NULL AND lang_idx IS NOT NULL GROUP BY 1, 2)
    SELECT lang_idx, round(sqrt(sum(utility * utility)), 5) AS norm FROM window_records WHERE utility IS NOT NULL AND lang_idx IS NOT NULL GROUP BY 1""")
def gradient_norm(spark, d):
    r = read(spark, d, "window_records").where("lang_idx IS NOT NULL AND utility IS NOT NULL")
    return telemetry.gradient_norms(r, "utility", "window_id", "lang_idx").withColumn("norm", F.round("norm", 5))


@query("""
    WITH e AS (SELECT vec_id % 32 AS r, embedding[1]::DOUBLE AS a, embedding[64]::DOUBLE AS b FROM embeddings) SELECT r AS row_id, round(avg(a), 6) AS v0, round(avg(b), 6) AS v63 FROM e GROUP BY 1""")
def fold_rows(spark, d):
    out = transitions.fold_rows(read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding"), "row_id", "embedding", 32, DIMS)
    return out.select("row_id", F.round(F.col("embedding")[0], 6).alias("v0"), F.round(F.col("embedding")[63], 6).alias("v63"))


@query(f"WITH {TOK} SELECT sent_id, (count(*) + count(*) FILTER ({_TAKEN_APART}))::BIGINT AS n, sum(CASE WHEN {_TAKEN_APART} THEN 2 * token_id + 3 ELSE token_id END)::BIGINT AS total FROM tok GROUP BY 1")
def reclaim_expand(spark, d):
    lists = tokens.expand_reclaimed(tok(spark, d).where("size(token_ids) > 0"), "token_ids", _reclaimed(spark, d))
    return lists.select("sent_id", F.size("token_ids").cast("long").alias("n"), F.aggregate("token_ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("WITH b AS (SELECT token_id // 8 AS byte, sum(CASE WHEN is_marker THEN 1 << (token_id % 8) ELSE 0 END)::INT AS bits FROM vocab GROUP BY 1) SELECT byte::BIGINT AS byte, bits FROM b")
def packed_mask(spark, d):
    return sinks.packed_mask(read(spark, d, "vocab"), "token_id", "is_marker")


@query("SELECT label, round(avg(list_sum(embedding::DOUBLE[])), 6) AS mean_sum, count(*) AS n FROM embeddings GROUP BY 1")
def label_means(spark, d):
    e = read(spark, d, "embeddings").withColumn("s", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x))
    return e.groupBy("label").agg(F.round(F.avg("s"), 6).alias("mean_sum"), F.count("*").alias("n"))


_HOURS = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"


@query(_HOURS)
def events_watermark_window(spark, d):
    return windows.event_windows(read(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("""
    WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
    SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    return windows.sessions(read(spark, d, "events"))


@query(_HOURS)
def stream_event_windows(spark, d):
    """The same windows from a stream over the file, written by micro-batches and read back when it has ended."""
    out = scratch(spark, "stream")
    stream = spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = windows.event_windows(stream)
    run = counted.writeStream.outputMode("update").foreachBatch(windows.exactly_once(f"{out}/data")).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    done = windows.latest(spark.read.parquet(f"{out}/data"), "window_start", "event_type").select("window_start", "event_type", "n", "total")
    return done.withColumn("total", F.round("total", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
