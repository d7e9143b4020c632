"""Pooling of sentences where they are gives what the joins give, and moves no token."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import pooling, tokens
from pairloom.plans.catalog import QUERIES


def vectors(df):
    return {(r["sent_id"], r["lang_idx"]): [round(x, 5) for x in r["h"]] for r in df.collect()}


def stages(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_wordpool_forms(spark, monkeypatch):
    emb = spark.createDataFrame([(k, [float(k), 1.0 / k]) for k in range(1, 6)], "token_id long, vec array<float>")
    # tokens 9 have no vector: in a word with others, as a word of their own, and as a sentence
    sentences = [(1, 0, [2, 9, 3, 4, 5, 1], [False, False, True, False, True, True]), (2, 1, [9, 1, 1], [True, True, False]), (3, 1, [9], [True]), (4, 1, [], []), (5, 1, None, None)]
    lists = spark.createDataFrame(sentences, "sent_id long, lang_idx int, token_ids array<long>, opens array<boolean>")
    long = lists.select("sent_id", "lang_idx", F.posexplode(F.arrays_zip("token_ids", "opens")).alias("pos", "x")).select("sent_id", "lang_idx", "pos", F.col("x.token_ids").alias("token_id"), F.col("x.opens").alias("opens"))
    long = tokens.word_ids(long, "sent_id", F.col("opens"))
    want = {(1, 0): [(2 + 3.5 + 5 + 1) / 4, round((1 / 2 + (1 / 3 + 1 / 4) / 2 + 1 / 5 + 1) / 4, 5)], (2, 1): [1.0, 1.0]}
    pooled = pooling.pool("wordpool", lists, emb, 2)
    assert vectors(pooled) == want == vectors(pooling.pool("wordpool", long, emb, 2))
    assert "Exchange" not in stages(pooled)
    monkeypatch.setattr(pooling, "MOST_TABLE_BYTES", 0)
    assert vectors(pooling.pool("wordpool", lists, emb, 2)) == want == vectors(pooling.pool("wordpool", long, emb, 2))


def test_wordpool_moves_no_token(spark):
    assert "Exchange" not in stages(QUERIES["wordpool"](spark, "/root/testdata/sf0.001"))


def test_pairs_that_share_vectors(spark, monkeypatch):
    """Pairs that name their vector give what pairs with a vector of their own give, on the workers and by joins, and need far less room."""
    emb = spark.createDataFrame([(k, [float(k), 1.0 / k]) for k in range(1, 6)], "token_id long, vec array<float>")
    toks = spark.createDataFrame([(1, 0, [1, 2, 3, 4, 5]), (2, 1, [2, 3, 2, 3]), (3, 1, [5]), (4, 0, [9, 1, 2])], "sent_id long, lang_idx int, token_ids array<long>")
    named = spark.createDataFrame([(100 * a + b, s, row) for a, b, s, row in ((1, 2, 0.5, 4), (2, 3, 0.8, 4), (3, 4, -1.0, 2), (4, 5, 0.1, 7), (3, 2, 0.2, None))], "pair_key long, score double, row long")
    merged = emb.select(F.col("token_id").alias("row"), F.col("vec").alias("m"))
    own = named.join(merged, "row").drop("row")
    for mode in ("collapse", "collapse_online_compiled"):
        want = vectors(pooling.pool(mode, toks, emb, 2, base=100, exact=own))
        assert len(want) == 4
        assert vectors(pooling.pool(mode, toks, emb, 2, base=100, exact=named, merged=merged)) == want
        with monkeypatch.context() as m:
            m.setattr(pooling, "MOST_TABLE_BYTES", 0)
            assert vectors(pooling.pool(mode, toks, emb, 2, base=100, exact=named, merged=merged)) == want
    many = spark.range(2_000_000)
    assert pooling._fits(64, emb, pairs=many) and not pooling._fits(64, emb, many)
