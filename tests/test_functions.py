from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions import keys as K
from pairloom.functions import stats as S
from pairloom.functions import text as T


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).head())


def test_cantor_keys(spark):
    df = spark.createDataFrame([(0, 1), (1, 0), (2, 3), (1_500_000_000, 1_500_000_000), (0, 3_037_000_498), (None, 1), (-1, 2)], "a long, b long")
    out = df.select("a", "b", K.cantor_key("a", "b").alias("c")).withColumn("l", K.cantor_left("c")).withColumn("r", K.cantor_right("c")).collect()
    assert [r["c"] for r in out[:3]] == [2, 1, 18]
    assert all((r["l"], r["r"]) == (r["a"], r["b"]) for r in out[:5])
    assert out[5]["c"] is None and out[6]["c"] is None


def test_exact_keys_and_hashes(spark):
    assert one(spark, K.pair_key(F.lit(3), F.lit(7), 100), K.key_left(F.lit(307), 100), K.key_right(F.lit(307), 100)) == (307, 3, 7)
    assert one(spark, K.pair_hash(F.lit(1), F.lit(2), 1000)) == ((2654435761 + 2 * 40503) % 1000,)


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 2**40), st.integers(0, 2**31 - 1), st.integers(0, 2**31 - 1))
def test_hashes_wrap_as_numpy_does(spark, key, a, b):
    with np.errstate(over="ignore"):
        k = np.int64(key)
        want = [int((k * np.int64(x) + np.int64(y)) % np.int64(524288)) for x, y in zip(K.SKETCH_A, K.SKETCH_B)]
        sign = [int((k * np.array(s, "uint64").astype("int64") + np.int64(y)) & 1) * 2 - 1 for s, y in zip(K.SKETCH_SIGN, K.SKETCH_B)]
        v = np.int64(0)
        for place, x in enumerate((a, b, a)):
            v = v * np.int64(K.MIX_A) + np.int64(x) * np.int64(K.MIX_B) + np.int64(place)
        gram = int(np.abs(v)) % 65536
    got = one(spark, *[K.sketch_bucket(F.lit(key), d, 524288) for d in range(3)], *[K.sketch_sign(F.lit(key).cast("long"), d) for d in range(3)], K.ngram_hash([F.lit(a), F.lit(b), F.lit(a)], 65536))
    assert list(got) == [*want, *sign, gram]


def test_sketch_bucket_of_a_known_key(spark):
    assert one(spark, K.sketch_bucket(F.lit(123456789), 0, 524288)) == (63744,)


def test_gates_and_bounds(spark):
    low, opened, ends, outside = one(spark, S.lower_positive_rate(F.lit(160), F.lit(200), F.lit(1)), S.open_probability(F.lit(0.3)), S.open_probability(F.lit(1.0)), S.open_probability(F.lit(1.5)))
    assert low == pytest.approx(0.8 - math.sqrt(math.log(40) / 400))
    assert opened == pytest.approx(1 / (1 + math.exp(-(math.log(0.3 / 0.7) - 2 / 3 * math.log(0.1 / 1.1)))))
    assert ends == 1.0 and outside is None
    assert one(spark, S.lower_positive_rate(F.lit(0), F.lit(0), F.lit(1))) == (None,)


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, S.norm(a), S.cosine(a, b), S.cosine(a, a), S.manhattan(a, b)) == (5.0, 0.0, 1.0, 7.0)
    assert one(spark, S.l2_normalize(a))[0] == pytest.approx([0.6, 0.8])
    assert sum(one(spark, S.softmax(a))[0]) == pytest.approx(1.0)


def test_text(spark):
    df = spark.createDataFrame([("\t Ａ  Straße ",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(T.canonical_text("x")).collect()] == ["a strasse", None, ""]
    assert [r[0] for r in df.select(T.strip("x")).collect()] == ["Ａ  Straße", None, ""]
    got = one(spark, T.with_marker(F.lit("hello"), F.lit("eng_Latn")), T.with_marker(F.lit("__rus_Cyrl__ x"), F.lit("eng_Latn")), T.marker_language(F.lit("__rus_Cyrl__ x")), T.eval_language(F.lit("zho-Hans")), T.safe_slug(F.lit("a/b c.d")))
    assert got == ("__eng_Latn__ hello", "__rus_Cyrl__ x", "rus_Cyrl", "cmn_Hani", "a_b_c.d")
    assert one(spark, T.starts_word(F.lit("▁a")), T.starts_word(F.lit("a")), T.starts_word(F.lit(None).cast("string"))) == (True, False, True)


def test_terms_and_dice(spark):
    assert T.bigrams_of("Ab1 c") == ["ab", "bc"] and T.bigrams_of("x") == ["x"] and T.bigrams_of("12") == []
    assert T.terms_of("The running dogs", "eng_Latn", {"eng": frozenset(["the"])}, {"eng": {"dogs": "dog"}}) == ["dog", "running"]
    assert T.terms_of("слово", "rus_Cyrl", fallback="reject") == []
    df = spark.createDataFrame([("alpha beta", "alpha gamma"), ("alpha beta", "gamma delta"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(T.dice(T.word_terms("a"), T.word_terms("b"))).collect()] == [0.5, 0.0, 0.0]


def test_suite_labels(spark):
    names = ["ara-Arab", "pes_Arab", "fas_Arab", "tgl_Latn", "uzb_Latn", "jpn_Hira"]
    assert list(one(spark, *[T.eval_language(F.lit(n)) for n in names])) == ["arb_Arab", "fas_Arab", "fas_Arab", "fil_Latn", "uzb_Latn", "jpn_Jpan"]
    df = spark.createDataFrame([(["eng-fra"],), (["ja"],), (["FRA_Latn"],), ([None],), (None,), (["spa"],)], "m array<string>")
    assert [r[0] for r in df.select(T.names_language("m", ["fra", "JPN"])).collect()] == [True, True, True, False, False, False]
    assert df.where(T.names_language("m", [])).count() == 0


def test_folder_of_a_cluster_is_never_local(monkeypatch):
    from types import SimpleNamespace

    from pairloom import storage

    made = {}
    fake = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder, set=made.__setitem__), sparkContext=SimpleNamespace(master=master))
    assert storage.shared_dir(fake("spark://x:1", "hdfs:///tmp/c/")) == "hdfs:///tmp/c"
    with pytest.raises(ValueError):
        storage.shared_dir(fake("spark://x:1", None))
    assert storage.shared_dir(fake("local[2]", None)) == made["spark.checkpoint.dir"]


def test_scratch_is_removed(spark):
    from pathlib import Path

    from pairloom import storage

    df = storage.materialize(spark.range(3))
    path = Path(df.inputFiles()[0].removeprefix("file:").removeprefix("//")).parent
    assert path.exists() and storage.clear_scratch(spark) >= 1 and not path.exists()
