from __future__ import annotations

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.operators import filters, ranking, sampling
from pairloom.streaming import windows

PAIRS = "id long, g int, anchor string, positive string"


def test_clean_pairs_edges(spark):
    df = spark.createDataFrame([(1, 0, " a ", "b"), (2, 0, None, "b"), (3, 0, "", "b"), (4, 0, "x" * 600, "b"), (5, 0, "Straße", "STRASSE"), (6, 0, "a", "b")], PAIRS).withColumn("_at", F.lit(1))
    assert rows(filters.clean_pairs(df), "id", "anchor") == [(1, "a"), (6, "a")]
    assert filters.clean_pairs(df.where("false")).count() == 0
    assert rows(filters.clean_pairs(df, max_chars=0), "id") == [(1,), (4,), (6,)]


def test_batch_dedup_sequence(spark):
    df = spark.createDataFrame([(1, 0, "same", "p1"), (2, 0, "same", "p2"), (3, 0, "anchor-3", "p3"), (4, 0, "same", "p4"), (5, 0, None, "p5")], PAIRS)
    assert rows(filters.batch_dedup(df, 2, "g", "id"), "id", "batch", "slot") == [(1, 0, 0), (3, 0, 1), (4, 1, 0)]
    assert filters.batch_dedup(df.where("false"), 2, "g", "id").count() == 0


def test_languages_kept(spark):
    df = spark.createDataFrame([("eng_Latn",), ("fra_Latn",), ("fra_Arab",), (None,)], "lang string")
    assert rows(df.where(filters.languages_kept("lang", ["eng_Latn", "FRA"], ["fra_Arab"]))) == [("eng_Latn",), ("fra_Latn",)]
    with pytest.raises(ValueError):
        filters.languages_kept("lang", ["fra"], ["fra"])


def test_language_temperature_keeps_the_largest(spark):
    df = spark.createDataFrame([("large", 900), ("large", 100), ("medium", 500), ("small", 10), ("none", 0)], "language string, bytes long")
    out = sampling.language_weights(df, 0.7, 2).collect()
    assert {r["language"] for r in out} == {"large", "medium"} and len(out) == 3
    share = {lang: sum(r["weight"] for r in out if r["language"] == lang) for lang in ("large", "medium")}
    assert share["large"] / share["medium"] == pytest.approx((1000 / 500) ** 0.7)
    assert max(r["weight"] for r in out) == 1.0


def planned(spark, groups, *args):
    df = spark.createDataFrame(groups, "source string, language string, rows long, source_weight double")
    return sorted(tuple(r) for r in sampling.batch_plan(df, *args).select("batch", "source", "language", "occurrence").collect())


def test_schedule_shares_and_resume(spark):
    groups = [("a", "x", 36, 1.0), ("a", "y", 36, 1.0), ("b", "x", 8, 1.0), ("c", "x", 0, 1.0), ("d", "x", 9, 0.0)]
    plan = planned(spark, groups, 100, 0, 0.5, 1.0)
    assert sum(s == "a" for _, s, _, _ in plan) == 75 and sum(s == "b" for _, s, _, _ in plan) == 25
    assert [b for b, *_ in plan] == list(range(100))
    assert planned(spark, groups, 60, 40, 0.5, 1.0) == plan[40:]
    per_group = [o for _, s, lang, o in plan if (s, lang) == ("a", "y")]
    assert per_group == list(range(len(per_group)))
    assert planned(spark, groups[3:], 5) == []


def test_turns_far_along_need_nothing_before(spark):
    far = planned(spark, [("a", "x", 3, 1.0), ("b", "x", 1, 1.0)], 8, 10**9, 1.0, 1.0)
    assert [b for b, *_ in far] == list(range(10**9, 10**9 + 8)) and sum(s == "a" for _, s, *_ in far) == 6
    t = sampling.Turns(["a", "b"], [3.0, 1.0])
    t.go_to(10**9)
    assert [t.next() for _ in range(8)] == [s for _, s, _, _ in far]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=7), st.integers(0, 400), st.integers(0, 5))
def test_turns_keep_every_share_and_can_begin_anywhere(weights, place, seed):
    names = [f"i{k}" for k in range(len(weights))]
    t = sampling.Turns(names, [float(w) for w in weights], seed)
    drawn = [t.next() for _ in range(place + 20)]
    for n in range(1, len(drawn) + 1, 7):
        for name, w in zip(names, weights):
            assert abs(drawn[:n].count(name) - n * w / sum(weights)) <= 1 + len(weights) / 2
    again = sampling.Turns(names, [float(w) for w in weights], seed, place)
    assert [again.next() for _ in range(20)] == drawn[place:]


def test_turns_windows_and_state():
    r = sampling.Turns(["a", "b"], [2.0, 1.0], 3)
    drawn = [r.next() for _ in range(9)]
    assert all(sorted(drawn[i : i + 3]) == ["a", "a", "b"] for i in (0, 3, 6))
    state = r.state()
    ahead = [r.next() for _ in range(7)]
    again = sampling.Turns(["a", "b"], [2.0, 1.0], 3)
    again.load(state)
    assert [again.next() for _ in range(7)] == ahead
    again.load(state)
    again.advance(2)
    assert again.next() == ahead[2]
    with pytest.raises(ValueError):
        sampling.Turns(["a", "b"], [2.0, 2.0], 3).load(state)
    for weights in ([0.0], [-1.0], []):
        with pytest.raises(ValueError):
            sampling.Turns(["a"], weights)


PLAN = "batch long, source string, language string, occurrence long"


def test_homogeneous_batches_are_full_and_reproducible(spark):
    data = spark.createDataFrame([(i, "s", "x" if i % 3 else "y") for i in range(50)], "id long, source string, language string")
    plan = spark.createDataFrame([(0, "s", "x", 0), (1, "s", "y", 0), (2, "s", "y", 1), (3, "s", "y", 2), (4, "s", "zz", 0)], PLAN)
    out = sampling.homogeneous_batches(data, plan, 8, "id").toPandas()
    assert out.groupby("batch").size().to_dict() == {0: 8, 1: 8, 2: 8, 3: 8}  # the 17 rows of y begin a second pass
    assert set(out[out.batch == 1].language) == {"y"}
    assert out[out.batch.isin([1, 2])].id.is_unique
    again = sampling.homogeneous_batches(data, plan.where("batch >= 2"), 8, "id").toPandas()
    cut = out[out.batch >= 2].sort_values(["batch", "slot"])
    assert list(again.sort_values(["batch", "slot"]).id) == list(cut.id)


def test_unique_batches(spark):
    """Three texts over and over and a fourth once: a batch of four needs rows of later runs; a batch of five cannot be."""
    texts = ["one", "One ", "two", "three"] * 6 + ["four"]
    data = spark.createDataFrame([(i, "s", "x", t, f"p{i}") for i, t in enumerate(texts)] + [(99, "s", "x", None, "p"), (98, "s", "x", "q", None)], "id long, source string, language string, anchor string, positive string")
    plan = spark.createDataFrame([(b, "s", "x", b) for b in range(3)], PLAN)
    out = sampling.unique_batches(data, plan, 4, "id", strict=True).toPandas()
    assert out.groupby("batch").anchor.apply(lambda a: len({x.strip().lower() for x in a})).to_dict() == {0: 4, 1: 4, 2: 4}
    assert sorted(out.slot) == sorted([0, 1, 2, 3] * 3)
    with pytest.raises(ValueError, match="unique batch"):
        sampling.unique_batches(data, plan, 5, "id", strict=True)
    padded = sampling.unique_batches(data, plan, 5, "id").toPandas()
    assert padded.groupby("batch").size().to_dict() == {0: 5, 1: 5, 2: 5}
    assert sampling.unique_batches(data.where("false"), plan, 4, "id").count() == 0


def test_mixed_order(spark):
    data = spark.createDataFrame([(i, "a" if i < 30 else "b") for i in range(33)], "id long, source string")
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("gone", 5.0)], "source string, weight double")
    out = sampling.mixed_order(data, weights, "id", 40).orderBy("place").toPandas()
    assert list(out.place) == list(range(40)) and (out.source == "a").sum() == 30 and out[out.source == "a"].id.is_unique
    assert out[out.source == "b"].id.value_counts().max() == 4  # three rows, ten places
    later = sampling.mixed_order(data, weights, "id", 10, 30).orderBy("place").toPandas()
    assert list(later.id) == list(out.id[30:])


def test_running_and_quantiles(spark):
    data = spark.createDataFrame([(k % 3 if k % 7 else None, float(k * k % 101), k) for k in range(200)] + [(5, None, 1)], "g int, v double, n long")
    placed = ranking.running(data.where("v is not null"), ["v", "n"], ["n"]).orderBy("place").toPandas()
    assert list(placed.place) == list(range(200)) and placed.v.is_monotonic_increasing and (placed.n_so_far == placed.n.cumsum()).all()
    got = {r["g"]: (r["m"], r["q"]) for r in ranking.quantiles(data, "v", "g", {"m": 0.5, "q": 0.9}).collect()}
    frame = data.toPandas()
    for g in (0, 1, 2, None):
        v = frame[frame.g.isna() if g is None else frame.g == g].v
        assert got[g] == pytest.approx((v.quantile(0.5), v.quantile(0.9)))
    assert 5 not in got and ranking.running(data.where("false"), ["v"]).count() == 0


def test_samples(spark):
    data = spark.range(100).withColumn("g", (F.col("id") % 3).cast("int"))
    out = sampling.sample_rows(data, 5, ["g"], "id", 1)
    assert out.groupBy("g").count().where("count = 5").count() == 3
    assert rows(out) == rows(sampling.sample_rows(data, 5, ["g"], "id", 1)) != rows(sampling.sample_rows(data, 5, ["g"], "id", 2))
    assert sorted(r["place"] for r in sampling.deck(data, "id").collect()) == list(range(100))
    weighted = data.withColumn("w", F.when(F.col("id") < 90, 0.0).when(F.col("id") == 95, None).otherwise(1.0))
    assert {r["id"] for r in sampling.weighted_draws(weighted, "id", "w", 50).collect()} == {90, 91, 92, 93, 94, 96, 97, 98, 99}


def test_holdout_and_weights(spark):
    data = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0), (2, 0)], "shard_id int, row_group int")
    assert rows(sampling.holdout(data, 1).where("held_out"), "shard_id", "row_group") == [(1, 2)]
    assert sampling.holdout(data, 0).where("held_out").count() == 0
    f = spark.createDataFrame([(1, 10, 2.0), (1, 30, 2.0)], "shard_id int, rows long, sampling_weight double")
    assert rows(sampling.fragment_weights(f), "weight") == [(0.5,), (1.5,)]
    g = spark.createDataFrame([("a", "x", 4, 1.0), ("a", "y", 4, 1.0), ("b", "x", 8, 1.0)], "source string, language string, rows long, source_weight double")
    assert rows(sampling.group_weights(g), "weight") == [(0.25,), (0.25,), (0.5,)]


def test_step_and_event_windows(spark):
    obs = spark.createDataFrame([(0, 10, 0, 1.0), (5, 10, 0, 1.0), (12, 10, 0, 2.0)], "step long, pair_key long, lang_idx int, utility double")
    assert rows(windows.step_discovery(obs, 10)) == [(0, 10, 0, 2.0, 2), (1, 10, 0, 2.0, 1)]
    assert windows.resume_batch(7, 2) == 14
    with pytest.raises(ValueError):
        windows.resume_batch(7, 2, 3)


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    batch = pd.DataFrame({"id": [1, 2, 3, 4], "g": [0, 0, 0, 0], "anchor": ["same", "same", "a3", "same"], "positive": ["p1", "p2", "p3", "p4"]})
    spark.createDataFrame(batch).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("id long, g long, anchor string, positive string").parquet(str(source))
    run = windows.stream_dedup(stream, 2, "g").writeStream.foreachBatch(windows.exactly_once(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "positive") == [("p1",), ("p3",), ("p4",)]
    windows.save_state(tmp_path, {"a": 1}, step=4)
    assert windows.saved_state(tmp_path, {"a": 1})["step"] == 4
    with pytest.raises(ValueError):
        windows.saved_state(tmp_path, {"a": 2})


def test_stream_of_planned_batches(spark, tmp_path):
    planned_ = spark.createDataFrame([(b, s, f"t{b}-{s}") for b in range(6) for s in range(2)], "batch long, slot int, text string")
    planned_.write.parquet(str(tmp_path / "batches"))
    stream = windows.batch_stream(spark, spark.read.parquet(str(tmp_path / "batches")), per_trigger=2, start=2)
    run = stream.writeStream.foreachBatch(windows.exactly_once(str(tmp_path / "out"), lambda df: df.withColumnRenamed("batch", "number"))).option("checkpointLocation", str(tmp_path / "log")).start()
    for _ in range(60):
        run.awaitTermination(1)
        if (run.lastProgress or {}).get("batchId", 0) >= 3:
            break
    run.stop()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "number", "slot") == [(b, s) for b in range(2, 6) for s in range(2)]


def test_running_discovery(spark, tmp_path):
    for k, keys in enumerate(([10, 10, 20], [20, 20, 30])):
        spark.createDataFrame([(0, p, 0, 1.0, -1.0) for p in keys] + [(0, None, 0, 1.0, 1.0)], "stream_id int, pair_key long, lang_idx int, p double, grad double").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).schema("stream_id int, pair_key long, lang_idx int, p double, grad double").parquet(str(tmp_path / "in"))
    run = windows.running_discovery(stream, 2, 10).writeStream.outputMode("update").foreachBatch(windows.exactly_once(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    done = spark.read.parquet(str(tmp_path / "out"))
    last = done.where(F.col("batch") == done.agg(F.max("batch")).head()[0])
    assert rows(last, "pair_key", "support", "utility") == [(10, 2, 2.0), (20, 3, 3.0)]


def test_latest_of_updates(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "a", 3), (0, "b", 7)], "batch long, k string, n long")
    assert rows(windows.latest(df, "k")) == [("a", 3), ("b", 7)]
