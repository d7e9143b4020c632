from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import rows

from pairloom.operators import discovery, selection, sketches, tokens, transitions
from pairloom.operators.discovery import BoundedObserver

REC = "pair_key long, lang_idx int, utility double, probability_sum double, support long, positive_support long"


def records(spark, *data):
    return spark.createDataFrame([(k, lang, float(u), 1.0, n, p) for k, lang, u, n, p in data], REC)


def test_observations_are_summed(spark):
    obs = spark.createDataFrame([(20, 1, 0.25, -2.0), (10, 0, 0.5, -1.0), (20, 1, 0.75, -1.0), (10, 0, 0.5, float("nan")), (None, 0, 0.5, 1.0)], "pair_key long, lang_idx int, p double, grad double")
    out = discovery.by_pair_language(obs.withColumn("utility", discovery.utility()))
    assert rows(out, "pair_key", "utility", "probability_sum", "support", "positive_support") == [(10, 0.5, 0.5, 1, 1), (20, 1.25, 1.0, 2, 2)]
    assert discovery.by_pair_language(obs.where("false").withColumn("utility", discovery.utility())).count() == 0


def test_bounded_observer_known_runs():
    o = BoundedObserver(capacity=1, top=1)
    o.observe([10, 20, 21], [0, 0, 0], [1.0, 1.0, 1.0], [-100.0, -1.0, -0.5])
    o.observe([20, 21], [0, 0], [1.0, 1.0], [-1.0, -0.5])
    o.observe([30], [0], [1.0], [-200.0])
    assert [r["pair_key"] for r in o.snapshot()] == [30]
    assert o.counters["free"] == 1 and o.counters["replaced"] == 1 and o.counters["transferred"] == 3

    o = BoundedObserver(capacity=4, top=8)
    o.observe(np.arange(8), np.zeros(8), np.ones(8), -np.arange(1.0, 9.0))
    assert [r["pair_key"] for r in o.snapshot()] == [4, 5, 6, 7]

    o = BoundedObserver(capacity=1, top=4)
    for key, u in ((10, 1.0), (20, 0.6), (20, 0.6)):
        o.observe([key], [0], [1.0], [-u])
    assert [(r["pair_key"], round(r["utility"], 9)) for r in o.snapshot()] == [(20, 0.6)]


def test_frequency_observer_and_state():
    o = BoundedObserver(capacity=3, top=8, frequency=True)
    o.observe([10, 10, 20, 30, 10, 20])
    assert {r["pair_key"]: r["support"] for r in o.snapshot()} == {10: 3, 20: 2, 30: 1}
    assert all(r["lang_idx"] == -1 and r["utility"] == 0 for r in o.snapshot())
    o = BoundedObserver(capacity=1, top=4, frequency=True)
    for keys in ([10, 10], [20], [20, 20]):
        o.observe(keys)
    assert [(r["pair_key"], r["support"]) for r in o.snapshot()] == [(20, 3)]
    again = BoundedObserver.load(o.state())
    for x in (o, again):
        x.observe([5, 5, 5, 5, 5])
    assert o.snapshot() == again.snapshot()


def test_top_per_call_and_pairs(spark):
    obs = spark.createDataFrame([(1, 10, 0, 5.0, 0.1), (1, 20, 0, -6.0, 0.1), (1, 30, 0, 1.0, 0.1), (2, 30, 0, 1.0, 0.1)], "call_id long, pair_key long, lang_idx int, utility double, p double")
    assert rows(discovery.top_per_call(obs, 2), "pair_key", "utility") == [(10, 5.0), (20, -6.0), (30, 1.0)]
    assert tuple(discovery.pressure(obs, 2).head()) == (4, 1)
    pairs = spark.createDataFrame([(3, 5), (1, 5), (2, 9), (4, 1)], "pair_key long, support long")
    assert rows(discovery.top_pairs(pairs, 2)) == [(1, 5, 2, 5), (2, 9, 1, 5)]


def test_sketches_bound_and_merge(spark):
    df = spark.createDataFrame([(k, 1) for k in range(300) for _ in range(k % 5 + 1)] + [(None, 1)], "k long, v long")
    exact = {r["k"]: r["n"] for r in df.where("k is not null").groupBy("k").count().withColumnRenamed("count", "n").collect()}
    cells = sketches.sketch(df, "k", "v", 64)
    got = {r["k"]: r["estimate"] for r in sketches.estimate(df.where("k is not null").select("k").distinct(), "k", cells, 64).collect()}
    assert got.keys() == exact.keys() and all(got[k] >= n for k, n in exact.items())
    halves = sketches.merge(sketches.sketch(df.where("k < 100"), "k", "v", 64), sketches.sketch(df.where("k >= 100"), "k", "v", 64))
    assert rows(halves, "depth", "bucket", "cell") == rows(cells, "depth", "bucket", "cell")


def test_promotion(spark):
    r = records(spark, (10, 0, 12, 3, 3), (20, 1, 8, 3, 3), (30, 0, 4, 3, 3))
    out = selection.promote(r, 2, 1, 1, 1)
    assert rows(out, "pair_key") == [(10,), (20,)]
    assert rows(selection.memberships(r, out, 1, 1)) == [(10, 0), (20, 1)]
    r = records(spark, (10, 0, 3e-4, 3, 3), (20, 0, 2.5e-4, 3, 3), (30, 0, 1e-4, 3, 3))
    assert rows(selection.promote(r, 9, 1, 0, 1, 2e-4), "pair_key") == [(10,), (20,)]
    r = records(spark, (10, 0, 1, 3, 3), (10, 1, -3, 3, 3), (20, 0, 0.5, 3, 3))
    assert rows(selection.promote(r, 9, 1, 9, 1), "pair_key") == [(20,)]
    assert selection.promote(r.where("false"), 9).count() == 0


def test_audit(spark):
    a = selection.audit(records(spark, (10, 0, 12, 3, 3), (20, 1, 4, 3, 3), (30, 0, 10, 3, 3)), 2, 1, 1, 1, capacity=8).head()
    assert (a["records"], a["saturation"], a["memberships"]) == (3, 0.375, 2)
    assert (a["global_utility"], a["reserved_utility"], a["displaced_utility"], a["occupancy"]) == (22.0, 16.0, 6.0, 1.0)
    assert (a["reservation_only"], a["global_only"]) == (1, 1)


def test_external(spark):
    r = records(spark, (10, 0, 1, 2, 1), (10, 1, 1, 4, 1), (20, 0, 2, 3, 1))
    keys = spark.createDataFrame([(10,), (20,), (30,), (20,), (None,)], "pair_key long")
    assert rows(selection.select_external(r, keys, 2)) == [(10, 6, 2, None), (20, 3, 1, "repeated"), (30, None, None, "unknown_pair"), (None, None, None, "null_key")]


def test_growth_selectors(spark):
    prev = records(spark, (1, 0, 5, 40, 40), (2, 0, 5, 40, 40), (3, 0, -1, 40, 1), (4, 0, 5, 2, 2), (6, 1, 5, 40, 40))
    cur = records(spark, (1, 0, 5, 40, 40), (2, 0, 5, 40, 40), (3, 0, 5, 40, 40), (4, 0, 5, 40, 40), (5, 0, 5, 40, 40), (6, 0, 5, 40, 40))
    old = spark.createDataFrame([(2,)], "pair_key long")
    out = dict(rows(selection.stable_growth(prev, cur, old, 8, 4)))
    assert out == {1: "selected", 2: "already_exact", 3: "nonpositive_utility", 4: "insufficient_support", 5: "not_consecutive", 6: "selected"}
    assert dict(rows(selection.histogram(selection.stable_growth(prev, cur, old, 8, 4))))["no_supported_positive_language"] == 0
    assert dict(rows(selection.sign_growth(prev, cur, old)))[1] == "selected"
    assert dict(rows(selection.l0_growth(cur, old, 8, 4)))[1] == "gate_closed"
    balanced = rows(selection.balanced_growth(prev, cur, old, 2), "pair_key", "via")
    assert balanced == [(1, "language"), (4, "language")]


def test_balanced_growth_takes_turns(spark):
    """Against taking turns one by one, with pairs that several languages want."""
    rng = random.Random(4)
    data = {(k, lang): rng.randint(1, 9) for k in range(60) for lang in range(5) if rng.random() < 0.5}
    df = records(spark, *[(k, lang, float(u), 5, 5) for (k, lang), u in data.items()])
    none = spark.createDataFrame([], "pair_key long")
    total = {lang: sum(u for (_, x), u in data.items() if x == lang) for lang in range(5)}
    for limit in (3, 17, 40):
        taken: dict[int, str] = {}
        for turn in range(5):
            room = limit // 5 + (turn < limit % 5)
            for k in sorted((k for k, x in data if x == turn), key=lambda k: (-data[k, turn] / total[turn], k)):
                if room and k not in taken:
                    taken[k], room = "language", room - 1
        best = {k: max(data[k, x] / total[x] for y, x in data if y == k) for k, _ in data if k not in taken}
        for k in sorted(best, key=lambda k: (-best[k], k))[: limit - len(taken)]:
            taken[k] = "backfill"
        assert dict(rows(selection.balanced_growth(df, df, none, limit), "pair_key", "via")) == taken
    assert selection.balanced_growth(df.where("false"), df, none, 5).count() == 0


def test_slots_need_room(spark):
    keys = spark.range(9).withColumnRenamed("id", "pair_key")
    with pytest.raises(ValueError):
        transitions.assign_slots(keys, 100, 8)
    out = transitions.assign_slots(keys, 100, 16).toPandas()
    assert out.slot.is_unique and out.slot.between(0, 15).all() and len(out) == 9


def test_wide_sketches_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(k, k % 7 + 1) for k in range(200)], "k long, v long")
    for signed in (False, True):
        cells = sketches.sketch(df, "k", "v", 64, signed)
        monkeypatch.setattr(sketches, "MOST_CELLS", 10**6)
        one = rows(sketches.estimate(df.select("k"), "k", cells, 64, signed))
        monkeypatch.setattr(sketches, "MOST_CELLS", 0)
        assert one == rows(sketches.estimate(df.select("k"), "k", cells, 64, signed)) and len(one) == 200


def test_token_arrays(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"]), (3, []), (4, None)], "id long, t array<string>")
    assert rows(tokens.adjacent_pairs(df, "t", "id"), "id", "left", "right") == [(1, "a", "b"), (1, "b", "c")]
    assert rows(tokens.adjacent_long(tokens.positions(df, "t", "id"), "id"), "id", "left", "right") == [(1, "a", "b"), (1, "b", "c")]
    assert rows(tokens.ngrams(df, "t", 3, "id"), "id") == [(1,)]
    assert rows(tokens.layout(tokens.positions(df, "t", "id"), "id")) == [(1, 3, 0), (2, 1, 3)]
    assert rows(tokens.drop_tokens(df, "t", ["a"]).where("id = 1"), "t") == [(["b", "c"],)]
    markers = spark.createDataFrame([("a", 7)], "marker string, lang_idx int")
    assert rows(tokens.split_markers(df, "t", markers).where("id < 3"), "id", "lang_idx", "t") == [(1, 7, ["b", "c"]), (2, -1, ["x"])]


def test_leftmost_and_words(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([True, True, True, False, True, True])], "s long, pos int, c boolean")
    assert [r["keep"] for r in tokens.leftmost(df, "s", "c").orderBy("pos").collect()] == [True, False, True, False, True, False]
    assert [r["word"] for r in tokens.word_ids(df, "s", df["c"]).orderBy("pos").collect()] == [0, 1, 2, 2, 3, 4]


def test_slots_collide_and_compact(spark):
    base, buckets = 1000, 8
    hashed = lambda a, b: (a * 2654435761 + b * 40503) % buckets
    same = [a * base + 1 for a in range(60) if hashed(a, 1) == hashed(0, 1)][:2]
    keys = spark.createDataFrame([(k,) for k in same], "pair_key long")
    out = transitions.assign_slots(keys, base, buckets)
    assert len({r["slot"] for r in out.collect()}) == 2 and out.where("moved").count() == 1
    assert rows(transitions.compact(out), "pair_key", "slot") == [(same[0], 0), (same[1], 1)]


def test_growth_folding_and_reclaiming(spark):
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "row long, v array<double>")
    assert rows(transitions.fold_rows(table, "row", "v", 4, 2)) == [(r, [(r + r + 4) / 2, 1.0]) for r in range(4)]
    old = spark.createDataFrame([(12, 0), (13, 1)], "pair_key long, slot long")
    assert rows(transitions.grow(old, spark.createDataFrame([(11,), (12,)], "pair_key long"))) == [(11, None, 0, True), (12, 0, 1, False), (13, 1, 2, False)]
    vec = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "token_id int, vec array<double>")
    assert rows(transitions.reclaim(vec, spark.createDataFrame([(2, [9.0])], "token_id int, vec array<double>"))) == [(1, [1.0]), (2, [9.0])]
    rules = spark.createDataFrame([(1, 2, 3), (2, 4, 5), (9, 4, 9), (50, 4, 5)], "token_id int, left int, right int")
    assert dict(rows(transitions.reclaim_problems(rules, 10))) == {2: "endpoint", 9: "recursive", 50: "out_of_range"}
    assert rows(tokens.expand_reclaimed(spark.createDataFrame([(1, [7, 1, 7])], "id int, t array<int>"), "t", spark.createDataFrame([(1, 2, 3)], "token_id int, left int, right int")), "t") == [([7, 2, 3, 7],)]


def test_rules(spark):
    none = spark.createDataFrame([], "token_id int, left int, right int, generation int, active boolean, span array<int>")
    first = transitions.next_rules(none, 4, spark.createDataFrame([(0, 1), (1, 2), (9, 1)], "left int, right int"), 1)
    assert rows(first, "left", "right", "outcome", "token_id") == [(0, 1, "accepted", 4), (1, 2, "accepted", 5), (9, 1, "unknown_parent", None)]
    rules = first.where("outcome = 'accepted'").selectExpr("cast(token_id as int) token_id", "left", "right", "generation", "true active", "span")
    second = transitions.next_rules(rules, 4, spark.createDataFrame([(4, 2), (0, 5), (0, 1)], "left int, right int"), 2)
    assert sorted(r["outcome"] for r in second.collect()) == ["accepted", "already_rule", "duplicate_span"]
    every = rules.unionByName(second.where("outcome = 'accepted'").selectExpr("cast(token_id as int) token_id", "left", "right", "generation", "true active", "span"))
    assert transitions.rule_problems(every, 4).count() == 0
    top = spark.createDataFrame([(6,)], "token_id int")
    kept = transitions.deactivate_unobserved(every, top, 2)
    assert kept.where("active").count() == 2
    table = [r.asDict() for r in kept.collect()]
    off = [r for r in table if not r["active"]][0]
    key = (off["left"] + off["right"]) * (off["left"] + off["right"] + 1) // 2 + off["right"]
    assert transitions.reactivate(table, [key], 4) == [off["token_id"]]
