from __future__ import annotations

import itertools
import json
import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from pairloom.operators import evaluate, init_table, matching, objective, pooling, telemetry


def token_rows(spark, sentences, lang=0):
    return spark.createDataFrame([(s, lang, i, t) for s, ts in enumerate(sentences) for i, t in enumerate(ts)], "sent_id long, lang_idx int, pos int, token_id long")


def table(spark, vectors):
    return spark.createDataFrame(list(vectors.items()), "token_id long, vec array<double>")


def test_collapse_by_hand(spark):
    toks, emb = token_rows(spark, [[1, 2], [1, 3]]), table(spark, {1: [2.0], 2: [4.0], 3: [6.0]})
    exact = spark.createDataFrame([(12, 20.0, [10.0])], "pair_key long, score double, m array<double>")
    out = dict((s, h[0]) for s, _, h in rows(pooling.pool("collapse", toks, emb, 1, base=10, exact=exact)))
    assert out[0] == pytest.approx(13.0, abs=1e-6) and out[1] == pytest.approx(4.0)
    bucket = (1 * 2654435761 + 3 * 40503) % 1
    hashed = spark.createDataFrame([(bucket, 20.0, [14.0])], "bucket long, score double, m array<double>")
    out = dict((s, h[0]) for s, _, h in rows(pooling.pool("collapse_dynamic", toks, emb, 1, base=10, exact=exact, hashed=hashed, buckets=1)))
    assert out[0] == pytest.approx(13.0, abs=1e-6) and out[1] == pytest.approx(18.0, abs=1e-6)


def test_shut_gates_give_the_mean(spark):
    toks, emb = token_rows(spark, [[1, 2, 1], [2]]), table(spark, {1: [2.0, 0.0], 2: [4.0, 1.0]})
    exact = spark.createDataFrame([(12, -80.0, [9.0, 9.0]), (21, -80.0, [9.0, 9.0])], "pair_key long, score double, m array<double>")
    a, b = (rows(pooling.pool(m, toks, emb, 2, **t)) for m, t in (("none", {}), ("collapse", {"base": 10, "exact": exact})))
    assert np.allclose([h for _, _, h in a], [h for _, _, h in b])


def test_modes(spark):
    toks, emb = token_rows(spark, [[1, 2]]).withColumn("word", F.col("pos").cast("long")), table(spark, {1: [1.0, 0.0], 2: [0.0, 1.0]})
    lang = lambda **c: spark.createDataFrame([(0, *c.values())], "lang_idx int, " + ", ".join(f"{k} {'array<array<double>>' if isinstance(v[0], list) else 'array<double>'}" for k, v in c.items()))
    codes, lc = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0])], "token_id long, code array<double>"), lang(lang_code=[0.5, 0.5])
    h = lambda mode, **t: rows(pooling.pool(mode, toks, emb, 2, **t))[0][2]
    assert h("none") == [0.5, 0.5] and h("wordpool") == [0.5, 0.5]
    assert h("centroid", centroids=lang(c=[1.0, 0.0])) == [-0.5, 0.5]
    assert h("diag", scales=lang(s=[2.0, 0.0])) == [1.0, 0.0]
    assert h("lowrank", factors=lang(l=[[1.0, 1.0]], r=[[3.0, 0.0]])) == [3.5, 0.5]
    assert h("bilinear", codes=codes, code_dims=2, readout=lang(readout=[[1.0, 0.0], [0.0, 1.0]])) == [1.0, 1.0]
    g = 2 / (1 + math.exp(-1))
    assert h("gate", codes=codes, lang_codes=lc) == pytest.approx([g / (g + 1), 1 / (g + 1)])
    sense = dict(codes=codes, lang_codes=lc, probes=[[1.0, 0.0], [0.0, -1.0]], sense_vectors=[[1.0, 0.0], [0.0, 1.0]], code_dims=2)
    p = math.exp(0.5) / (math.exp(0.5) + math.exp(-0.5))
    assert h("senses", **sense) == pytest.approx([0.5 + (p + 0.5) / 2, 0.5 + (1 - p + 0.5) / 2])
    assert h("hard", **sense) == pytest.approx([1.5, 0.5])
    assert sum(h("gate_senses", **sense)) == pytest.approx(2.0)
    own = spark.createDataFrame([(0, 1, [5.0, 5.0])], "lang_idx int, token_id long, row array<double>")
    assert h("split", rows=own, gate_value=0.5) == [1.5, 1.75] and h("fuse", rows=own) == [2.5, 3.0]
    moe = dict(slots=spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]])], "token_id long, deltas array<array<double>>"), mixture=lang(pi=[0.25, 0.75]))
    assert h("vocabmoe", **moe) == [0.625, 0.875]
    w = spark.createDataFrame([(0, 1, 3.0), (0, 2, 1.0)], "lang_idx int, token_id long, weight double")
    assert h("idfpool", weights=w) == [0.75, 0.25]
    grams = spark.createDataFrame([(0, [3.0, 3.0])], "bucket long, row array<double>")
    assert h("ngram", table=grams, buckets=1) == pytest.approx([4 / 3, 4 / 3])
    assert h("ngram_gate", table=grams, buckets=1, gates=spark.createDataFrame([(0, 0.0)], "lang_idx int, gate double")) == pytest.approx([1.0, 1.0])
    exact = spark.createDataFrame([(12, 5.0, [3.0, 4.0])], "pair_key long, score double, m array<double>")
    assert h("collapse_online", base=10, exact=exact) == pytest.approx([0.6, 0.8])
    rules = spark.createDataFrame([(2, 1, 1)], "token_id long, left long, right long")
    assert h("collapse_reclaimed", rules=rules, base=10, exact=exact) == [1.0, 0.0]
    merge = [{"token_id": 2, "left": 1, "right": 2, "generation": 1, "active": True, "span": [1, 2]}]
    assert h("collapse_recursive", rules=merge) == [0.0, 1.0]
    assert len(pooling.MODES) == 25
    with pytest.raises(ValueError):
        pooling.pool("other", toks, emb, 2)
    assert pooling.pool("none", toks.where("false"), emb, 2).count() == 0


def brute(scores):
    n = len(scores)
    out = []
    for pick in itertools.product([False, True], repeat=n):
        if not any(a and b for a, b in zip(pick, pick[1:])) and not any(p and s is None for p, s in zip(pick, scores)):
            out.append((sum(s for p, s in zip(pick, scores) if p), pick))
    return out


def test_matchings_against_all_of_them():
    rng = np.random.default_rng(0)
    for n in range(0, 7):
        scores = [None if rng.random() < 0.2 else float(x) for x in rng.normal(size=n)]
        every = brute(scores)
        assert matching.log_partition(scores)[0][-1] == pytest.approx(np.logaddexp.reduce([s for s, _ in every]))
        z = sum(math.exp(s) for s, _ in every)
        assert matching.marginals(scores) == pytest.approx([sum(math.exp(s) for s, p in every if p[e]) / z for e in range(n)])
        best = matching.best_matching(scores)
        assert sum(s for s, b in zip(scores, best) if b) == pytest.approx(max(s for s, _ in every))
    assert list(matching.best_matching([0.0])) == [False]
    assert list(matching.best_matching([2.0, 1.0], [False, True])) == [False, True]


def test_retokenizing(spark):
    rules = [{"token_id": 4, "left": 0, "right": 1, "generation": 1, "active": True, "span": [0, 1]}, {"token_id": 5, "left": 4, "right": 2, "generation": 2, "active": False, "span": [0, 1, 2]}]
    df = spark.createDataFrame([([0, 1, 2],), ([],), (None,)], "t array<int>")
    assert [r[0] for r in df.select(matching.retokenize("t", rules)).collect()] == [[4, 2], [], None]
    assert [r[0] for r in df.select(matching.greedy_spans("t", rules)).collect()] == [[5], [], None]


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    h, v = rng.normal(size=(4, 6)), rng.normal(size=(4, 6))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    _, du, _ = objective.contrastive(unit(h), unit(v), 17.0)
    got = objective.through_norm(h, du)
    step = 1e-6
    for i, k in ((0, 0), (2, 3), (3, 5)):
        plus, minus = h.copy(), h.copy()
        plus[i, k] += step
        minus[i, k] -= step
        want = (objective.contrastive(unit(plus), unit(v), 17.0)[0] - objective.contrastive(unit(minus), unit(v), 17.0)[0]) / (2 * step)
        assert got[i, k] == pytest.approx(want, abs=1e-6)


def test_gate_gradient_by_differences():
    rng = np.random.default_rng(2)
    e, m, g = rng.normal(size=(3, 4)), rng.normal(size=4), rng.normal(size=4)

    def pooled(p):
        n = (1 - p / 2) * (e[0] + e[1]) + e[2] + p * m
        return n / (3 - p)

    p, step = 0.4, 1e-6
    h = pooled(p)
    dh = g - (g @ h) / (h @ h) * h  # no part along h, as after a normalisation
    want = dh @ (pooled(p + step) - pooled(p - step)) / (2 * step)
    assert objective.gate_gradient(dh[None], m[None], e[0][None], e[1][None], np.array([3 - p]))[0] == pytest.approx(want, abs=1e-6)


def test_losses(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 0.0], [1.0, 0.0]), (0, 1, [0.0, 2.0], [0.0, 1.0]), (1, 0, None, [1.0, 0.0])], "batch_id long, slot int, anchor array<double>, positive array<double>")
    assert [(r["batch_id"], r["n"]) for r in objective.batch_losses(df).collect()] == [(0, 2)]


def test_initial_table(spark):
    x = np.random.default_rng(3).normal(size=(128, 32))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "token_id long, vec array<double>")
    got = np.array([r["vec"] for r in init_table.initial_table(df, 32, 16).orderBy("token_id").collect()])
    assert got.shape == (128, 16)
    z = np.arange(1, 129.0) ** -1
    w = 5e-5 / (5e-5 + z / z.sum())
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((x - x.mean(axis=0)) @ vt[1:17].T * w[:, None]), atol=1e-8)
    assert init_table.family_table(df, 100, 5, 32).count() == 105
    assert rows(init_table.concat_tables(df.where("token_id = 0"), df), "token_id") == [(0,)]


def test_nearest_against_brute_force(spark):
    x = np.random.default_rng(4).normal(size=(60, 5))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, None)], "id long, vec array<double>")
    out = evaluate.nearest(df.where("id < 7"), df.where("id >= 7").withColumnRenamed("id", "b"), "id", "b", block=9).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert {r["id"]: r["b"] for r in out} == {i: 7 + int((u[i] @ u[7:].T).argmax()) for i in range(7)}


def test_scores(spark):
    items = spark.createDataFrame([("t", "validation", "a", 0.2), ("t", "test", "a", 0.7), ("t", "test", "b", float("nan")), ("u", "validation", "a", 0.4)], "task string, split string, hf_subset string, main_score double")
    best = evaluate.main_scores(items)
    assert rows(best) == [("t", "a", 0.7), ("u", "a", 0.4)]
    assert dict(rows(evaluate.macro(best)))["all_tasks"] == pytest.approx(0.55)
    other = best.withColumn("main_score", F.lit(0.5))
    diffs = evaluate.paired(best, other)
    assert [round(x, 6) for _, _, x in rows(diffs)] == [-10.0, 20.0] or [round(x, 6) for _, _, x in rows(diffs)] == [20.0, -10.0]
    b = evaluate.bootstrap(diffs, 200).head()
    assert b["n"] == 2 and b["mean"] == pytest.approx(5.0) and b["win_rate"] == 0.5 and b["low"] <= b["mean"] <= b["high"]
    arr = spark.createDataFrame([([("a", 1.0), ("b", 2.0), (None, 3.0)],)], "s array<struct<hf_subset string, x double>>")
    assert [x["x"] for x in arr.select(evaluate.prune_subsets("s", ["a"]).alias("p")).head()["p"]] == [1.0, 3.0]


def test_telemetry(spark):
    steps = spark.createDataFrame([(0, 20, 12, 6, 3), (50, 0, 0, 0, 0), (100, 0, 0, 0, 0)], "step long, base_tokens long, candidate_pairs long, hits long, merged long")
    out = telemetry.window_metrics(steps).orderBy("window_id").collect()
    assert (out[0]["compression"], out[0]["hit_rate"], out[0]["n_steps"]) == (17 / 20, 0.5, 2) and out[1]["compression"] == 0.0
    values = spark.createDataFrame([(1.0, "g", "a"), (-3.0, "g", "a"), (4.0, "g", "b"), (None, "g", "b")], "x double, grp string, t string")
    s = telemetry.statistics(values, "x", "grp").head()
    assert (s["least"], s["median"], s["greatest"], s["positive"]) == (-3.0, 1.0, 4.0, pytest.approx(2 / 3))
    assert telemetry.latency(values.where("x = 4"), "x", "grp").head()["std"] == 0.0
    assert telemetry.gradient_norms(values, "x", "t", "grp").head()["norm"] == pytest.approx(math.sqrt(26))
    assert rows(spark.createDataFrame([("emb.w",), ("x.bias",), ("y",)], "n string").select(telemetry.parameter_group("n", [("emb.", "table"), ("*.bias", "bias")]))) == [("bias",), ("other",), ("table",)]
    same = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 2.0])], "token_id long, vec array<double>")
    assert telemetry.fusion_penalty(same, 2).head()[0] == 1.0


def test_files(spark, tmp_path):
    from pairloom.config import DiscoverySettings, StreamSpec, parse_roots, strict
    from pairloom.sources import catalog, sinks, tables

    for lang, n in (("eng_Latn", 12), ("fra_Latn", 5)):
        data = spark.createDataFrame([(f"a{i}", f"p{i}", i) for i in range(n)], "s1 string, s2 string, extra int").coalesce(1)
        data.write.option("parquet.block.row.count.limit", 4).parquet(str(tmp_path / "root" / lang / "train"))
    spec = StreamSpec("s", "r", "s1", "s2", path_component=0, temperature=0.7, language_map={"fra_Latn": "fre_Latn"})
    found = catalog.discover(spark, [spec], {"r": str(tmp_path / "root")})
    assert rows(found, "language_id", "usable_rows") == [("eng_Latn", 12), ("fre_Latn", 5)]
    with pytest.raises(ValueError, match="missing columns"):
        catalog.discover(spark, [StreamSpec("s", "r", "s1", "nope")], {"r": str(tmp_path / "root")})
    paths = [r["path"] for r in found.collect()]
    assert catalog.scan(spark, paths, "s1", "s2").count() == 17
    groups = catalog.footers(spark, paths).count()
    held = catalog.scan(spark, paths, "s1", "s2", 1).count()
    assert held == 17 if groups == 2 else held < 17

    picks = spark.createDataFrame([(1, "frequency", 9), (2, "frequency", 5)], "pair_key long, selector string, support_estimate long")
    record = sinks.write_list(picks, tmp_path / "sel.csv", {"protocol": "x"})
    assert record["rows"] == 2 and record["sha256"] == sinks.sha256_file(tmp_path / "sel.csv")
    assert tables.selection(spark, str(tmp_path / "sel.csv"), "frequency", 2).count() == 2
    with pytest.raises(ValueError):
        tables.selection(spark, str(tmp_path / "sel.csv"), "loss")
    with pytest.raises(ValueError):
        sinks.write_list(picks.where("false"), tmp_path / "none.csv")
    sinks.append_metrics([{"step": 1}, {"step": 2}], tmp_path / "m.jsonl", "run")
    with pytest.raises(ValueError):
        sinks.append_metrics([{"step": 2}], tmp_path / "m.jsonl", "run")
    with pytest.raises(FileExistsError):
        sinks.write_json({}, tmp_path / "m.jsonl", overwrite=False)
    assert rows(sinks.packed_mask(spark.createDataFrame([(0, True), (3, True), (9, True), (1, False)], "i long, f boolean"), "i", "f")) == [(0, 9), (1, 2)]
    assert spark.createDataFrame([([1.0, 1.0 + 2**-9],)], "v array<double>").select(sinks.to_bf16("v")).head()[0] == [1.0, 1.0]
    assert sinks.write_checked(picks, str(tmp_path / "t")) == 2

    (tmp_path / "r.json").write_text(json.dumps({"Task": {"scores": {"test": [{"hf_subset": "a", "languages": ["eng"], "main_score": 0.7}, {"hf_subset": "b", "f1": 0.5}], "validation": []}}}))
    assert rows(tables.results(spark, str(tmp_path / "r.json")), "task", "split", "hf_subset", "main_score") == [("Task", "test", "a", 0.7), ("Task", "test", "b", 0.5)]
    (tmp_path / "f.jsonl").write_text('{"lang": "x", "s1": ["a", "b", "c"]}\n')
    assert rows(tables.frozen_samples(spark, str(tmp_path / "f.jsonl"), 2)) == [("x", 0, "a"), ("x", 1, "b")]
    with pytest.raises(ValueError):
        tables.frozen_samples(spark, str(tmp_path / "f.jsonl"), 4)
    (tmp_path / "n.txt").write_text("b\n# c\n\na\n")
    assert tables.names(spark, str(tmp_path / "n.txt"), "a, z") == ["a", "z", "b"]
    for i in (1, 2, 10):
        (tmp_path / f"checkpoint-{i}").mkdir()
        (tmp_path / f"checkpoint-{i}" / "optimizer.pt").write_text("")
    assert [p.split("/")[-2] for p in sinks.keep_newest(tmp_path, 1)] == ["checkpoint-1", "checkpoint-2"]
    assert parse_roots(["a=/x"]) == {"a": "/x"}
    with pytest.raises(ValueError):
        strict(DiscoverySettings, {"budgets": 3})
    with pytest.raises(ValueError):
        DiscoverySettings(budget=10, candidate_capacity=5)


def test_pca_init_has_every_vector(spark, tmp_path):
    from pairloom.plans.vectors import pca_init

    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(700)], "vec_id long, embedding array<float>")
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = pca_init(spark, str(tmp_path))
    want = init_table.initial_table(vectors.select(F.col("vec_id").alias("token_id"), F.col("embedding").alias("vec")), 64, 16)
    want = want.select("token_id", *[F.round(F.abs(F.col("vec")[i]), 5).alias(f"v{i}") for i in (0, 15)])
    assert got.count() == 700 and rows(got) == rows(want)


def test_online_scores_every_pair(spark):
    toks, emb = token_rows(spark, [[1, 2, 3]]), table(spark, {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [1.0, 1.0]})
    left, right, weight = [[1.0, 0.0], [0.5, 0.5]], [[0.0, 1.0], [1.0, -1.0]], [2.0, 1.0]
    codes = pooling.edge_codes(emb, left, right, weight)
    hashed = spark.createDataFrame([(0, 0.25, [3.0, 4.0])], "bucket long, score double, m array<double>")
    bias = spark.createDataFrame([(0, 0.5)], "lang_idx int, bias double")
    e = {1: np.array([1.0, 0.0]), 2: np.array([0.0, 1.0]), 3: np.array([1.0, 1.0])}
    score = lambda a, b: 0.25 + (np.tanh(np.array(left) @ e[a]) * np.tanh(np.array(right) @ e[b]) * weight).sum() / math.sqrt(2)
    routed = pooling.route(pooling.adjacent(toks), 10, hashed=hashed, buckets=1, codes=codes)
    assert dict(rows(routed, "pos", "score")) == pytest.approx({0: score(1, 2), 1: score(2, 3)})
    want = (np.array([3.0, 4.0]) + (e[3] if score(1, 2) > score(2, 3) else e[1])) / 2
    online = dict(base=10, hashed=hashed, buckets=1, codes=codes, bias=bias)
    assert rows(pooling.pool("collapse_online", toks, emb, 2, **online))[0][2] == pytest.approx(list(want / np.linalg.norm(want)))
    exact = spark.createDataFrame([(23, -1.0, [9.0, 9.0])], "pair_key long, score double, m array<double>")
    mean = np.array([2.0, 2.0]) / math.sqrt(8)
    assert rows(pooling.pool("collapse_online_compiled", toks, emb, 2, exact=exact, **online))[0][2] == pytest.approx(list(mean))


def test_expected_l0_and_usage(spark):
    scores = spark.createDataFrame([(0.0,), (2.0,)], "score double")
    bias = spark.createDataFrame([(1.0,), (-1.0,)], "bias double")
    shift = 2 / 3 * math.log(0.1 / 1.1)
    want = sum(1 / (1 + math.exp(-(x - shift))) for x in (0.0, 2.0)) / 2
    assert telemetry.expected_l0(scores, bias).head()[0] == pytest.approx(want)
    for bad in (scores.where("false"), scores.withColumn("score", F.lit(float("nan")))):
        with pytest.raises(ValueError):
            telemetry.expected_l0(bad, bias)
    with pytest.raises(ValueError):
        telemetry.expected_l0(scores, bias, gamma=0.1)
    toks = spark.createDataFrame([(0, 1, 5), (0, 1, 6), (0, 1, 7), (0, 2, 5), (1, 3, 5)], "step int, sent_id int, token_id int")
    routed = spark.createDataFrame([(0, 0.5, 9), (0, 0.25, 9), (0, 1.0, None)], "step int, p double, bucket int")
    got = {r["step"]: (r["base_tokens"], r["candidate_pairs"], r["hits"], r["merged"]) for r in telemetry.usage(routed, toks).collect()}
    assert got == {0: (4, 2, 3, 1.75), 1: (1, 0, 0, 0.0)}
    assert rows(telemetry.touched(routed, "bucket")) == [(0, 1, 1)]


def test_arrays_and_rows_of_tokens_are_pooled_alike(spark, monkeypatch):
    """A row per token, an array per sentence, and tables too large to go to every worker give the same vectors."""
    sentences = [[1, 2, 1, 3], [2], [9, 9], []]
    long, emb = token_rows(spark, sentences), table(spark, {1: [2.0, 0.0], 2: [4.0, 1.0], 3: [0.5, -1.0]})
    short = spark.createDataFrame([(i, 0, t) for i, t in enumerate(sentences)], "sent_id long, lang_idx int, token_ids array<long>")
    exact = spark.createDataFrame([(12, 0.5, [9.0, 1.0]), (21, -0.25, [3.0, 3.0])], "pair_key long, score double, m array<double>")
    hashed = spark.createDataFrame([(0, 0.1, [1.0, 1.0])], "bucket long, score double, m array<double>")
    bound = pooling.MOST_TABLE_BYTES
    for mode, more in (("none", {}), ("collapse", {"base": 10, "exact": exact}), ("collapse_dynamic", {"base": 10, "exact": exact, "hashed": hashed, "buckets": 1, "shared_bias": 0.3}), ("collapse_online", {"base": 10, "exact": exact})):
        seen = []
        for most in (bound, 0):
            monkeypatch.setattr(pooling, "MOST_TABLE_BYTES", most)
            seen += [rows(pooling.pool(mode, t, emb, 2, **more)) for t in (long, short)]
        for other in seen[1:]:
            assert [r[:2] for r in other] == [r[:2] for r in seen[0]] and np.allclose([r[2] for r in other], [r[2] for r in seen[0]]), mode


def test_state_follows_rows(spark):
    from pairloom.operators import transitions

    state = spark.createDataFrame([(0, [1.0, 2.0], 3), (1, [3.0, 6.0], 4)], "row_id long, moment array<double>, step int")
    moved = spark.createDataFrame([(10, 1), (11, 1), (12, 0)], "new_row long, old_row long")
    assert rows(transitions.migrate_state(state, moved)) == [(10, [3.0, 6.0], 4), (11, [3.0, 6.0], 4), (12, [1.0, 2.0], 3)]
    with pytest.raises(ValueError):
        transitions.migrate_state(state, spark.createDataFrame([(10, 7)], "new_row long, old_row long"))
    rules = spark.createDataFrame([(5, 0, 1)], "token_id long, left long, right long")
    assert rows(transitions.parent_state(state.withColumnRenamed("row_id", "token_id"), rules, ["moment"])) == [(5, [2.0, 4.0])]
    assert rows(transitions.seed_rows(state, state.where("row_id = 1").withColumn("step", F.lit(9)), "row_id", ["step"]), "row_id", "step") == [(0, 3), (1, 9)]
    with pytest.raises(ValueError):
        transitions.seed_rows(state.where("row_id = 0"), state, "row_id", ["step"])


def test_reclaimed_tokens_in_arrays(spark):
    from pairloom.operators import tokens

    rules = spark.createDataFrame([(2, 0, 1)], "token_id long, left long, right long")
    df = spark.createDataFrame([([2, 3, 2],), ([],), (None,)], "t array<long>")
    assert [r[0] for r in tokens.expand_reclaimed(df, "t", rules).collect()] == [[0, 1, 3, 0, 1], [], None]
    with pytest.raises(ValueError):
        tokens.expand_reclaimed(df, "t", rules.unionByName(rules))
    with pytest.raises(ValueError):
        tokens.expand_reclaimed(df, "t", rules, 0)
