"""Whole runs: the pair stream, saved models, evaluation suites, and the life of a vocabulary."""

from __future__ import annotations

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pairloom.config import StreamSettings, StreamSpec
from pairloom.functions import lemmas
from pairloom.plans import lifecycle, stream, suite
from pairloom.sources import model
from pairloom.sources.sinks import sha256_json


def specs(spark, root, texts=None):
    for name, lang, n in (("one", "eng_Latn", 24), ("one", "fra_Latn", 12), ("two", "rus_Cyrl", 9)):
        make = texts or (lambda i, lang=lang: (f"{lang} word{i} anchor", f"{lang} word{i} positive"))
        data = spark.createDataFrame([(*make(i), i) for i in range(n)], "s1 string, s2 string, extra int").coalesce(1)
        data.write.option("parquet.block.row.count.limit", 4).parquet(str(root / name / lang))
    one = StreamSpec("one", "r1", "s1", "s2", path_component=0, anchor_language="eng_Latn")
    return [one, StreamSpec("two", "r2", "s1", "s2", language_id="rus_Cyrl")], {"r1": str(root / "one"), "r2": str(root / "two")}


def test_training_batches(spark, tmp_path):
    listed, roots = specs(spark, tmp_path)
    settings = StreamSettings(seed=3, batch_size=4, source_temperature=0.5)
    out = stream.training_batches(spark, listed, roots, settings, 8, markers=True).toPandas()
    assert sorted(out.batch.unique()) == list(range(8)) and (out.groupby("batch").size() == 4).all()
    assert (out.groupby("batch").language.nunique() == 1).all() and (out.groupby("batch").source.nunique() == 1).all()
    one = out[out.source == "one"]
    assert one.anchor.str.startswith("__eng_Latn__ ").all() and all(p.startswith(f"__{lang}__ ") for p, lang in zip(one.positive, one.language))
    later = stream.training_batches(spark, listed, roots, StreamSettings(seed=3, batch_size=4, source_temperature=0.5, start_batch=5), 3, markers=True).toPandas()
    key = lambda df: sorted(zip(df.batch, df.slot, df.row_id))
    assert key(later) == key(out[out.batch >= 5])
    held = stream.training_batches(spark, listed, roots, StreamSettings(batch_size=2, holdout_row_groups=1), 40).toPandas()
    assert {r.split("#")[1] for r in held[held.language == "eng_Latn"].row_id} <= {str(i) for i in range(20)}
    assert stream.unmarked(stream.training_batches(spark, listed, roots, settings, 1), "anchor").count() == 4


def test_mixed_batches(spark, tmp_path):
    listed, roots = specs(spark, tmp_path)
    out = stream.training_batches(spark, listed, roots, StreamSettings(batch_size=8), 6, mixed=True).toPandas()
    assert sorted(out.batch.unique()) == list(range(6)) and (out.groupby("batch").size() <= 8).all()
    assert out.groupby("batch").source.nunique().max() == 2
    share = (out.source == "one").mean()
    assert 0.7 < share < 0.9  # 36 of 45 rows


def test_strict_batches_of_one_text(spark, tmp_path):
    listed, roots = specs(spark, tmp_path, texts=lambda i: ("same", f"p{i}"))
    with pytest.raises(ValueError, match="unique batch"):
        stream.training_batches(spark, listed, roots, StreamSettings(batch_size=2), 2, strict=True)
    with pytest.raises(ValueError, match="unique batch"):
        stream.training_batches(spark, listed, roots, StreamSettings(batch_size=4), 2, mixed=True, strict=True)
    padded = stream.training_batches(spark, listed, roots, StreamSettings(batch_size=2), 2).toPandas()
    assert (padded.groupby("batch").size() == 2).all()


def test_models_are_saved_and_checked(spark, tmp_path):
    emb = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.5])], "token_id long, vec array<double>")
    pairs = spark.createDataFrame([(5, 0, 0.25)], "pair_key long, slot int, score double")
    folder = str(tmp_path / "m")
    record = model.save_model(folder, {"dim": 2}, {"emb": emb, "pairs": pairs}, {"seed": 1})
    config, tables = model.load_model(spark, folder, run={"seed": 1})
    assert config == {"dim": 2} and rows(tables["emb"]) == rows(emb) and record["tables"]["emb"]["rows"] == 2
    assert model.table_digest(emb.repartition(3)) == model.table_digest(emb) != model.table_digest(emb.limit(1))
    with pytest.raises(ValueError, match="other settings"):
        model.load_model(spark, folder, run={"seed": 2})
    got = {r["name"]: (r["rows"], r["numbers"]) for r in model.inventory(spark, folder).collect()}
    assert got == {"emb": (2, 6), "pairs": (1, 3)}
    pairs.withColumn("score", F.lit(9.0)).write.mode("overwrite").parquet(f"{folder}/pairs")
    with pytest.raises(ValueError, match="pairs"):
        model.load_model(spark, folder)
    bad = spark.createDataFrame([(0, [1.0, float("nan")]), (1, [0.1, 0.5]), (2, None), (3, [0.5])], "token_id long, vec array<double>")
    assert rows(model.not_finite(bad, "vec", "token_id")) == [(0,), (2,)] and rows(model.not_bf16(bad, "vec", "token_id")) == [(0,), (1,), (2,)]
    assert model.not_bf16(model.checked_bf16(bad.where("token_id in (1, 3)"), "vec"), "vec", "token_id").count() == 0
    with pytest.raises(ValueError):
        model.checked_bf16(bad, "vec")


def suite_file(tmp_path, **more):
    frozen = ["fra_Latn-eng_Latn", "rus_Cyrl-eng_Latn"]
    freeze = {"policy": "target-to-english", "suffix": "-eng_Latn", "expected_count": 2, "sha256": sha256_json(frozen)}
    tasks = {"A": {"type": "BitextMining", "dataset": "d/a", "revision": "a" * 40, "subsets": freeze}, "B": {"type": "STS", "dataset": "d/b", "revision": "b" * 40}}
    path = tmp_path / "suite.json"
    path.write_text(json.dumps({"protocol": "p1", "benchmark": "x", "tasks": tasks, "reference_clean_excludes": ["B"], **more}))
    return path, freeze


def test_suite(tmp_path):
    path, freeze = suite_file(tmp_path)
    loaded = suite.load_suite(path, "p1")
    for wrong in ({"tasks": {}}, {"reference_clean_excludes": ["C"]}, {"reference_clean_excludes": ["A", "B"]}, {"tasks": {"A": {"type": "STS", "dataset": "d", "revision": "short"}}}, {"tasks": {"A": {"type": "STS"}}}, {"benchmark": ""}):
        with pytest.raises(ValueError):
            suite.load_suite(suite_file(tmp_path, **wrong)[0])
    with pytest.raises(ValueError):
        suite.load_suite(path, "p2")
    suite.check_tasks(loaded, loaded["tasks"])
    with pytest.raises(ValueError, match="revision"):
        suite.check_tasks(loaded, {**loaded["tasks"], "A": {**loaded["tasks"]["A"], "revision": "c" * 40}})
    with pytest.raises(ValueError, match="not resolved"):
        suite.check_tasks(loaded, {"A": loaded["tasks"]["A"]})
    subsets = {"rus_Cyrl-eng_Latn": ["rus-Cyrl", "eng-Latn"], "fra_Latn-eng_Latn": ["fra_Latn", "eng_Latn"], "eng_Latn-fra_Latn": ["eng_Latn", "fra_Latn"], "x": ["xxx_Latn", "eng_Latn"], "zh": ["zho-Hans"]}
    known = ["eng_Latn", "fra_Latn", "rus_Cyrl", "cmn_Hani"]
    covered = suite.covered_subsets(subsets, known, "BitextMining")
    assert covered == ["rus_Cyrl-eng_Latn", "fra_Latn-eng_Latn", "eng_Latn-fra_Latn", "zh"]
    assert suite.covered_subsets(subsets, ["xxx_Latn"], "Classification") == ["x"] and suite.covered_subsets({"a": ["eng-Latn", "fra-Latn"], "b": ["eng-Latn", "deu-Latn"]}, known, "Retrieval") == ["a"]
    with pytest.raises(ValueError):
        suite.covered_subsets(subsets, ["deu_Latn"], "STS")
    assert suite.frozen_subsets(covered, freeze) == ["fra_Latn-eng_Latn", "rus_Cyrl-eng_Latn"] and suite.frozen_subsets(covered, None) == covered
    with pytest.raises(ValueError):
        suite.frozen_subsets(covered[:1], freeze)
    assert suite.wanted_subsets("A", ["x", "y"], ["y", "z"], {"A": ["x"]}) == ["x"] and suite.wanted_subsets("B", ["x", "y"], ["y", "z"], {"A": ["x"]}) == ["y"]
    with pytest.raises(ValueError):
        suite.wanted_subsets("A", ["x"], ["q"])


def test_evaluation_goes_on_where_it_was(tmp_path):
    path, _ = suite_file(tmp_path)
    loaded, seen = suite.load_suite(path), []

    def evaluate(task, subsets):
        seen.append(task)
        if task == "B" and len(seen) == 2:
            raise RuntimeError("broke off")
        return {"s": 0.5 if task == "A" else 0.7, "bad": float("nan"), "flag": True}

    with pytest.raises(RuntimeError):
        suite.run_suite(loaded, evaluate, {"A": ["s"], "B": ["s"]}, tmp_path / "out")
    done = suite.run_suite(loaded, evaluate, {"A": ["s"], "B": ["s"]}, tmp_path / "out")
    assert seen == ["A", "B", "B"] and done["all_tasks"]["score"] == pytest.approx(0.6) and done["reference_clean"]["score"] == 0.5
    suite.run_suite(loaded, evaluate, {"A": ["other"], "B": ["s"]}, tmp_path / "out")
    assert seen[3:] == ["A"]  # other subsets are another result
    with pytest.raises(ValueError):
        suite.run_suite(loaded, lambda t, s: {"x": float("inf")}, {"A": [], "B": []}, tmp_path / "none")


def test_periodic_evaluation(tmp_path):
    seen = []
    make = lambda: suite.PeriodicEvaluation(lambda s: seen.append(s) or {"a": s / 10, "nan": float("nan")}, tmp_path, 20, 10)
    p = make()
    assert [p.at(s) for s in (0, 10, 20, 20)] == [{"a": 0.0}, None, {"a": 2.0}, {"a": 2.0}]
    assert make().at(20) == {"a": 2.0} and seen == [0, 20]
    with pytest.raises(ValueError):
        suite.PeriodicEvaluation(lambda s: {}, tmp_path, 15, 10)
    due = suite.every_n_steps(5)
    assert [due(s) for s in (0, 3, 5, 5, 10)] == [True, False, True, False, True]


REC = "pair_key long, lang_idx int, utility double, probability_sum double, support long, positive_support long"


def test_window_state(spark, tmp_path):
    records = spark.createDataFrame([(1, 0, 0.1, 1.0, 2, 1), (1, 2, 0.2, 1.0, 3, 1), (1, 2, 0.3, 1.0, 1, 1), (4, 1, -1.0, 0.5, 1, 0)], REC)
    window = lifecycle.snapshot(records)
    assert rows(window, "pair_key", "support") == [(1, 6), (4, 1)] and lifecycle.snapshot_problems(window, 3).count() == 0
    lifecycle.save_window(window, str(tmp_path / "w"), 3)
    back = lifecycle.load_window(spark, str(tmp_path / "w"), 3)
    assert rows(lifecycle.records_of(back), "pair_key", "lang_idx", "support") == [(1, 0, 2), (1, 2, 4), (4, 1, 1)]
    problem = lambda df, n=3: {r["pair_key"]: r["problem"] for r in lifecycle.snapshot_problems(df, n).collect()}
    assert problem(window, 2) == {1: "language_entry"} and problem(window.unionByName(window)) == {1: "repeated_key", 4: "repeated_key"}
    assert problem(window.withColumn("utility", F.col("utility") + 1e-6)) == {1: "sums", 4: "sums"} and problem(window.withColumn("support", F.lit(0).cast("long"))) == {1: "number", 4: "number"}
    assert problem(window.withColumn("languages", F.reverse("languages"))) == {1: "language_order"} and problem(window.withColumn("languages", F.concat("languages", "languages"))) == {1: "repeated_language", 4: "repeated_language"}
    with pytest.raises(ValueError):
        lifecycle.save_window(window, str(tmp_path / "x"), 2)
    twice = lifecycle.diagnostic_windows(records.withColumn("window_id", F.lit(0)).unionByName(records.withColumn("window_id", F.lit(1)))).where("pair_key = 4")
    assert rows(twice, "window_id", "support", "total_support") == [(0, 1, 1), (1, 1, 2)]
    assert lifecycle.replay_mismatches(records, records, ["pair_key", "lang_idx", "utility"], "support").count() == 0
    assert rows(lifecycle.replay_mismatches(records, records.where("pair_key = 1"), ["pair_key", "lang_idx", "utility"], "support"), "pair_key", "recorded", "replayed") == [(4, 1, None)]


RULES = "token_id int, left int, right int, generation int, active boolean, span array<int>"


def cantor(a, b):
    return (a + b) * (a + b + 1) // 2 + b


def test_reactivation_in_key_order(spark):
    """Against turns one by one: a part that comes back later does not help."""
    import random

    from pairloom.operators import transitions

    rng = random.Random(5)
    data, seen = [], set()
    while len(data) < 40:
        a, b = rng.randrange(10 + len(data)), rng.randrange(10 + len(data))
        if (a, b) not in seen:
            seen.add((a, b))
            data.append((10 + len(data), a, b, 1, rng.random() < 0.3, [a, b]))
    keys = [cantor(a, b) for _, a, b, *_ in data if rng.random() < 0.8]
    want = transitions.reactivate([dict(zip(("token_id", "left", "right", "generation", "active", "span"), r)) for r in data], keys, 10)
    out = lifecycle.reactivated(spark.createDataFrame(data, RULES), spark.createDataFrame([(k,) for k in keys], "pair_key long"), 10)
    assert sorted(r["token_id"] for r in out.collect()) == sorted(want) and len(want) > 3


def half(spark, *pairs):
    return spark.createDataFrame([(cantor(a, b), 0, 5.0, 1.0, 40, 40) for a, b in pairs], REC)


def test_decisions(spark, tmp_path):
    rules = spark.createDataFrame([(10, 0, 1, 1, True, [0, 1]), (11, 10, 2, 2, True, [0, 1, 2]), (12, 3, 4, 1, True, [3, 4]), (13, 5, 6, 1, False, [5, 6])], RULES)
    used = lifecycle.observed_tokens(spark.createDataFrame([(11,)], "token_id int"), spark.createDataFrame([(2,), (11,)], "token_id int"))
    grown = [(5, 6), (10, 3), (7, 7), (12, 0), (0, 1)]
    out, counts = lifecycle.decide(half(spark, *grown), half(spark, *grown, (8, 8)), used, rules, 10, lifecycle.LifecycleSettings(), tmp_path, 100)
    state = {r["token_id"]: (r["left"], r["right"], r["active"]) for r in out.collect()}
    assert {t: a for t, (_, _, a) in state.items() if t < 14} == {10: True, 11: True, 12: False, 13: True}  # 12 is not used, 13 comes back
    assert sorted(v for t, v in state.items() if t >= 14) == [(7, 7, True), (10, 3, True)]
    assert (counts["deactivated"], counts["reactivated"], counts["added"], counts["selected"], counts["refused"]) == (1, 1, 2, 4, {"unknown_parent": 1})
    assert json.loads((tmp_path / "decision-100.json").read_text())["active"] == 5
    with pytest.raises(FileExistsError):
        lifecycle.decide(half(spark, *grown), half(spark, *grown), used, rules, 10, lifecycle.LifecycleSettings(), tmp_path, 100)
    _, kept = lifecycle.decide(half(spark, *grown), half(spark, *grown), used, rules, 10, lifecycle.LifecycleSettings(bidirectional=False))
    assert (kept["deactivated"], kept["reactivated"], kept["active"]) == (0, 0, 6)  # three and (7, 7), (10, 3), (12, 0)
    bounded, counts = lifecycle.decide(half(spark, *grown), half(spark, *grown), used, rules, 10, lifecycle.LifecycleSettings(selector="balanced", target_rows=3))
    assert counts["active"] <= 3 and counts["selected"] == 1
    with pytest.raises(ValueError, match="bytes"):
        lifecycle.decide(half(spark, *grown), half(spark, *grown), used, rules, 10, lifecycle.LifecycleSettings(max_bytes=10, dim=4))
    with pytest.raises(ValueError):
        lifecycle.LifecycleSettings(selector="balanced")
    one = lifecycle.rule_counts(rules).head()
    assert (one["learned"], one["active"], one["generation"]) == (4, 3, 2) and lifecycle.rule_counts(rules.repartition(3)).head()["digest"] == one["digest"]


def test_telemetry_windows(spark, tmp_path):
    steps = spark.createDataFrame([(0, 20, 12, 6, 3), (10, 10, 8, 2, 1)], "step long, base_tokens long, candidate_pairs long, hits long, merged long")
    parameters = spark.createDataFrame([(0, "table", float(i)) for i in range(50)] + [(1, "table", 2.0)], "window_id long, group string, value double")
    gradients = spark.createDataFrame([(0, "table", "a", 3.0), (0, "gates", "b", -4.0), (1, "table", "a", 0.5)], "window_id long, group string, tensor string, value double")
    settings = lifecycle.TelemetrySettings("exact", 10, 1.0, 20)
    out = {r["window_id"]: r for r in lifecycle.flush(steps, parameters, gradients, settings).collect()}
    assert out[0]["norm"] == pytest.approx(5.0) and out[0]["clip"] == pytest.approx(0.2) and out[1]["clip"] == 1.0
    assert out[0]["gradients"]["gates"] == pytest.approx(4.0) and out[1]["parameters"]["table"]["mean"] == 2.0 and out[0]["merged"] == 3
    with pytest.raises(ValueError):
        lifecycle.flush(steps, parameters, gradients.withColumn("value", F.lit(float("nan"))), settings)
    (tmp_path / "c.json").write_text("{}")
    with pytest.raises(ValueError, match="corpus"):
        lifecycle.TelemetrySettings("exact", corpus_manifest=str(tmp_path / "c.json"), corpus_sha256="0" * 64)
    with pytest.raises(ValueError):
        lifecycle.TelemetrySettings("other")


def test_terms_by_language(spark, monkeypatch):
    class Lemmas:
        @staticmethod
        def lemmatize(word, lang):
            return {"running": "run", "dogs": "Dog"}.get(word, word)

    class Stops:
        @staticmethod
        def stopwords(lang):
            return {"The", "ＡＮＤ"}

    monkeypatch.setattr(lemmas, "library", {"simplemma": Lemmas, "stopwordsiso": Stops}.get)
    for f in (lemmas.stop_words, lemmas.lemma, lemmas._russian, lemmas._japanese):
        f.cache_clear()
    assert lemmas.lemma_terms_of("The running DOGS and a dog", "eng_Latn") == ["dog", "run"]
    assert lemmas.lemma_terms_of("The dogs", "eng_Latn", stops=False) == ["dog", "the"]
    assert lemmas.lemma_terms_of("kiswahili words", "xyz_Latn", fallback="reject") == [] and lemmas.lemma_terms_of("two words", "xyz_Latn") == ["two", "words"]
    assert lemmas.lemma_terms_of("ab1c", "cmn_Hani") == ["ab", "bc"] and lemmas.lemma_terms_of("ab", "jpn_Jpan") == ["ab"]
    with pytest.raises(ValueError):
        lemmas.lemma_terms_of("x", "eng", fallback="other")
    for f in (lemmas.stop_words, lemmas.lemma, lemmas._russian, lemmas._japanese):
        f.cache_clear()
    df = spark.createDataFrame([("two words", "eng_Latn"), (None, "eng_Latn"), ("", None)], "t string, lang string")
    assert [r[0] for r in df.select(lemmas.lemma_terms("t", "lang")).collect()] == [["two", "words"], [], []]
    assert len(lemmas.LEMMA_LANGUAGES) == 53 and len(lemmas.STOP_WORD_LANGUAGES) == 64


def test_side_languages(spark):
    from pairloom.operators import evaluate

    df = spark.createDataFrame([(["eng-Latn", "zho-Hans"],), (["fra_Latn"],), ([],), (["a_A", "b_B", "c_C"],)], "langs array<string>")
    got = lambda kind, side: [r[0] for r in df.select(evaluate.side_language("langs", kind, side)).collect()]
    assert got("bitext", "sentence2") == ["cmn_Hani", "fra_Latn", None, None] and got("sts", "sentence1") == ["eng_Latn", "fra_Latn", None, None]
    assert got("retrieval", "document") == ["cmn_Hani", "fra_Latn", None, "a_A"] and got("classification", "text") == ["eng_Latn", "fra_Latn", None, "a_A"]
    with pytest.raises(ValueError):
        evaluate.side_language("langs", "bitext", "left")


def test_scores_of_matches(spark):
    from pairloom.operators import evaluate

    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, None), (None, 1)], "gold int, found int")
    one = evaluate.matching_scores(df, "gold", "found").head()
    assert (one["n"], one["accuracy"], one["recall"]) == (4, 0.5, 0.5) and one["precision"] == pytest.approx((2 * 1 + 1 * 0.5) / 4) and one["f1"] == pytest.approx((2 * (2 / 3) + 2 / 3) / 4)
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (4.0, 4.0), (None, 1.0)], "s double, g double")
    import pandas as pd

    frame = pd.DataFrame({"s": [1, 2, 3, 4], "g": [2, 2, 5, 4]})
    got = evaluate.correlations(pairs, "s", "g").head()
    assert got["n"] == 4 and got["pearson"] == pytest.approx(frame.corr().iloc[0, 1]) and got["spearman"] == pytest.approx(frame.rank().corr().iloc[0, 1])


def test_checks_of_settings_and_lists(spark, tmp_path):
    from pairloom.config import DiscoverySettings, language_indices, promotion_step
    from pairloom.operators import pooling, selection, telemetry
    from pairloom.sources import sinks, tables

    assert language_indices(["a", "b", "c"], ["c", "a"]) == [0, 2] and language_indices(["a", "b"]) == [0, 1]
    for languages, trained in ((["a"], ["z"]), (["a", "a"], None)):
        with pytest.raises(ValueError):
            language_indices(languages, trained)
    settings = DiscoverySettings(promotion_step=10)
    assert promotion_step(settings, 10) == 10 and promotion_step(settings, 9) is None
    with pytest.raises(ValueError):
        promotion_step(settings, 5)
    keys = spark.createDataFrame([(1, "frequency", 5), (3, "frequency", 4)], "pair_key long, selector string, support_estimate long")
    sinks.write_list(keys, tmp_path / "s.csv")
    digest = sinks.sha256_file(tmp_path / "s.csv")
    assert tables.strict_keys(tables.selection(spark, str(tmp_path / "s.csv"), "frequency", 2, digest), "pair_key", True).count() == 2
    with pytest.raises(ValueError, match="digest"):
        tables.selection(spark, str(tmp_path / "s.csv"), sha256="0" * 64)
    for bad in ([(3,), (1,)], [(1,), (1,)], [(1,), (None,)]):
        with pytest.raises(ValueError):
            tables.strict_keys(spark.createDataFrame(bad, "pair_key long").coalesce(1), "pair_key", True)
    with pytest.raises(ValueError):
        pooling.ngram(None, None, 2, None, 4, (1,))
    with pytest.raises(ValueError):
        selection.stable_growth(keys, keys, keys, 0)
    mixture = spark.createDataFrame([(0, [0.5, 0.5]), (1, [1.0, 0.0])], "lang_idx int, pi array<double>")
    assert telemetry.assignment_entropy(mixture).head()[0] == pytest.approx(0.5 * 0.6931471805599453)
    assert telemetry.gate_penalty(spark.createDataFrame([(-1.0,), (0.5,)], "gate double")).head()[0] == 0.75
    assert rows(telemetry.token_usage(spark.createDataFrame([(1,), (9,), (9,)], "token_id long"), least=5)) == [(9, 2)]
    ran = []
    assert len(telemetry.timed(lambda: ran.append(1), 2, 3)) == 3 and len(ran) == 5
    with pytest.raises(ValueError):
        telemetry.timed(lambda: None, 0, 0)
