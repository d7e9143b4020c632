from __future__ import annotations

import json

import pytest
from conftest import rows

from pairloom import cli
from pairloom.config import DiscoverySettings
from pairloom.plans import pipeline
from pairloom.sources import tables

REC = "window_id int, pair_key long, lang_idx int, utility double, probability_sum double, support long, positive_support long"


def test_discovery_to_slots(spark, tmp_path):
    data = spark.createDataFrame([(0, 102, 0, 5.0, 1.0, 40, 40), (0, 203, 1, 4.0, 1.0, 40, 40), (1, 203, 1, 4.0, 1.0, 40, 40), (0, 304, 0, -1.0, 1.0, 40, 0)], REC)
    out = pipeline.discover_and_promote(data, DiscoverySettings(budget=2, candidate_capacity=4, per_language_quota=1), 100, 16, tmp_path)
    assert rows(out["selected"], "pair_key", "utility") == [(102, 5.0), (203, 8.0)]
    assert rows(out["slots"], "pair_key", "slot") == [(102, 0), (203, 1)]
    assert json.loads((tmp_path / "selected.manifest.json").read_text())["rows"] == 2
    record = pipeline.frequency_selection(spark, str(tmp_path / "candidates.csv"), str(tmp_path / "freq.csv"), 2)
    assert record["rows"] == 2 and record["last_support"] == 40
    assert tables.selection(spark, str(tmp_path / "freq.csv"), "frequency", 2).count() == 2
    assert pipeline.materialize_selection(spark, str(tmp_path / "freq.csv"), 100, 16, "frequency", 2).count() == 2
    with pytest.raises(ValueError):
        pipeline.frequency_selection(spark, str(tmp_path / "candidates.csv"), str(tmp_path / "x.csv"), 99)


def test_growth_over_windows(spark, tmp_path):
    data = spark.createDataFrame([(w, k, 0, 5.0, 1.0, 40, 40) for w in range(3) for k in (10, 20 + w // 2)], REC)
    old = spark.createDataFrame([(5, 0)], "pair_key long, slot long")
    out = pipeline.grow_over_windows(data, old, [0, 1, 2], folder=tmp_path)
    assert sorted(rows(out)) == [(5, 0), (10, 1), (20, 2)]
    assert json.loads((tmp_path / "decision-2.json").read_text())["not_consecutive"] == 1


def test_corpus_pairs(spark):
    texts = spark.createDataFrame([("Alpha beta, alpha beta gamma", "x"), (None, "x"), ("", None)], "text string, lang string")
    vocab = spark.createDataFrame([(0, "alpha"), (1, "beta")], "token_id int, piece string")
    assert rows(pipeline.corpus_pairs(texts, vocab, 10)) == [(1, "x", 2), (10, "x", 1)]


def test_compare(spark, tmp_path, capsys):
    for name, score in (("a", 0.7), ("b", 0.5)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "T.json").write_text(json.dumps({"scores": {"test": [{"hf_subset": "x", "languages": ["eng"], "main_score": score}]}}))
    cli.main(["compare", str(tmp_path / "a"), str(tmp_path / "b"), "--resamples", "50"])
    assert abs(json.loads(capsys.readouterr().out.strip().splitlines()[-1])["mean"] - 20) < 1e-9


def test_corpus_pairs_of_every_script(spark):
    from pairloom.plans import pipeline

    texts = spark.createDataFrame([("rus", "Старый мост"), ("pol", "żółty most"), ("cmn", "长报告"), ("hin", "पुराना पुल"), ("eng", "Old bridge")], "lang string, text string")
    pieces = ["старый", "мост", "żółty", "most", "长", "报", "告", "पुराना", "पुल", "old", "bridge"]
    vocab = spark.createDataFrame(list(enumerate(pieces)), "token_id int, piece string")
    got = {(r["pair_key"], r["lang"], r["n"]) for r in pipeline.corpus_pairs(texts, vocab, 100).collect()}
    assert got == {(1, "rus", 1), (203, "pol", 1), (405, "cmn", 1), (506, "cmn", 1), (708, "hin", 1), (910, "eng", 1)}
