from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import DATA, same  # noqa: E402

from pairloom.llm.queries import ORACLES, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert df.count() > 0 or name == "p4_found"


def test_found_columns(spark):
    want = {"p1_found": {"pair_key"}, "p2_found": {"pair_id", "side", "item_id"}, "p4_found": {"pair_id_1", "pair_id_2", "side"}, "p5_found": {"pair_id", "lang"}, "p8_found": {"doc_id"}}
    for name, columns in want.items():
        assert set(QUERIES[name](spark, str(DATA)).columns) == columns
