"""Tables that are folders of files, as Spark writes them, are read like one file."""

from __future__ import annotations

import pytest
from conftest import rows

from pairloom.config import StreamSettings, StreamSpec
from pairloom.plans import stream
from pairloom.plans.catalog import QUERIES
from pairloom.sources import catalog


@pytest.fixture
def folder(spark, tmp_path):
    """A table ``pairs.parquet`` of 3 files with 8, 8 and 4 rows, in a folder with a space, beside another table."""
    root = tmp_path / "a table+"
    for k, n in enumerate((8, 8, 4)):
        data = spark.createDataFrame([(f"anchor {k} {i}", f"positive {k} {i}") for i in range(n)], "anchor string, positive string").coalesce(1)
        data.write.option("parquet.block.row.count.limit", 4).parquet(str(tmp_path / f"{k}"))
        (root / "pairs.parquet").mkdir(parents=True, exist_ok=True)
        next((tmp_path / f"{k}").glob("part-*")).rename(root / "pairs.parquet" / f"part-{k}.parquet")
    spark.range(3).write.parquet(str(root / "other.parquet"))
    return root


def test_discovered_folder(spark, folder):
    size = sum(f.stat().st_size for f in (folder / "pairs.parquet").glob("*.parquet"))
    assert [(r["path"].endswith("/a table+/pairs.parquet"), r["bytes"]) for r in catalog.files(spark, str(folder), "pairs.parquet").collect()] == [(True, size)]
    assert rows(QUERIES["discovered_shards"](spark, str(folder))) == [("pairs", 20, 2.0, "")]
    assert catalog.files(spark, str(folder), "part-*.parquet").where("path LIKE '%/pairs.parquet/%'").count() == 3  # files that match by themselves stay files


def test_scanned_folder(spark, folder):
    assert rows(QUERIES["scanned_pairs"](spark, str(folder))) == [("pairs.parquet", 20, 20, 20 * len("positive 0 0"), 19)]
    path = str(folder / "pairs.parquet")
    found = catalog.scan(spark, [path], "anchor", "positive")
    assert {r["row_index"]: r["anchor"] for r in found.collect()} == {n: f"anchor {n // 8} {n % 8}" for n in range(20)}
    groups = catalog.footers(spark, [str(f) for f in sorted((folder / "pairs.parquet").glob("*.parquet"))]).orderBy("path", "row_group").collect()
    assert catalog.scan(spark, [path], "anchor", "positive", 1).count() == 20 - groups[-1]["rows"]  # the table's last group, not each file's


def test_batches_of_a_folder(spark, folder):
    spec = StreamSpec("pairs", "tables", "anchor", "positive", parquet="pairs.parquet", language_id="")
    out = stream.training_batches(spark, [spec], {"tables": str(folder)}, StreamSettings(batch_size=4), 5).toPandas()
    assert sorted(int(r.rpartition("#")[2]) for r in out.row_id) == list(range(20))
    assert {r.rpartition("#")[0] for r in out.row_id} == {str(folder / "pairs.parquet")}
