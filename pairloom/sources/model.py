"""Models as folders of tables: saved with a manifest, loaded with checks, counted and compared."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize
from .sinks import sha256_json

MANIFEST = "manifest"


def table_digest(table: DataFrame) -> tuple[int, str]:
    """Rows and a digest of a table's values that does not depend on their order."""
    columns = sorted(table.columns)
    kinds = dict(table.dtypes)
    h = F.xxhash64(*[F.to_json(F.struct(c)) if kinds[c].startswith("map") else F.col(c) for c in columns])
    row = table.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).head()
    return row["n"], sha256_json([columns, row["n"], str(row["s"]), str(row["x"])])


def save_model(folder: str, config: dict, tables: dict[str, DataFrame], run: dict | None = None) -> dict:
    """Tables as Parquet below ``folder`` and a manifest with their rows, columns and digests, the config and the run's settings.

    A folder that has a model already is an error. The manifest is written last, so a folder without one is no model.
    Arrays that are compiled from other tables need not be saved.
    """
    if not tables:
        raise ValueError("a model has tables")
    spark = next(iter(tables.values())).sparkSession
    record: dict = {"config": config, "run": run or {}, "tables": {}}
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{folder}/{name}")
        n, digest = table_digest(spark.read.parquet(f"{folder}/{name}"))
        record["tables"][name] = {"rows": n, "columns": dict(table.dtypes), "digest": digest}
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/{MANIFEST}")
    return record


def manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/{MANIFEST}").head()["value"])


def load_model(spark: SparkSession, folder: str, verify: bool = True, run: dict | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """(config, tables) of a saved model. Other rows, columns or, with ``verify``, values than its manifest says are an error.

    So are other settings than ``run``, if these are given: a run goes on only under those that it was saved with.
    """
    record = manifest(spark, folder)
    if run is not None and record["run"] != run:
        raise ValueError(f"{folder}: saved under other settings")
    tables = {}
    for name, about in record["tables"].items():
        table = spark.read.parquet(f"{folder}/{name}")
        if dict(table.dtypes) != about["columns"]:
            raise ValueError(f"{folder}/{name}: columns {table.dtypes}")
        n, digest = table_digest(table) if verify else (table.count(), about["digest"])
        if n != about["rows"] or digest != about["digest"]:
            raise ValueError(f"{folder}/{name}: {n} rows, other values than were saved")
        tables[name] = table
    return record["config"], tables


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(name, rows, numbers, bytes, digest) of a model's tables; ``numbers`` counts elements of number columns and arrays."""
    record = manifest(spark, folder)
    out = []
    for name, about in record["tables"].items():
        table = spark.read.parquet(f"{folder}/{name}")
        counted = [F.coalesce(F.sum(F.size(c)), F.lit(0)) if kind.startswith("array<") else F.count(c) for c, kind in table.dtypes if kind.split("<")[-1].rstrip(">") in ("int", "bigint", "float", "double", "tinyint", "smallint")]
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{folder}/{name}").agg(F.sum("length")).head()[0]
        numbers = table.agg(sum(counted, F.lit(0)).cast("long")).head()[0] if counted else 0
        out.append((name, about["rows"], numbers, files or 0, about["digest"]))
    return spark.createDataFrame(out, "name string, rows long, numbers long, bytes long, digest string")


def not_finite(table: DataFrame, vector: str, row: str) -> DataFrame:
    """Rows whose vector has a null, a NaN or an infinity, or is null itself."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return table.where(F.coalesce(bad, F.lit(True))).select(row)


def not_bf16(table: DataFrame, vector: str, row: str) -> DataFrame:
    """Rows whose vector holds a number that 16 bits of a brain float do not, or one that is not finite."""
    from .sinks import to_bf16

    rounded = table.select(row, F.col(vector).cast("array<double>").alias("_v"), to_bf16(vector).alias("_r"))
    off = F.exists(F.zip_with("_v", "_r", lambda a, b: ~a.eqNullSafe(b)), lambda x: x)
    return rounded.where(off).select(row).unionByName(not_finite(table, vector, row)).distinct()


def checked_bf16(table: DataFrame, vector: str) -> DataFrame:
    """``table`` with its vectors rounded to brain floats, written and read again; one that is not finite is an error."""
    from .sinks import to_bf16

    first = table.columns[0]
    if not_finite(table, vector, first).head():
        raise ValueError(f"{vector} is not finite")
    return materialize(table.withColumn(vector, to_bf16(vector)))
