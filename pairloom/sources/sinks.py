"""Sinks: lists with manifests, append-only metrics, packed masks, and atomic JSON.

Lists of selected pairs are bounded by a budget, so they are one file; everything else is written by the tasks.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def sha256_file(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def sha256_json(value) -> str:
    """Digest of canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_json(value, path: str | Path, overwrite: bool = True) -> None:
    """Written beside and moved into place, so that a reader never sees half a file."""
    path = Path(path)
    if path.exists() and not overwrite:
        raise FileExistsError(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(f".{path.name}.part")
    with beside.open("w") as f:
        json.dump(value, f, indent=2, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)


def write_list(df: DataFrame, path: str | Path, manifest: dict | None = None) -> dict:
    """One CSV file with a header and, beside it, a manifest with its digest and rows. An empty list is an error."""
    path = Path(path)
    staged = path.with_name(f".{path.name}.staged")
    df.coalesce(1).write.mode("overwrite").csv(str(staged), header=True)
    part = next(staged.glob("part-*.csv"))
    with part.open() as f:
        rows = sum(1 for _ in f) - 1
    if rows < 1:
        shutil.rmtree(staged)
        raise ValueError("nothing to write")
    os.replace(part, path)
    shutil.rmtree(staged)
    record = {**(manifest or {}), "rows": rows, "sha256": sha256_file(path)}
    write_json(record, path.with_suffix(".manifest.json"))
    return record


def append_metrics(records: list[dict], path: str | Path, identity: str, step: str = "step") -> None:
    """Lines of JSON added to a file of the same ``identity``; steps must go up."""
    path = Path(path)
    known = [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []
    if any(x.get("identity") != identity for x in known):
        raise ValueError("the file is another run's")
    lines = known + [{**r, "identity": identity} for r in records]
    if any(a[step] >= b[step] for a, b in zip(lines, lines[1:])):
        raise ValueError("steps must go up")
    beside = path.with_name(f".{path.name}.part")
    beside.write_text("".join(json.dumps(x, sort_keys=True) + "\n" for x in lines))
    os.replace(beside, path)


def packed_mask(flags: DataFrame, index: str, flag: str) -> DataFrame:
    """(byte, bits): eight flags per byte, the lowest index in the lowest bit; missing flags are 0."""
    bit = F.when(F.col(flag), F.pow(F.lit(2), F.pmod(F.col(index), F.lit(8))).cast("int")).otherwise(0)
    return flags.groupBy(F.floor(F.col(index) / 8).alias("byte")).agg(F.sum(bit).cast("int").alias("bits"))


def to_bf16(vector: str):
    """Numbers rounded to 16-bit brain floats, to even."""

    def one(x: np.ndarray) -> list[float]:
        bits = np.asarray(x, "float32").view("uint32").astype("uint64")
        rounded = (bits + 0x7FFF + ((bits >> np.uint64(16)) & np.uint64(1))) & np.uint64(0xFFFF0000)
        return rounded.astype("uint32").view("float32").astype(float).tolist()

    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else one(x)), ArrayType(DoubleType()))(vector)


def write_checked(df: DataFrame, path: str) -> int:
    """Parquet written, read again and counted; a table that comes back with other rows is an error."""
    df.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.parquet(path)
    n = back.count()
    if n != df.count():
        raise ValueError(f"{path}: {n} rows came back")
    return n


def keep_newest(folder: str | Path, keep: int, pattern: str = "checkpoint-*", files: tuple[str, ...] = ("optimizer.pt", "rng_state.pth", "scheduler.pt")) -> list[str]:
    """Take resume files out of all but the newest ``keep`` checkpoints; what was removed."""
    found = sorted(Path(folder).glob(pattern), key=lambda p: int(p.name.rsplit("-", 1)[-1]))
    gone = [p / f for p in found[: max(0, len(found) - keep)] for f in files if (p / f).exists()]
    for p in gone:
        p.unlink()
    return [str(p) for p in gone]


def latency_report(models: DataFrame) -> DataFrame:
    """One row per model and batch size, the model's inventory repeated: of (name, inventory, latency: array)."""
    return models.select("name", "inventory.*", F.explode("latency").alias("_l")).select("*", "_l.*").drop("_l")
