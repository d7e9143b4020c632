"""A session with the settings that the operators expect: UTC, adaptive execution, ANSI arithmetic left on."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .storage import scratch

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(master: str | None = None, name: str = "pairloom", **more: str) -> SparkSession:
    """The session; without ``master`` the one that the launcher set. ``more``: settings, with ``_`` for ``.``."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("_", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the workers, once per application, so that they need no path of their own to it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    target = Path(scratch(spark, "code").removeprefix("file:") + ".zip")
    if "://" in str(target) or not target.parent.exists():  # not a folder that the driver can write as a file
        return
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, os.path.join(root.name, f.relative_to(root)))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
