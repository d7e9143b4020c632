"""Catalog of pair files: discovery, languages from paths, row counts from footers, and the pair scan itself."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import accumulate
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import StreamSpec
from ..operators.filters import languages_kept
from ..operators.sampling import language_weights

FOOTERS = "path string, row_group int, start long, rows long"
#: Footers that the driver reads at a time.
READERS = 16


def _plain(path: str):
    """A path without the scheme of local files, which Spark spells in more than one way."""
    return F.regexp_replace(path, "^file:/*", "/")


def _file() -> Column:
    """The path of a row's file, as listings spell it; Spark's metadata has it as a URI."""
    return F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))


def files(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, bytes) of all tables under ``root``, listed by Spark; nothing but the listing is read.

    A table is a file whose name matches, or a folder whose name matches and that holds files of other names, as Spark
    writes them; of folders in each other it is the outermost.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    name = f"^(?:{jvm.org.apache.hadoop.fs.GlobPattern(pattern.rsplit('/', 1)[-1]).compiled().pattern()})$"
    top = jvm.org.apache.hadoop.fs.Path(root)
    depth = len(top.getFileSystem(conf).makeQualified(top).toString().rstrip("/").split("/"))
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(depth + 1), F.greatest(F.size(parts) - depth - 1, F.lit(0)))
    at = F.array_min(F.transform(folders, lambda x, i: F.when(x.rlike(name), i + depth + 1)))
    table = F.when(F.element_at(parts, -1).rlike(name), F.col("path")).when(at.isNotNull(), F.array_join(F.slice(parts, F.lit(1), at), "/"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(table.alias("path"), "length")
    return found.where("path IS NOT NULL").groupBy("path").agg(F.sum("length").alias("bytes"))


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).parquet(*paths)


def _members(read: DataFrame, paths: list[str]) -> dict[str, list[str]]:
    """The files of each of ``paths`` that is a folder, in order."""
    plain = lambda p: re.sub("^file:/*", "/", p).rstrip("/")
    tables, out = {plain(p): p for p in paths}, {}
    for f in sorted(plain(unquote(f)) for f in read.inputFiles()):
        at = f
        while at and at not in tables:
            at = at.rpartition("/")[0]
        if at and at != f:
            out.setdefault(tables[at], []).append(f)
    return out


def _file_rows(read: DataFrame) -> DataFrame:
    return read.groupBy(_file().alias("path")).agg(F.count("*").alias("usable_rows"))


def row_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, usable_rows): no column is read, so Spark takes the rows from the footers, in its tasks."""
    read = _read(spark, paths)
    members = _members(read, paths)
    if not members:
        return _file_rows(read)
    tables = spark.createDataFrame([(f, t) for t, own in members.items() for f in own], "_p string, _t string")
    rows = _file_rows(read).withColumn("_p", _plain("path")).join(tables, "_p", "left")
    return rows.groupBy(F.coalesce("_t", "path").alias("path")).agg(F.sum("usable_rows").alias("usable_rows"))


def footers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, row_group, start, rows) from the files' footers, read through Spark's own file systems.

    One small read per listed file, ``READERS`` at a time, from the driver: a catalog's files, not its rows.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def read(path: str) -> list[tuple]:
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        try:
            sizes = [b.getRowCount() for b in reader.getFooter().getBlocks()]
        finally:
            reader.close()
        return [(path, g, sum(sizes[:g]), n) for g, n in enumerate(sizes)]

    with ThreadPoolExecutor(READERS) as pool:
        rows = [r for found in pool.map(read, paths) for r in found]
    return spark.createDataFrame(rows, FOOTERS)


def languages_of(listed: DataFrame, spec: StreamSpec, root: str) -> DataFrame:
    """``listed`` with ``language_id``: the spec's own, or the path's component below the root, renamed by its map."""
    if spec.language_id is not None:
        return listed.withColumn("language_id", F.lit(spec.language_id))
    if spec.path_component is None:
        return listed.withColumn("language_id", F.lit(""))
    below = F.regexp_replace(_plain("path"), f"^{root.rstrip('/')}/", "")
    part = F.try_element_at(F.split(below, "/"), F.lit(spec.path_component + 1))
    if spec.language_map:
        renamed = F.create_map(*[F.lit(x) for kv in spec.language_map.items() for x in kv])
        part = F.coalesce(F.try_element_at(renamed, part), part)
    return listed.withColumn("language_id", part)


def discover(spark: SparkSession, specs: list[StreamSpec], roots: dict[str, str], seed: int = 0) -> DataFrame:
    """Shards (source, path, anchor_column, positive_column, sampling_weight, language_id, anchor_language_id, bytes, usable_rows) in a seeded order.

    A root that is not given, has no file or whose files lack a column is an error that names it.
    """
    parts = []
    for spec in specs:
        if spec.root not in roots:
            raise ValueError(f"{spec.name}: no root {spec.root}")
        root = roots[spec.root]
        listed = languages_of(files(spark, root, spec.parquet), spec, root)
        listed = listed.where(languages_kept("language_id", list(spec.include) if spec.include is not None else None, list(spec.exclude)))
        if spec.temperature is not None:
            listed = language_weights(listed.withColumnRenamed("language_id", "language"), spec.temperature, spec.max_languages).withColumnRenamed("language", "language_id")
        else:
            listed = listed.withColumn("weight", F.lit(1.0))
        first = listed.orderBy("path").select("path").head()
        if first is None:
            raise ValueError(f"{spec.name}: no files under {root}")
        lacking = {spec.anchor_column, spec.positive_column} - set(_read(spark, [first["path"]]).columns)
        if lacking:
            raise ValueError(f"{first['path']}: missing columns {sorted(lacking)}")
        rows = row_counts(spark, [r["path"] for r in listed.select("path").distinct().collect()]).withColumn("_p", _plain("path")).drop("path")
        parts.append(listed.withColumn("_p", _plain("path")).join(rows, "_p", "left").na.fill(0, ["usable_rows"]).select(
            F.lit(spec.name).alias("source"), "path", F.lit(spec.anchor_column).alias("anchor_column"), F.lit(spec.positive_column).alias("positive_column"),
            (F.col("weight") * spec.weight).alias("sampling_weight"), "language_id", F.lit(spec.anchor_language or "").alias("anchor_language_id"), "bytes", "usable_rows",
        ))
    return reduce(DataFrame.unionByName, parts).orderBy(F.xxhash64(F.lit(seed), "path"), "path")


def scan(spark: SparkSession, paths: list[str], anchor: str, positive: str, holdout_groups: int = 0) -> DataFrame:
    """(anchor, positive, path, row_index): two columns of the tables; with ``holdout_groups``, without each table's last groups.

    Rows of a folder are numbered through, its files in order of their paths. The groups' bounds come from the footers; a
    table with no more groups than are held out keeps all its rows.
    """
    read = _read(spark, paths)
    rows = read.select(F.col(anchor).alias("anchor"), F.col(positive).alias("positive"), _file().alias("path"), F.col("_metadata.row_index").alias("row_index"))
    members = _members(read, paths)
    begins = None
    if members:
        counts = {r["_p"]: r["usable_rows"] for r in _file_rows(read).select(_plain("path").alias("_p"), "usable_rows").collect()}  # a catalog
        begins = spark.createDataFrame([(f, t, n) for t, own in members.items() for f, n in zip(own, accumulate((counts.get(g, 0) for g in own), initial=0))], "_p string, _t string, _start long")
        rows = _numbered(rows, begins, "row_index")
    if holdout_groups <= 0:
        return rows
    groups = footers(spark, [f for p in paths for f in members.get(p, [p])])
    if begins is not None:
        groups = _numbered(groups, begins, "start")
    bounds = groups.groupBy(_plain("path").alias("_p")).agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct("start"))).alias("_g"))
    cut = bounds.where(F.col("_n") > holdout_groups).select("_p", F.element_at("_g", F.col("_n").cast("int") - holdout_groups + 1)["start"].alias("_cut"))
    joined = rows.withColumn("_p", _plain("path")).join(cut, "_p", "left")
    return joined.where(F.col("_cut").isNull() | (F.col("row_index") < F.col("_cut"))).drop("_p", "_cut")


def _numbered(rows: DataFrame, begins: DataFrame, number: str) -> DataFrame:
    """Rows with ``path`` and a number in their file, as of the table that the file is a part of: (_p, _t, _start)."""
    joined = rows.withColumn("_p", _plain("path")).join(F.broadcast(begins), "_p", "left")
    return joined.withColumns({"path": F.coalesce("_t", "path"), number: F.col(number) + F.coalesce("_start", F.lit(0))}).select(*rows.columns)
