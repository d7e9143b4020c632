"""Readers of candidate lists, selections, results, samples and name lists, each with its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CANDIDATES = "composite_key long, pair_key long, language_index int, utility double, probability_sum double, captured_support long, mean_probability double"
SELECTION = "pair_key long, selector string, support_estimate long"
RECLAIM = "token_id int, left_parent_id int, right_parent_id int, training_support long"


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(pair_key, captured_support) of a candidate list."""
    return spark.read.csv(path, header=True, schema=CANDIDATES, enforceSchema=False).select("pair_key", "captured_support")


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, sha256) of the files under ``path``, read by the tasks through Spark's file systems."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.sha2("content", 256).alias("sha256"))


def strict_keys(df: DataFrame, key: str, ascending: bool = False) -> DataFrame:
    """``df`` itself, if no key is null or comes twice and, where asked for, each is greater than the one before in file order.

    Lists with keys in order are bounded by a budget, so their order is checked in one task.
    """
    got = df.agg(F.count("*").alias("n"), F.count(key).alias("k"), F.count_distinct(key).alias("d")).head()
    if not got["n"] == got["k"] == got["d"]:
        raise ValueError(f"{key}: {got['n']} rows, {got['d']} keys")
    if ascending:
        before = F.lag(key).over(Window.orderBy(F.monotonically_increasing_id()))
        if df.select(key, before.alias("_b")).where(F.col("_b") >= F.col(key)).head():
            raise ValueError(f"{key} is not in order")
    return df


def selection(spark: SparkSession, path: str, selector: str | None = None, size: int | None = None, sha256: str | None = None) -> DataFrame:
    """A selection list; more than one selector, another than ``selector``, repeated keys, another size or digest are errors."""
    if sha256 is not None and [r["sha256"] for r in file_digests(spark, path).collect()] != [sha256]:
        raise ValueError(f"{path}: another digest")
    df = spark.read.csv(path, header=True, schema=SELECTION, enforceSchema=False)
    got = df.agg(F.count("*").alias("n"), F.count_distinct("pair_key").alias("k"), F.collect_set("selector").alias("s")).head()
    if len(got["s"]) != 1 or (selector is not None and got["s"] != [selector]):
        raise ValueError(f"selectors {got['s']}")
    if got["n"] != got["k"] or (size is not None and got["n"] != size):
        raise ValueError(f"{got['n']} rows, {got['k']} keys, {size} expected")
    return df


def reclaim_inventory(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """The first ``rows`` tokens of an inventory in its order; a token that training has seen is an error."""
    df = spark.read.csv(path, header=True, schema=RECLAIM, enforceSchema=False).withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").limit(rows).drop("_at")
    if df.where("training_support <> 0").count():
        raise ValueError("a token was seen in training")
    return df


def frozen_samples(spark: SparkSession, path: str, per_language: int) -> DataFrame:
    """(lang, place, text): the first ``per_language`` texts of every language's record (lang, s1); a language with fewer is an error."""
    df = spark.read.json(path, schema="lang string, s1 array<string>")
    short = df.where(F.size("s1") < per_language).select("lang").head()
    if short:
        raise ValueError(f"{short['lang']}: fewer than {per_language} texts")
    return df.select("lang", F.posexplode(F.slice("s1", 1, per_language)).alias("place", "text"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """(task, split, hf_subset, languages, main_score) of result files: {scores: {split: [entries]}}, or the same under the task's name."""
    entry = "array<struct<hf_subset: string, languages: array<string>, main_score: double, f1: double>>"
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    text = text.withColumn("top", F.from_json("value", "map<string, string>"))
    direct = F.try_element_at("top", F.lit("scores"))
    inner = F.coalesce(direct, F.get_json_object(F.map_values("top")[0], "$.scores"))
    task = F.coalesce(F.try_element_at("top", F.lit("task_name")), F.when(direct.isNull(), F.map_keys("top")[0]), F.regexp_replace("file", r"\.json$", ""))
    splits = text.select(task.alias("task"), F.explode(F.from_json(inner, f"map<string, {entry}>")).alias("split", "entries"))
    rows = splits.select("task", "split", F.explode("entries").alias("e"))
    return rows.select("task", "split", "e.hf_subset", "e.languages", F.coalesce("e.main_score", "e.f1").alias("main_score"))


def names(spark: SparkSession, path: str | None = None, inline: str = "") -> list[str]:
    """Names of a comma list and of a file's lines, without blanks and comments, in the order they first come."""
    found = [x.strip() for x in inline.split(",")]
    if path:
        found += [r["value"].strip() for r in spark.read.text(path).collect()]  # a list that a person wrote
    return list(dict.fromkeys(x for x in found if x and not x.startswith("#")))


def weight_table(spark: SparkSession, path: str, languages: list[str], tokens: int) -> DataFrame:
    """(lang_idx, token_id, weight) as Parquet; a language or token beyond the vocabulary is an error."""
    df = spark.read.parquet(path)
    if df.where((F.col("lang_idx") >= len(languages)) | (F.col("token_id") >= tokens) | (F.col("lang_idx") < 0)).head():
        raise ValueError("weights beyond the vocabulary")
    return df


def judgements(qrels: DataFrame) -> DataFrame:
    """(query_id, documents: map of document to score)."""
    return qrels.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_id", "score")))).alias("documents"))
