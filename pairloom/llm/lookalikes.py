"""Visually identical text with different characters (problem 4): one consistent form of each value.

Characters are mapped first (widths, ligatures, look-alike letters and digits from Unicode's table of confusable characters,
kinds of space; what is not displayed is removed).
What is then equal, in SQL, under the accent- and case-sensitive Unicode collation, which also equates composed and
decomposed accents, are one class. Its canonical member is chosen deterministically and joined back.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ._common import materialize, semi_join

#: Not displayed: zero-width spaces and joiners, direction marks, soft hyphen, byte order mark, variation selectors.
HIDDEN = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿" + "".join(map(chr, range(0xFE00, 0xFE10)))
SPACES = "              　"


#: Blocks with width, compatibility and font forms: Roman numerals, letter-like symbols, radicals, presentation forms, mathematical letters.
FORMS = (
    *range(0x0132, 0x0134), *range(0x01C4, 0x01CA), 0x2026, *range(0x2100, 0x2150), *range(0x2160, 0x2180), *range(0x2E80, 0x2FE0), *range(0x3130, 0x3190), *range(0xF900, 0xFE00), *range(0xFE10, 0xFFF0),
    *range(0x1D400, 0x1D800),
)
KINDS = ("<wide>", "<narrow>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>", "<vertical>", "<small>", "<font>")


def width_forms() -> dict[str, str]:
    """Characters that Unicode calls another width, a ligature, a font or a compatibility form of others, and these."""
    out = {}
    for c in map(chr, FORMS):
        kind = unicodedata.decomposition(c).split(" ")[0]
        if kind in KINDS:
            plain = unicodedata.normalize("NFKD" if kind == "<narrow>" else "NFKC", c)
            if plain.strip():
                out[c] = plain
        elif kind and not kind.startswith("<"):
            out[c] = unicodedata.normalize("NFC", c)
    return out


def _kind(c: str) -> str:
    """What has to agree for two characters to look alike: case or being a digit, and whether a dot is shown."""
    name = unicodedata.name(c, "")
    dotless = " dotless" if c.islower() and ("DOTLESS" in name or "IOTA" in name) else ""
    return ("upper" if c.isupper() else "lower" if c.islower() else "digit") + dotless


# Look-alike letters that the table lacks.
MORE = {"ӏ": "l", "Ԛ": "Q"}
_letters: dict[str, str] = {}


def confusable_letters(spark: SparkSession) -> dict[str, str]:
    """Cased letters and digits of all scripts that look like another, and the one that stands for their class.

    Classes come from the Unicode table of confusable characters, as ICU, which Spark brings along, has it: characters of
    one skeleton and one ``_kind`` are a class. So letters of different case, letters and digits, dotted and dotless
    letters stay apart, whatever the table says of them; signs and letters without case are not taken from it at all. An
    ASCII member stands for its class, else that of the least code point. Skeletons with marks are left out, as accents
    are compared by themselves.
    """
    if not _letters:
        chars = [c for c in map(chr, range(0x30, 0x1FBFA)) if (c.isupper() or c.islower() or unicodedata.category(c) == "Nd") and unicodedata.normalize("NFD", c) == c]
        checker = getattr(spark.sparkContext._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
        skeletons = checker.getSkeleton("\n".join(chars)).split("\n")
        if len(skeletons) != len(chars):
            raise ValueError("the skeletons do not fit the characters")
        classes: dict[tuple[str, str], list[str]] = {}
        for c, s in zip(chars, skeletons):
            if not any(unicodedata.category(x)[0] == "M" for x in s):
                classes.setdefault((s, _kind(c)), []).append(c)
        for members in classes.values():
            _letters.update({c: min(members) for c in members if c != min(members)})  # ASCII comes first
        _letters.update(MORE)
    return _letters


def look_table(spark: SparkSession) -> dict[int, str]:
    """For ``str.translate``: each character to map and its one form; nothing for those not displayed."""
    letters = confusable_letters(spark)
    forms = {c: "".join(letters.get(x, x) for x in p) for c, p in width_forms().items()}
    for c in map(chr, (*range(0xC0, 0x250), *range(0x370, 0x590), *range(0x1E00, 0x2000))):  # accented letters whose base is a look-alike
        base, *marks = unicodedata.normalize("NFD", c)
        if marks or base != c:
            plain = letters.get(base, base)
            if marks and "dotless" in _kind(base) and unicodedata.combining(marks[0]) == 230:  # a mark above takes the place of the dot
                plain = "j" if "J" in unicodedata.name(base) else "i"
            if plain != base or not marks:
                forms[c] = unicodedata.normalize("NFC", plain + "".join(marks))
    return str.maketrans(letters | forms | {c: " " for c in SPACES} | {c: "" for c in HIDDEN})


@cache
def base_table() -> dict[int, str]:
    """Each character with a canonical decomposition and the first of its parts; nothing for the other parts."""
    out, marks = {}, set()
    for c in map(chr, range(0xC0, 0x10000)):
        parts = unicodedata.normalize("NFD", c)
        if parts != c:
            out[c] = parts[0]
            marks.update(parts[1:])
        elif unicodedata.combining(c):
            marks.add(c)
    return str.maketrans({c: "" if b in marks else b for c, b in out.items()} | dict.fromkeys(marks, ""))


_DOTLESS = re.compile("[ıȷ](?=[" + "".join(c for c in map(chr, range(0x300, 0x370)) if unicodedata.combining(c) == 230) + "])")


def look_of(value: str, table: dict[int, str]) -> str:
    """``value`` with one form for each look; what differs in case, accents, dots or punctuation stays different.

    Composed and decomposed accents are not made equal here, but by the collation under which looks are compared.
    """
    if value.isascii():
        return value
    look = value.translate(table)
    if "ı" in look or "ȷ" in look:  # a mark above takes the place of the dot
        look = _DOTLESS.sub(lambda m: "i" if m.group() == "ı" else "j", look)
    return look


def coarse_of(look: str) -> str:
    """What equal looks share: the look without accents. Different looks may share it."""
    return look if look.isascii() else look.translate(base_table())


def _hashes(table, by: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest, looks_of = xxhash.xxh64_intdigest, table.value
        for batch in batches:
            values = list(batch["value"])
            own = np.array([digest(v) for v in values], "uint64").view("int64")
            looks = np.array([digest(coarse_of(look_of(v, looks_of))) for v in values], "uint64").view("int64")
            yield pd.DataFrame({"pair_id": batch["pair_id"], by: batch[by], "c": looks, "v": own})

    return run


def shared_looks(rows: DataFrame, by: str = "side") -> DataFrame:
    """Rows of (pair_id, ``by``, value) whose value may share its look with a different value of the same ``by``.

    (pair_id, ``by``, value, look). Hashes come first: only rows whose coarse hash stands for two values are fetched and
    compared as texts, under the collation. Null and empty values have no row.
    """
    rows = rows.select("pair_id", by, "value").where("value IS NOT NULL AND value <> ''")
    table = rows.sparkSession.sparkContext.broadcast(look_table(rows.sparkSession))
    look = F.pandas_udf(lambda values: values.map(lambda v: look_of(v, table.value)), StringType())
    hashed = materialize(rows.mapInPandas(_hashes(table, by), f"pair_id long, {by} string, c long, v long"))
    several = hashed.groupBy(by, "c").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select(by, "c")
    near = materialize(hashed.join(several, [by, "c"], "left_semi").select("pair_id", by).distinct())
    return materialize(semi_join(rows, near, ["pair_id", by]).withColumn("look", look("value")))


def classes(near: DataFrame, by: str = "side") -> DataFrame:
    """One row per value that shares its look with another: (``by``, value, canonical, n_rows). ``near``: of ``shared_looks``.

    The canonical member of a class is the value that most rows have; among those the least in code point order. Copies of
    a value, however many, are one row here.
    """
    values = near.groupBy(by, "value", "look").agg(F.count("*").alias("n_rows")).withColumn("look", F.collate("look", "UNICODE"))
    best = values.groupBy(by, "look").agg(F.count("*").alias("members"), F.min_by("value", F.struct(-F.col("n_rows"), F.col("value"))).alias("canonical"))
    return values.join(best.where("members > 1"), [by, "look"]).select(by, "value", "canonical", "n_rows")


def canonical_forms(rows: DataFrame, by: str = "side") -> DataFrame:
    """(pair_id, ``by``, value, canonical) for every row: the one form that is consistent over all rows of a ``by``.

    A value that shares its look with no other is its own canonical form, mapped characters included only if some other
    value has them mapped; null and empty values stay as they are.
    """
    found = materialize(classes(shared_looks(rows, by), by).select(by, "value", "canonical").withColumn("h", F.xxhash64("value")))
    joined = rows.select("pair_id", by, "value", F.xxhash64("value").alias("h")).join(found, [by, "h", "value"], "left")
    return joined.select("pair_id", by, "value", F.coalesce("canonical", "value").alias("canonical"))


def look_classes(rows: DataFrame, by: str = "side") -> DataFrame:
    """Every row whose value looks like a different one: (pair_id, ``by``, canonical, n_rows, n_links).

    A class is named by its canonical value; ``n_rows`` are its rows, ``n_links`` those with another value than this row's.
    One row per row, however large the class; the pairs of ``equal_looking`` follow from it.
    """
    near = shared_looks(rows, by)
    found = materialize(classes(near, by))
    sizes = found.groupBy(by, "canonical").agg(F.sum("n_rows").alias("_all"))
    sized = found.join(sizes, [by, "canonical"]).select(by, "value", "canonical", F.col("_all").alias("n_rows"), (F.col("_all") - F.col("n_rows")).alias("n_links"))
    return near.select("pair_id", by, "value").join(sized, [by, "value"]).select("pair_id", by, "canonical", "n_rows", "n_links")


def equal_looking(rows: DataFrame, by: str = "side") -> DataFrame:
    """Pairs of rows whose values look the same but differ: (pair_id_1, pair_id_2, ``by``), pair_id_1 < pair_id_2.

    Values are paired within their class first and rows joined to them afterwards, so copies of one value meet only the
    rows of other values. Rows of one pair_id that occurs twice are not paired with each other. This is the form that lists
    of pairs ask for; ``look_classes`` says the same in one row per row.
    """
    near = shared_looks(rows, by)
    found = materialize(classes(near, by))
    one = found.select(by, F.col("value").alias("v1"), "canonical")
    two = found.select(by, F.col("value").alias("v2"), "canonical")
    pairs = one.join(two, [by, "canonical"]).where("v1 < v2")
    members = near.select("pair_id", by, "value")
    first = members.select(F.col("pair_id").alias("a"), by, F.col("value").alias("v1"))
    second = members.select(F.col("pair_id").alias("b"), by, F.col("value").alias("v2"))
    met = pairs.join(first, [by, "v1"]).join(second, [by, "v2"]).where("a <> b")
    return met.select(F.least("a", "b").alias("pair_id_1"), F.greatest("a", "b").alias("pair_id_2"), by)


def sides_of(pairs: DataFrame) -> DataFrame:
    """(pair_id, side, value) with a row for the anchor and one for the positive."""
    sides = [F.struct(F.lit(s).alias("side"), F.col(s).alias("value")) for s in ("anchor", "positive")]
    return pairs.select("pair_id", F.explode(F.array(*sides)).alias("s")).select("pair_id", "s.side", "s.value")
