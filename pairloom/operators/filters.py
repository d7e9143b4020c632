"""Row filters of pair streams, and the in-batch removal of repeated texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def clean_pairs(pairs: DataFrame, max_chars: int = 512, exact: bool = True, anchor: str = "anchor", positive: str = "positive") -> DataFrame:
    """Pairs with both sides stripped, not empty, at most ``max_chars`` characters (0: any), and not the same canonical text.

    Cheap tests come first. ``exact`` compares canonical forms in Arrow batches; otherwise their ASCII form in the JVM.
    """
    df = pairs.where(F.col(anchor).isNotNull() & F.col(positive).isNotNull())
    df = df.withColumn(anchor, T.strip(anchor)).withColumn(positive, T.strip(positive))
    df = df.where((F.col(anchor) != "") & (F.col(positive) != ""))
    if max_chars > 0:
        df = df.where((F.char_length(anchor) <= max_chars) & (F.char_length(positive) <= max_chars))
    form = T.canonical_text if exact else T.canonical_ascii
    return df.where(form(anchor) != form(positive))


def overlapping(pairs: DataFrame, a: str, b: str, least: float = 0.0, strict: bool = True) -> DataFrame:
    """Pairs whose arrays of terms overlap by Dice ``least`` or more, or by more if ``strict``; null arrays do not pass."""
    if not 0.0 <= least <= 1.0:
        raise ValueError("least must be in [0, 1]")
    score = T.dice(a, b)
    return pairs.where(score > least if strict else score >= least)


def languages_kept(language: str | Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Predicate: an entry with a script names one language exactly, one without names it in every script."""
    if set(include or ()) & set(exclude or ()):
        raise ValueError("a language is both included and excluded")
    col = F.col(language) if isinstance(language, str) else language

    def among(names: list[str]) -> Column:
        full, codes = [n for n in names if "_" in n], [n.casefold() for n in names if "_" not in n]
        return col.isin(*full) | T.language_code(col).isin(*codes)

    keep = F.lit(True) if include is None else among(include)
    return keep & ~among(exclude) if exclude else keep


def batch_dedup(rows: DataFrame, batch_size: int, by: str, order: str, anchor: str = "anchor", positive: str = "positive") -> DataFrame:
    """In each group of ``by``, in the order of ``order``: rows kept, with ``batch`` and ``slot``.

    A row is rejected if the canonical form of either side was seen on either side of its batch; after ``batch_size`` rows
    a new batch begins. What is seen depends on the rows before, so a group is one task: groups are batches' sources of
    bounded size, such as planned blocks of rows, not whole languages. Null sides are rejected.
    """
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(order, kind="stable")
        seen: set[str] = set()
        kept, batch, slot = [], 0, 0
        for i, (a, p) in enumerate(zip(block[anchor], block[positive])):
            if a is None or p is None:
                continue
            forms = {T.canonical(a), T.canonical(p)}
            if forms & seen:
                continue
            kept.append((i, batch, slot))
            seen |= forms
            slot += 1
            if slot == batch_size:
                batch, slot, seen = batch + 1, 0, set()
        out = block.iloc[[i for i, _, _ in kept]].copy()
        out["batch"], out["slot"] = [b for _, b, _ in kept], [s for _, _, s in kept]
        return out

    return rows.groupBy(by).applyInPandas(run, f"{kind}, batch int, slot int")


def subset_allowed(languages: str, known: list[str], kind: str = "bitext") -> Column:
    """Whether an evaluation subset's languages (an array) are known: all of them for pairs, the first for other tasks."""
    names = F.array(*[F.lit(k) for k in known])
    if kind in ("bitext", "sts", "retrieval"):
        return (F.size(languages) > 0) & (F.size(F.array_except(languages, names)) == 0)
    return F.array_contains(names, F.col(languages)[0])


def first_of_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the order given; the order should end in something unique."""
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")
