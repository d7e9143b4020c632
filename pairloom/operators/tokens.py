"""From texts to (sentence, place, token) rows, adjacent pairs, n-grams, words and merges.

Adjacency is taken from arrays where a sentence is one row: no shuffle and no sort. The window forms serve tables that
come in long form.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_RULES = 5_000_000


#: Scripts without spaces between words.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"


def words(text) -> Column:
    """Words of every script, in lower case: letters with their marks, and single letters where words are not spaced; null text gives null."""
    pattern = rf"[\p{{L}}&&[{UNSPACED}]]\p{{M}}*|(?:[\p{{L}}\p{{M}}&&[^{UNSPACED}]])+"
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(pattern), F.lit(0))


def positions(df: DataFrame, tokens: str, *keep: str) -> DataFrame:
    """Long form of an array column: (``keep``..., pos, token). Null and empty arrays have no row."""
    return df.select(*keep, F.posexplode(tokens).alias("pos", "token"))


def layout(long: DataFrame, sentence: str) -> DataFrame:
    """Per sentence its number of tokens and the place of its first token in one row of all sentences, in their order.

    The running sum goes over one row per sentence in blocks of equal sentence ids, then over the blocks.
    """
    sizes = long.groupBy(sentence).agg(F.count("*").alias("n_tokens"))
    sizes = sizes.withColumn("_block", F.floor(F.col(sentence) / 10_000))
    blocks = sizes.groupBy("_block").agg(F.sum("n_tokens").alias("_t"))
    before = blocks.select("_block", F.coalesce(F.sum("_t").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_block").orderBy(sentence).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(before, "_block").select(sentence, "n_tokens", (F.col("_before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"))


def adjacent_arrays(tokens: str) -> Column:
    """Array of (left, right) of neighbouring tokens; empty below two tokens, null for null."""
    t = F.col(tokens)
    least = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, 1, least), F.slice(t, 2, least), lambda a, b: F.struct(a.alias("left"), b.alias("right")))


def adjacent_pairs(df: DataFrame, tokens: str, *keep: str) -> DataFrame:
    """(``keep``..., pos, left, right) of neighbouring tokens in each array."""
    pairs = df.select(*keep, F.posexplode(adjacent_arrays(tokens)).alias("pos", "pair"))
    return pairs.select(*keep, "pos", F.col("pair.left").alias("left"), F.col("pair.right").alias("right"))


def adjacent_long(long: DataFrame, sentence: str, token: str = "token", pos: str = "pos") -> DataFrame:
    """The same from the long form."""
    after = F.lead(token).over(Window.partitionBy(sentence).orderBy(pos))
    return long.select("*", after.alias("right")).where("right IS NOT NULL").withColumnRenamed(token, "left")


def ngrams(df: DataFrame, tokens: str, n: int, *keep: str) -> DataFrame:
    """(``keep``..., pos, gram): every run of ``n`` tokens inside one array; shorter arrays have none."""
    if n < 2:
        raise ValueError("n must be at least 2")
    t = F.col(tokens)
    runs = F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.slice(t, i, n)))
    return df.select(*keep, F.posexplode(runs).alias("pos", "gram"))


def word_ids(long: DataFrame, sentence: str, starts: Column, pos: str = "pos") -> DataFrame:
    """``word`` numbers the words of a sentence from 0; ``starts`` tells the tokens that open one. The first token always does."""
    w = Window.partitionBy(sentence).orderBy(pos)
    opened = F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = long.withColumn("_opened", opened)
    return out.withColumn("word", F.col("_opened") - F.min("_opened").over(Window.partitionBy(sentence))).drop("_opened")


def leftmost(long: DataFrame, sentence: str, candidate: str, pos: str = "pos") -> DataFrame:
    """``keep``: of each run of candidates the first, third and so on, so that no two kept pairs share a token."""
    w = Window.partitionBy(sentence).orderBy(pos)
    first = F.col(candidate) & ~F.coalesce(F.lag(candidate).over(w), F.lit(False))
    out = long.withColumn("_first", F.when(first, F.col(pos)))
    out = out.withColumn("_from", F.last("_first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("keep", F.col(candidate) & ((F.col(pos) - F.col("_from")) % 2 == 0)).drop("_first", "_from")


def drop_tokens(df: DataFrame, tokens: str, ignored: list) -> DataFrame:
    """Arrays without the listed tokens; places close up by themselves."""
    gone = F.array(*[F.lit(x) for x in ignored])
    return df.withColumn(tokens, F.filter(tokens, lambda x: ~F.array_contains(gone, x))) if ignored else df


def split_markers(df: DataFrame, tokens: str, markers: DataFrame, keep_marker: bool = False) -> DataFrame:
    """``lang_idx`` of the marker that opens each array (-1 if none is known) and the array without it.

    ``markers`` has (marker, lang_idx), one row per language; Spark plans the join by its size.
    """
    first = F.try_element_at(tokens, F.lit(1))
    out = df.withColumn("marker", first).join(markers, "marker", "left")
    known = F.col("lang_idx").isNotNull()
    body = F.col(tokens) if keep_marker else F.when(known, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(F.col(tokens))
    return out.withColumn(tokens, body).withColumn("lang_idx", F.coalesce("lang_idx", F.lit(-1))).drop("marker")


def expand_reclaimed(df: DataFrame, tokens: str, rules: DataFrame, most: int = MOST_RULES) -> DataFrame:
    """Arrays in which each token with a row in ``rules`` (token_id, left, right) is replaced by its two parts; places close up.

    Rules, one per reclaimed token, are checked to be at most ``most`` and looked up in a hash table per worker; more are an
    error, and then ``pooling.collapse_reclaimed`` joins them to the long form. A token with two rules is an error.
    """
    rows = rules.select("token_id", "left", "right").limit(most + 1).collect()
    table = {r["token_id"]: (r["left"], r["right"]) for r in rows}
    if len(rows) > most or len(table) < len(rows):
        raise ValueError("too many rules for one worker, or two for one token")
    shared = df.sparkSession.sparkContext.broadcast(table)
    kind = df.schema[tokens].dataType

    def run(batch: pd.Series) -> pd.Series:
        parts = shared.value
        return batch.map(lambda x: None if x is None else [y for t in x for y in parts.get(t, (t,))])

    return df.withColumn(tokens, F.pandas_udf(run, kind)(tokens))
