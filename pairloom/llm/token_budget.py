"""Token budget per source and language (problem 3): the project's tokenizer, loaded once per worker.

The vocabulary is a table of pieces; a text is cut greedily into the longest piece that fits at each place. A character
that starts no piece that fits is one unknown token, except white space that is no piece itself. Pieces are found with an
Aho-Corasick automaton. Its longest matches are the greedy cut only if a match never fails without a shorter one from the
same place to fall back on, so the first character of every piece is made a word of the automaton as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import collect_bounded
from .langid import NO_LANGUAGE, label_table

MOST_PIECES = 2_000_000
_loaded: dict[int, tuple] = {}


class PieceTokenizer:
    """Greedy longest match over a set of pieces."""

    def __init__(self, pieces: list[str]):
        self.automaton = ahocorasick.Automaton()
        known = set(pieces)
        firsts = {p[0] for p in known} - known
        for word in known | firsts:
            counts = word in known or not word.isspace()
            self.automaton.add_word(word, (len(word), int(counts)))
        if known:
            self.automaton.make_automaton()
        self.any = bool(known)
        self.blank = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in known]
        self.apart = not any(c in word for word in known | firsts for c in self.blank)

    def count(self, text: str) -> int:
        """Number of tokens of the whole text."""
        tokens = covered = 0
        spans = []
        for end, (length, counts) in self.automaton.iter_long(text) if self.any and text else ():
            tokens += counts
            covered += length
            if not self.apart:
                spans.append((end - length + 1, end + 1))
        if covered == len(text):
            return tokens
        blank = sum(map(text.count, self.blank))
        for start, stop in spans:
            blank -= sum(text.count(c, start, stop) for c in self.blank)
        return tokens + len(text) - covered - blank


def _tokenizer(broadcast) -> PieceTokenizer:
    """One tokenizer per worker process and vocabulary."""
    kept = _loaded.get(0)
    if kept is None or kept[0] != broadcast.id:
        kept = _loaded[0] = (broadcast.id, PieceTokenizer(broadcast.value))
    return kept[1]


class _Shared:
    """A broadcast with an id that tells vocabularies apart in a worker that is used again."""

    def __init__(self, broadcast, ident: str):
        self.broadcast, self.id = broadcast, ident

    @property
    def value(self):
        return self.broadcast.value


def count_tokens(df: DataFrame, text: str, vocab: DataFrame, out: str = "n_tokens") -> DataFrame:
    """``df`` without ``text``, with the exact number of tokens in ``out``; a null text has null, an empty one 0.

    ``vocab`` has (piece, is_marker); markers are not pieces of a text. It is checked to have at most ``MOST_PIECES`` rows.
    """
    spark = df.sparkSession
    rows = collect_bounded(vocab.where("NOT is_marker AND piece IS NOT NULL AND piece <> ''").select("piece"), MOST_PIECES, "the vocabulary")
    pieces = sorted({r["piece"] for r in rows})
    shared = _Shared(spark.sparkContext.broadcast(pieces), str(hash(tuple(pieces))))
    keep = [c for c in df.columns if c not in (text, out)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _tokenizer(shared).count
        for batch in batches:
            n = pd.array([None if t is None else count(t) for t in batch[text]], dtype="Int64")
            yield batch[keep].assign(**{out: n})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)
    return df.select(*keep, text).mapInPandas(run, f"{schema}{', ' * bool(schema)}`{out}` long")


def with_language(df: DataFrame, label: str, languages: DataFrame) -> DataFrame:
    """``df`` with the code that ``label`` stands for in its place: spelled as a code, its language part or a name, in any case.

    A label that names no language (see ``langid.NO_LANGUAGE``) or is null or empty gives null; one of a language that
    ``languages`` lacks stays as it is.
    """
    table = label_table(languages)  # checked to be of bounded size
    spark = df.sparkSession
    codes = F.broadcast(spark.createDataFrame(sorted(table.items()), "_spelling string, _code string"))
    plain = F.replace(F.lower(F.trim(label)), F.lit("-"), F.lit("_"))
    head = F.split(plain, "_")[0]
    out = df.withColumns({"_plain": plain, "_head": head})
    out = out.join(codes.toDF("_plain", "_a"), "_plain", "left").join(codes.toDF("_head", "_b"), "_head", "left")
    none = F.col("_plain").isNull() | F.col("_plain").isin(*NO_LANGUAGE) | F.col("_head").isin(*NO_LANGUAGE)
    code = F.coalesce("_a", F.when(~none, F.coalesce("_b", F.col(label))))
    return out.withColumn(label, code).select(*df.columns)


def first_tokens(counted: DataFrame, delivery: list[str], order: str, tokens: str = "n_tokens") -> DataFrame:
    """``counted`` with ``n_first``: the tokens of the first row, by ``order``, of each ``delivery``; null for rows delivered again.

    Rows in whose ``delivery`` a column is null are each a first one. The texts are gone by then, so only numbers move.
    """
    known = F.lit(True)
    for c in delivery:
        known = known & F.col(c).isNotNull()
    first = counted.where(known).groupBy(*delivery).agg(F.min(order).alias(order)).select(order).withColumn("_first", F.lit(True))
    out = counted.join(first.distinct(), order, "left")
    return out.withColumn("n_first", F.when(F.col("_first") | ~known, F.col(tokens))).select(*counted.columns, "n_first")


def token_cube(counted: DataFrame, *by: str, tokens: str = "n_tokens", first: str | None = None) -> DataFrame:
    """Totals over every combination of ``by``: (by..., slice, n_texts, n_tokens), with ``first`` also (n_first_texts, n_first_tokens).

    Null and empty values of a column come out as ``und``. ``slice`` names the columns that a row is for, so that a total
    over all values, whose column is null, is not taken for a value. Texts are summed per finest cell before the cube
    expands them, so the expansion never sees a row per text. Texts that are null count as no text.
    """
    cell = counted.where(F.col(tokens).isNotNull()).groupBy(*[F.when(F.col(c).isNull() | (F.col(c) == ""), "und").otherwise(F.col(c)).alias(c) for c in by])
    sums = {"n_texts": F.count("*"), "n_tokens": F.sum(tokens)} | ({"n_first_texts": F.count(first), "n_first_tokens": F.coalesce(F.sum(first), F.lit(0))} if first else {})
    cell = cell.agg(*[x.alias(name) for name, x in sums.items()])
    cube = cell.cube(*by).agg(*[F.sum(name).alias(name) for name in sums], *[F.grouping(c).alias(f"_{c}") for c in by])
    named = F.concat_ws("+", *[F.when(F.col(f"_{c}") == 0, c) for c in by])
    return cube.select(*by, F.when(named == "", "all").otherwise(named).alias("slice"), *sums).where("n_texts IS NOT NULL")
