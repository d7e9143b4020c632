"""Evaluation texts leaking into training text (problem 2): a stored positional inverted index, in segments of documents.

``index`` cuts the training texts into terms and writes segments: for each term of a segment, the places at which it
stands (postings). A segment is one row, so building moves nothing between tasks, and the stored index serves any number
of searches without cutting a text again. The held-out items are few; they go to all tasks in blocks of a checked size, and
every segment is read once however many blocks there are. A window of an item is looked up through its rarest terms in the
segment: their postings, shifted by the terms' offsets in the item, are intersected with those of their neighbours,
outwards, until the run of agreeing places ends. Runs of at least ``WORDS`` words, or ``CHARS`` characters where words are
not spaced, are exact matches (``search``); windows of which all but a few words stand near their places are proximity
matches (``near``). Nothing but what is found is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import collect_bounded, materialize
from .scripts import unify

WORDS, CHARS = 10, 24
UNSPACED_LANGUAGES = ("cmn_Hani", "jpn_Jpan")
MOST_ITEMS = 2_000_000
BLOCK_ITEMS = 20_000
CANDIDATES = 2_000_000
#: Terms of a segment, from which on the next one begins; a longer text is a segment of its own.
SEGMENT_TERMS = 200_000
#: Of a window's words that many may be missing or elsewhere in a proximity match, and the others this far from their places.
MISSING, SLACK = 0.2, 2
_ASCII_SIGNS = {c: None for c in range(128) if not chr(c).isalnum() and not chr(c).isspace()}
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


def words(text: str) -> list[str]:
    """Words of ``text``; case, signs, spacing and the form of characters do not matter."""
    if text.isascii():
        return text.casefold().translate(_ASCII_SIGNS).split()
    return unify(text).casefold().translate(_signs).split()


class _Signs(dict):
    """For ``str.translate``: removes signs, keeps letters, marks, digits and white space; learns characters as they come."""

    def __missing__(self, code: int):
        c = chr(code)
        self[code] = None if unicodedata.category(c)[0] in "PSC" and not c.isspace() else code
        return self[code]


_signs = _Signs()


def characters(text: str) -> str:
    """Letters and digits of ``text`` without signs and spaces."""
    return "".join(words(text))


class Queries:
    """A block of items as one row of term numbers, a separator after each item."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int):
        self.run = run
        self.vocab: dict[str, int] = {}
        flat, owner = [], []
        for item, terms in items:
            flat += [self.vocab.setdefault(t, len(self.vocab)) for t in terms] + [-2]
            owner += [item] * (len(terms) + 1)
        self.flat, self.owner = np.array([-2, *flat], "int32"), np.array([0, *owner], "int64")
        windows = np.lib.stride_tricks.sliding_window_view(self.flat, run) if len(self.flat) >= run else np.zeros((0, run), "int32")
        self.starts = np.flatnonzero((windows >= 0).all(axis=1))


class Postings:
    """A segment's positional index under the numbers of a block's terms: term number -> sorted places in one row of all texts."""

    def __init__(self, terms: list[str], counts: np.ndarray, places: np.ndarray, starts: np.ndarray, vocab: dict[str, int]):
        size = int(starts[-1]) if len(starts) else 1  # the last start is the end
        numbers = np.array([vocab.get(t, -1) for t in terms], "int64")
        owner = np.repeat(numbers, counts)
        self.flat = np.full(size + 1, -1, "int32")
        self.flat[places] = owner
        self.flat[0] = -3
        self.flat[starts - 1] = -3  # before each text and after the last
        self.text = np.zeros(size + 1, "int64")
        self.text[starts[:-1]] = 1
        self.text = np.cumsum(self.text) - 1
        known = numbers >= 0
        self.count = np.zeros(len(vocab), "int64")
        self.count[numbers[known]] = counts[known]
        kept = owner >= 0
        order = np.argsort(owner[kept], kind="stable")
        self.places = places[kept][order]
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    @classmethod
    def of(cls, texts: list[list[str]], vocab: dict[str, int]) -> Postings:
        terms, counts, places, starts = _invert(texts)
        return cls(terms, counts, places, starts, vocab)

    def _slices(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which, place): every posting of each of ``terms``, in slices, so that memory is bounded however frequent they are."""
        counts = self.count[terms]
        ends, at = np.cumsum(counts), 0
        while at < len(terms):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, "right")))
            n = counts[at:stop]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(np.arange(at, stop), n), self.places[np.repeat(self.first[terms[at:stop]], n) + offset]
            at = stop

    def _windows(self, queries: Queries) -> np.ndarray:
        """How often each term of each window occurs here. Separators are never looked at: windows have none."""
        rare = np.append(self.count, [0, 0, 0])[queries.flat]
        return np.lib.stride_tricks.sliding_window_view(rare, queries.run)[queries.starts]

    def search(self, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
        """(text, place in the queries) of each run that is long enough."""
        hits_t, hits_q = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
        if len(queries.starts) and len(self.places):
            windows = self._windows(queries)
            possible = windows.min(axis=1) > 0
            anchors = np.unique(queries.starts[possible] + windows[possible].argmin(axis=1))
            for which, place in self._slices(queries.flat[anchors]):
                q = anchors[which]
                length = np.ones(len(q), "int64")
                for step in (1, -1):
                    alive = np.arange(len(q))
                    for k in range(1, queries.run):
                        alive = alive[queries.flat[q[alive] + step * k] == self.flat[place[alive] + step * k]]
                        if not len(alive):
                            break
                        length[alive] += 1
                long = length >= queries.run
                hits_t.append(self.text[place[long]])
                hits_q.append(q[long])
        return np.concatenate(hits_t), np.concatenate(hits_q)

    def near(self, queries: Queries, missing: int, slack: int = SLACK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in the queries, words met) of windows of which at most ``missing`` words are not within ``slack`` of their places.

        The places are counted from a word that stands at its own. Of any ``missing + 1`` words of such a window one is met,
        but it may stand beside its place; so the postings of the rarest of them are tried with every shift up to ``slack``.
        """
        out = [tuple(np.zeros(0, "int64") for _ in range(3))]
        if len(queries.starts) and len(self.places):
            windows = self._windows(queries)
            rarest = np.argsort(windows, axis=1, kind="stable")[:, : missing + 1]
            starts, offsets = np.repeat(queries.starts, missing + 1), rarest.ravel()
            occurs = np.take_along_axis(windows, rarest, axis=1).ravel() > 0
            starts, offsets = starts[occurs], offsets[occurs]
            for which, place in self._slices(queries.flat[starts + offsets]):
                for shift in range(-slack, slack + 1):
                    out.append(self._met(queries, starts[which], place - offsets[which] + shift, self.text[place], missing, slack))
        return tuple(np.concatenate(parts) for parts in zip(*out))

    def _met(self, queries: Queries, start: np.ndarray, begin: np.ndarray, text: np.ndarray, missing: int, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of windows from ``start`` laid upon the segment from ``begin``: those with few words missing."""
        alive, lost = np.arange(len(start)), np.zeros(len(start), "int64")
        last = len(self.flat) - 1
        for k in range(queries.run):
            if not len(alive):
                break
            want, found = queries.flat[start[alive] + k], np.zeros(len(alive), bool)
            for d in range(-slack, slack + 1):
                at = np.clip(begin[alive] + k + d, 0, last)
                found |= (self.flat[at] == want) & (self.text[at] == text[alive])
            lost[alive[~found]] += 1
            alive = alive[lost[alive] <= missing]
        return text[alive], start[alive], queries.run - lost[alive]


def _invert(texts: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(terms, counts, places, starts) of texts in one row, one place free before each; the last start is the end."""
    numbers: dict[str, int] = {}
    flat: list[int] = []
    starts = [1]
    for terms in texts:
        flat += [numbers.setdefault(t, len(numbers)) for t in terms]
        flat.append(-1)
        starts.append(len(flat) + 1)
    row = np.array([-1, *flat], "int64")
    places = np.flatnonzero(row >= 0)
    places = places[np.argsort(row[places], kind="stable")]
    return list(numbers), np.bincount(row[row >= 0], minlength=len(numbers)), places.astype("int32"), np.array(starts, "int32")


SEGMENTS = "unspaced boolean, ids array<long>, sides array<int>, terms array<string>, counts array<int>, places array<int>, starts array<int>"


def index(corpus: DataFrame, key: str = "pair_id", sides: tuple[str, ...] = ("anchor", "positive"), segment_terms: int = SEGMENT_TERMS) -> DataFrame:
    """Segments of the positional index of all texts of ``sides``, whole; to be written once and searched often.

    Every text is cut into words; a text with characters of scripts without spaces is cut into characters as well, in
    segments of their own. Null and empty texts, and texts of signs only, have no terms and are in no segment. ``sides``
    are numbered in the order given. Rows without a key are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def segment(unspaced: bool, texts: list[tuple[int, int, list[str]]]) -> pd.DataFrame:
            terms, counts, places, starts = _invert([t for _, _, t in texts])
            row = (unspaced, [i for i, _, _ in texts], [n for _, n, _ in texts], terms, counts, places, starts)
            return pd.DataFrame([row], columns=["unspaced", "ids", "sides", "terms", "counts", "places", "starts"])

        open_: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}
        for batch in batches:
            ids = batch[key].to_numpy("int64")
            for n, side in enumerate(sides):
                for i, text in zip(ids, batch[side]):
                    if not text:
                        continue
                    terms = words(text)
                    for unspaced in (False, True) if _UNSPACED.search(text) else (False,):
                        cut = list("".join(terms)) if unspaced else terms
                        if cut:
                            open_[unspaced].append((int(i), n, cut))
                            size[unspaced] += len(cut)
                            if size[unspaced] >= segment_terms:
                                yield segment(unspaced, open_[unspaced])
                                open_[unspaced], size[unspaced] = [], 0
        for unspaced, texts in open_.items():
            if texts:
                yield segment(unspaced, texts)

    return corpus.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), *sides).mapInPandas(run, SEGMENTS)


def _blocks(items: DataFrame) -> list:
    """The items as broadcasts of ``BLOCK_ITEMS`` each; checked to be at most ``MOST_ITEMS``."""
    rows = collect_bounded(items.select("item_id", "text", "lang").where("text IS NOT NULL AND item_id IS NOT NULL"), MOST_ITEMS, "the held-out items")
    rows = sorted({(r["item_id"], r["text"], r["lang"] in UNSPACED_LANGUAGES) for r in rows})
    context = items.sparkSession.sparkContext
    return [context.broadcast(rows[at : at + BLOCK_ITEMS]) for at in range(0, len(rows), BLOCK_ITEMS)]


def _look_up(segments: DataFrame, items: DataFrame, key: str, sides: tuple[str, ...], find: Callable, schema: str) -> DataFrame:
    """``find(postings, queries)`` over every segment and block of items, each segment read once: (``key``, side, item_id, ...)."""
    blocks = _blocks(items)
    kept: dict[int, dict[bool, Queries]] = {}  # per worker process; a block's queries are made again if there are many blocks

    def queries_of(n: int) -> dict[bool, Queries]:
        if n not in kept:
            if len(kept) >= 2:
                kept.clear()
            rows = blocks[n].value
            kept[n] = {False: Queries([(i, words(t)) for i, t, unspaced in rows if not unspaced], WORDS), True: Queries([(i, list(characters(t))) for i, t, unspaced in rows if unspaced], CHARS)}
        return kept[n]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n in range(len(blocks)):
                made = queries_of(n)
                for row in batch.itertuples(index=False):
                    queries = made[bool(row.unspaced)]
                    if not len(queries.starts):
                        continue
                    postings = Postings(list(row.terms), np.asarray(row.counts), np.asarray(row.places), np.asarray(row.starts), queries.vocab)
                    t, q, *more = find(postings, queries)
                    if len(t):
                        found = pd.DataFrame({key: np.asarray(row.ids)[t], "side": np.asarray(row.sides)[t], "item_id": queries.owner[q], **{f"v{k}": v for k, v in enumerate(more)}})
                        found = found.groupby([key, "side", "item_id"], as_index=False).max()
                        found["side"] = [sides[x] for x in found["side"]]
                        yield found

    return segments.mapInPandas(run, f"`{key}` long, side string, item_id long{schema}")


def search(segments: DataFrame, items: DataFrame, key: str = "pair_id", sides: tuple[str, ...] = ("anchor", "positive")) -> DataFrame:
    """(``key``, side, item_id) of each indexed text that repeats a passage of an item; of several items with it, each.

    Items shorter than the passage length match nothing. ``sides`` as given to ``index``.
    """
    return _look_up(segments, items, key, sides, lambda p, q: p.search(q), "").distinct()


def near(segments: DataFrame, items: DataFrame, key: str = "pair_id", sides: tuple[str, ...] = ("anchor", "positive"), missing: float = MISSING, slack: int = SLACK) -> DataFrame:
    """(``key``, side, item_id, n_met, n_window) of texts with most words of an item's passage near their places.

    A window of an item is matched if at most the share ``missing`` of its words is not within ``slack`` places of where
    it would be in an exact copy; ``n_met`` is the most words met in one of the item's windows, of ``n_window``. Exact
    passages are matches in which all are met.
    """
    met = _look_up(segments, items, key, sides, lambda p, q: p.near(q, int(missing * q.run), slack), ", v0 long")
    met = met.groupBy(key, "side", "item_id").agg(F.max("v0").alias("n_met"))
    length = items.select("item_id", F.when(F.col("lang").isin(*UNSPACED_LANGUAGES), CHARS).otherwise(WORDS).alias("n_window")).distinct()
    return met.join(length, "item_id").select(key, "side", "item_id", "n_met", "n_window")


def leaked(corpus: DataFrame, items: DataFrame, key: str = "pair_id", sides: tuple[str, ...] = ("anchor", "positive")) -> DataFrame:
    """``search`` in an index of ``corpus`` that is written for it."""
    return search(materialize(index(corpus, key, sides)), items, key, sides)


def leaks_by_source(found: DataFrame, corpus: DataFrame, key: str = "pair_id") -> DataFrame:
    """Per source: rows with a leak, leaked passages and items concerned. A null source is a source."""
    joined = corpus.select(key, "source").join(found, key)
    return joined.groupBy("source").agg(F.count_distinct(key).alias("n_rows"), F.count("*").alias("n_leaks"), F.count_distinct("item_id").alias("n_items"))
