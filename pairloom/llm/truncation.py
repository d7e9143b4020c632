"""Text cut off by field limits (problem 8): self-joins by hashed prefixes.

A text that was cut is a strict prefix of a longer copy, if the corpus has one: ``prefix_copies`` finds these for texts of
any length. Prefixes are hashed at a ladder of fixed lengths; a text meets only those texts that share its highest rung,
then is compared at its own length. Few cut texts have a whole copy, so ``truncated`` also compares *tails*: the last two
words of a text that does not close its last sentence are looked up among the word pairs of all texts, again by hashed
prefixes (does a longer pair go on from it, and do other lines or sentences end with it). ``judged`` names the route by
which each document is found.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import MOST_BROADCAST, materialize, semi_join

# Signs that close a sentence, closing brackets and quotes after them, and signs of omission.
CLOSERS = ".!?。！？؟।॥;；…"
BRACKETS = "\"'»”’)]）」』】》"
OMISSION = re.compile(r"[\s\[(（]*(?:\.{2,}|…+|。{2,}|[\[(（](?:\.{2,}|…)[\])）])\s*$")
ADDRESS = re.compile(r"(?:https?://|www\.)\S+$|\S+@\S+\.\w+$")
SIGNED = re.compile(r"^\s*[—–―•*·~=_#|]+\s*\S{0,24}(?:[\s・]\S{1,24}){0,2}$")
SOURCE_NOTE = re.compile(r"^[(（\[].*[)）\]]$", re.S)
NUMBERED = re.compile(r"^\s*(?:\d{1,4}[.)]|[-•*–—])\s+")
UNSPACED = re.compile(r"[぀-ヿ㐀-鿿豈-﫿฀-๿]")
DIGITS = re.compile(r"\d+")
COMMAS = {",", "،", "、", "，"}
EDGES = "\"'«»“”„‘’()[]（）「」『』【】《》,،、，:：;；"
SENTENCE_END = re.compile(rf"[{re.escape(CLOSERS)}]+[{re.escape(BRACKETS)}]*(?=\s|$)|[。！？]+[{re.escape(BRACKETS)}]*")

#: Shares of a pair's occurrences from which it is taken to be able to end a line, and to end sentences only.
LEAST_ENDS, SENTENCE_ENDS = 0.004, 0.9
#: A pair belongs to sentences, not to headings or captions, if its share in open lines is at most ``STRAY``, and at most
#: ``MOST_OPEN`` by its upper bound.
STRAY, MOST_OPEN, Z_OPEN = 0.001, 0.06, 1.96
#: A length is a field's limit if by its lower bound more texts of the source have it than the lengths around it together.
LIMIT_SHARE, Z_LIMIT = 0.5, 2.8
#: Characters before the last that tell the end of a sentence where words are not spaced.
LONGER = 6
JOINING = "'’\\-‐‑"
#: Lengths at which prefixes are hashed, each about half as long again as the one before.
RUNGS = tuple(sorted({n for k in range(18) for n in (1 << k, 3 << k >> 1)}))
#: Counted n-grams of a task are passed on from this many on, so that its memory is bounded.
MOST_COUNTED = 400_000
#: A pair seen less often is judged by its first word.
LEAST_TOTAL = 3
START = "^"
COUNTED = ("inside", "line_end", "sentence", "in_open_line")


@lru_cache(1 << 16)
def _bare(word: str) -> str:
    return word.strip(EDGES)


def units(segment: str) -> list[str]:
    """Words with digits masked, without signs at their edges; single characters where words are not spaced.

    A number after a comma is ``,0``: what comes before it is seldom the same twice, so it is judged by itself.
    """
    segment = DIGITS.sub("0", segment)
    if UNSPACED.search(segment):
        return [c for c in segment if not c.isspace()]
    raw = segment.split()
    out = [w for w in map(_bare, raw) if w]
    if "0" not in out:
        return out
    out = []
    for before, word in zip(["", *raw], raw):
        bare = _bare(word)
        if bare:
            out.append(",0" if bare == "0" and before[-1:] in COMMAS and word[-1:] == "0" else bare)
    return out


def pairs_of(parts: list[str], unspaced: bool, before: int = 3) -> list[tuple[str, str]]:
    """Each unit with what stands before it: one word, or ``before`` characters."""
    if unspaced:
        return [("".join(parts[max(0, i - before) : i]), c) for i, c in enumerate(parts)]
    if ",0" in parts:
        return [(b if b == ",0" else a, b) for a, b in zip([START, *parts], parts)]
    return list(zip([START, *parts], parts))


def segments(line: str) -> list[tuple[str, bool]]:
    """Sentences of a line and whether each is closed; the number or dash of a list is not part of one."""
    line = NUMBERED.sub("", line)
    out, at = [], 0
    for m in SENTENCE_END.finditer(line):
        if line[at : m.start()].strip():
            out.append((line[at : m.start()], True))
        at = m.end()
    if line[at:].strip():
        out.append((line[at:], False))
    return out


def tail(text: str) -> dict | None:
    """What is left open at the end of ``text``: None if its last sentence is closed or it ends in a signature or link.

    ``own_line``: the open segment is a line of its own, as headings and captions are. ``omitted``: a sign of omission
    followed it.
    """
    body = text.rstrip()
    m = OMISSION.search(body)
    if m:
        body = body[: m.start()].rstrip()
    if not body:
        return None
    line = body[body.rfind("\n") + 1 :]
    if ADDRESS.search(line) or SIGNED.match(line) or SOURCE_NOTE.match(line.strip()) or not any(c.isalpha() for c in line):
        return None
    found = segments(line)
    if not found or (found[-1][1] and not m):
        return None
    last, closed = found[-1]
    if closed:  # a closed sentence before the sign of omission
        return None
    parts = units(last)
    if not parts:
        return None
    unspaced = bool(UNSPACED.search(last))
    pairs = pairs_of(parts, unspaced)
    ending = pairs_of(parts, unspaced, LONGER)[-1] if m and unspaced else pairs[-1]
    return {"own_line": len(found) == 1, "omitted": bool(m), "pair": ending, "pairs": sorted(set(pairs[:-1])) if len(found) == 1 else [], "broken": last[-1:] in ",،、，:：-（(" or text[-1:] in "  "}


class _Counts:
    """Word pairs with how often each stands inside a segment, ends a line, ends a sentence, and stands in an open line."""

    def __init__(self):
        self.kinds = [Counter() for _ in range(4)]

    def add(self, text: str) -> None:
        inside, line_end, sentence, in_open = self.kinds
        lines = text.split("\n")
        for k, line in enumerate(lines):
            final = k == len(lines) - 1
            for segment, closed in segments(line):
                parts, unspaced = units(segment), UNSPACED.search(segment) is not None
                if not parts:
                    continue
                grams = pairs_of(parts, unspaced)
                inside.update(grams[:-1])
                if unspaced:  # three characters seldom tell whether a sentence is complete
                    longer = pairs_of(parts, unspaced, LONGER)
                    inside.update(g for g, short in zip(longer[:-1], grams) if g != short)
                    if longer[-1] != grams[-1]:
                        (sentence if closed else inside)[longer[-1]] += 1
                if closed:
                    sentence[grams[-1]] += 1
                elif not final:  # the last line may itself be cut: no evidence
                    line_end[grams[-1]] += 1
                    in_open.update(grams)

    def __len__(self):
        return len(self.kinds[0])

    def frame(self, firsts: frozenset | None) -> pd.DataFrame:
        """What was counted, of pairs with one of ``firsts`` if these are given; counting begins anew."""
        pairs = [p for p in set().union(*self.kinds) if firsts is None or p[0] in firsts]
        made = {"first": [a for a, _ in pairs], "second": [b for _, b in pairs]}
        made |= {c: [k[p] for p in pairs] for c, k in zip(COUNTED, self.kinds)}
        self.kinds = [Counter() for _ in range(4)]
        return pd.DataFrame(made)


def _grams(firsts=None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = None if firsts is None else firsts.value
        for batch in batches:
            counts = _Counts()
            for text in batch["text"]:
                if text:
                    counts.add(text)
                    if len(counts) > MOST_COUNTED:
                        yield counts.frame(known)
            yield counts.frame(known)

    return run


def _tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, source, text in zip(batch["doc_id"], batch["source"], batch["text"]):
            found = tail(text) if text else None
            if found:
                rows.append((doc, source, len(text), found["own_line"], found["omitted"], found["broken"], *found["pair"], ["\t".join(p) for p in found["pairs"]]))
        yield pd.DataFrame(rows, columns=["doc_id", "source", "n", "own_line", "omitted", "broken", "first", "second", "pairs"])


def _cut(text: str) -> Column:
    """A text without the sign of omission and the white space at its end, see ``OMISSION``."""
    bare = F.regexp_replace(text, "(?U)" + OMISSION.pattern.removesuffix("$") + r"\z", "")
    # most texts end otherwise, which their last two characters tell
    return F.when(F.right(text, F.lit(2)).rlike(r"(?U)(?:\s|\.\.|…|。。|[.…][\])）])\z"), F.regexp_replace(bare, r"(?U)\s+\z", "")).otherwise(F.col(text))


def _prefix_key(value: str | Column, n: Column) -> Column:
    return F.xxhash64(n, F.left(value, n))


def prefix_links(docs: DataFrame) -> DataFrame:
    """Self-join by prefix: (doc_id, n_word, n_sentence, n_end, longer_doc_id) of texts with an open end that begin others.

    Signs of omission and white space at the end are left off every text before comparing. The text is compared with all
    texts longer than it, its own copies excluded; counted are those that go on inside its last word, with another word on
    the same line (or whatever follows a comma, hyphen or opening bracket, or a comma that is the last), and those in which the line, clause or sentence
    ends there. ``longer_doc_id`` is the smallest id among those that go on, else among all.

    Each text is hashed at all rungs of ``RUNGS`` below its length and meets the texts whose own highest rung that is; only
    a text that shares a rung is hashed again, at the lengths of those it met, and these hashes are counted before they are
    joined. So copies never meet one by one, and a frequent beginning costs no more than the lengths that share it. Null and
    empty texts, texts without a letter and texts that close their last sentence have no row; a doc_id that occurs twice is
    two texts.
    """
    texts = docs.select("doc_id", _cut("text").alias("cut")).where("cut <> ''").withColumn("n", F.length("cut"))
    rungs = F.array(*[F.lit(r) for r in RUNGS])
    closed = rf"[{re.escape(CLOSERS)}]+[{re.escape(BRACKETS)}]*\z"
    cuts = texts.where(F.col("cut").rlike(r"\p{L}") & ~F.right("cut", F.lit(32)).rlike(closed)).withColumn("rung", F.element_at(F.filter(rungs, lambda r: r <= F.col("n")), -1))
    wanted = materialize(cuts.select(_prefix_key("cut", F.col("rung")).alias("h"), F.col("n").alias("m")).distinct())
    keys = lambda cut: F.transform(F.filter(rungs, lambda r: r < F.length(cut)), lambda r: _prefix_key(cut, r))
    each = F.transform(F.array("cut"), keys)[0]  # so that the text is cut once, not once per rung
    probes = texts.select("doc_id", "n", F.explode(each).alias("h"))
    met = materialize(semi_join(probes, wanted, ["h"], "inner").where("m < n").select("doc_id", "m").distinct())
    longer = semi_join(texts, met, ["doc_id"], "inner").where("m < n")
    after, last = F.expr("substring(cut, m + 1, 64)"), F.expr("substring(cut, m, 1)")
    word = last.rlike(r"[\p{L}\p{M}\p{N}]") & after.rlike(rf"^[{JOINING}]?[\p{{L}}\p{{M}}\p{{N}}]")
    loose = last.rlike(rf"[{''.join(sorted(COMMAS))}{JOINING}(（\[]")
    sentence = ~word & (loose | after.rlike(rf"^(?:[^\S\r\n]*[{''.join(sorted(COMMAS))}]?[^\S\r\n]+[\p{{L}}\p{{M}}]|[{''.join(sorted(COMMAS))}]\z)"))
    keyed = longer.select("doc_id", "m", F.xxhash64(F.expr("left(cut, m)")).alias("h1"), F.crc32(F.expr("left(cut, m)")).alias("h2"), word.alias("word"), sentence.alias("sentence"))
    goes_on = F.col("word") | F.col("sentence")
    counted = keyed.groupBy("m", "h1", "h2").agg(
        F.count_if("word").alias("n_word"), F.count_if("sentence").alias("n_sentence"), F.count_if(~goes_on).alias("n_end"),
        F.coalesce(F.min(F.when(goes_on, F.col("doc_id"))), F.min("doc_id")).alias("longer_doc_id"),
    )
    own = cuts.select("doc_id", F.col("n").alias("m"), F.xxhash64("cut").alias("h1"), F.crc32("cut").alias("h2"))
    return own.join(counted, ["m", "h1", "h2"]).select("doc_id", "n_word", "n_sentence", "n_end", "longer_doc_id")


def tail_evidence(docs: DataFrame) -> DataFrame:
    """Documents with an open end and what the corpus says of it, see ``judged``."""
    texts = docs.select("doc_id", "source", "text").where("text IS NOT NULL")
    kind = "doc_id long, source string, n long, own_line boolean, omitted boolean, broken boolean, first string, second string, pairs array<string>"
    tails = materialize(texts.mapInPandas(_tails, kind))
    lines = tails.select("doc_id", F.explode("pairs").alias("p")).select("doc_id", F.split("p", "\t")[0].alias("first"), F.split("p", "\t")[1].alias("second"))
    firsts = materialize(tails.select("first").unionByName(lines.select("first")).distinct())
    # only pairs whose first word some tail has leave their task; the words are known there if they are few, else joined
    few = firsts.count() <= MOST_BROADCAST
    known = texts.sparkSession.sparkContext.broadcast(frozenset(r["first"] for r in firsts.collect())) if few else None
    counted = texts.select("text").mapInPandas(_grams(known), f"first string, second string, {', '.join(f'{c} long' for c in COUNTED)}")
    grams = materialize((counted if few else semi_join(counted, firsts, ["first"])).groupBy("first", "second").agg(*[F.sum(c).alias(c) for c in COUNTED]))
    pair = ["first", "second"]
    exact = tails.select(*pair).distinct().join(grams, pair, "left").na.fill(0, list(COUNTED))
    # tails too seldom seen to be judged by themselves: pairs of which they are strict prefixes, and their first word
    seldom = materialize(exact.where(F.col("inside") + F.col("line_end") + F.col("sentence") < LEAST_TOTAL).select(*pair))
    starts = F.transform(F.sequence(F.lit(0), F.length("second") - 1), lambda i: F.left("second", i))
    longer = grams.where("length(second) > 0").select("first", F.explode(starts).alias("second"))
    longer = semi_join(longer, seldom, pair).distinct().withColumn("goes_on", F.lit(True))
    by_first = grams.join(seldom.select("first").distinct(), "first", "left_semi").groupBy("first").agg(*[F.sum(c).alias(f"first_{c}") for c in COUNTED[:3]])
    exact = exact.join(longer, pair, "left").join(by_first, "first", "left").na.fill(0).na.fill(False).drop("in_open_line")
    # an open line with a pair that only sentences have is the beginning of a sentence
    seen = F.col("inside") + F.col("sentence")
    closed_only = grams.where((F.col("in_open_line") <= STRAY * seen) & (_upper(F.col("in_open_line"), seen, Z_OPEN) <= MOST_OPEN)).select(*pair)
    begun = lines.join(closed_only, pair, "left_semi").select("doc_id", F.lit(True).alias("begun")).distinct()
    # lengths at which a source's texts pile up are limits of its field
    sizes = texts.groupBy("source", F.length("text").alias("n")).agg(F.count("*").alias("here"))
    near = F.sum("here").over(Window.partitionBy("source").orderBy("n").rangeBetween(-10, 10))  # one row per length of a source
    limits = sizes.withColumn("around", near).where(_lower(F.col("here"), F.col("around"), Z_LIMIT) >= LIMIT_SHARE).select("source", "n", F.lit(True).alias("at_limit"))
    tails = tails.drop("pairs").join(begun, "doc_id", "left").join(exact, pair, "left")
    return tails.join(limits, ["source", "n"], "left").na.fill(False, ["at_limit", "begun"])


def _wilson(x: Column, n: Column, z: float, side: int) -> Column:
    rate = x / n
    return (rate + z * z / (2 * n) + side * z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _upper(x: Column, n: Column, z: float) -> Column:
    """Upper bound of a rate of ``x`` in ``n``; null where n is 0."""
    return F.when(n > 0, _wilson(F.least(x, n), n, z, 1))


def _lower(x: Column, n: Column, z: float) -> Column:
    return F.when(n > 0, _wilson(x, n, z, -1))


def judged(docs: DataFrame) -> DataFrame:
    """Documents whose text breaks off inside a word or sentence: (doc_id, source, route).

    ``route`` is the first of these that holds:

    - ``copy``: longer texts go on where the text ends, and none ends there.
    - ``follows_sentence``: an open sentence follows another on its line; headings and captions stand on lines of their own.
    - ``broken_sign``: an open line ends in a comma, colon, hyphen or opening bracket.
    - ``begun_sentence``: an open line has a pair that hardly ever stands in lines left open elsewhere.
    - ``tail``: an open line's last word pair never ends a line elsewhere, or a pair goes on from it much more often than it
      ends; where the pair is too seldom seen, whether longer pairs begin with it and what its first word does decide.
    - ``length_limit``: an open text has a length at which the texts of its source pile up.

    With a sign of omission, the sentence is complete if its last pair otherwise nearly always ends a sentence; a sign
    alone does not make a line broken. Null and empty texts are no cases; a doc_id that occurs twice has a row for each.
    """
    copied = prefix_links(docs).where("n_word + n_sentence > 0 AND n_end = 0").select("doc_id", F.lit(True).alias("copied")).distinct()
    e = tail_evidence(docs).join(copied, "doc_id", "left").na.fill(False, ["copied"])
    total = F.col("inside") + F.col("line_end") + F.col("sentence")
    first_total = F.col("first_inside") + F.col("first_line_end") + F.col("first_sentence")
    ends = F.when(total >= LEAST_TOTAL, F.col("line_end") > LEAST_ENDS * total).otherwise(~F.col("goes_on") & (F.col("first_line_end") > LEAST_ENDS * first_total))
    ended = F.col("omitted") & (total >= LEAST_TOTAL) & (F.col("sentence") >= SENTENCE_ENDS * total)
    route = (
        F.when(ended, None).when(F.col("copied"), "copy").when(~F.col("own_line"), "follows_sentence").when(F.col("broken") & ~F.col("omitted"), "broken_sign")
        .when(F.col("begun"), "begun_sentence").when(~ends, "tail").when(F.col("at_limit"), "length_limit")
    )
    return e.select("doc_id", "source", route.alias("route")).where("route IS NOT NULL")


def truncation_rates(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Per source: documents, those that break off, and their rate. A null source is a source."""
    cut = found.groupBy("source").agg(F.count("*").alias("n_truncated"))
    every = docs.groupBy("source").agg(F.count("*").alias("n_docs")).alias("e")
    joined = every.join(cut.alias("c"), F.col("e.source").eqNullSafe(F.col("c.source")), "left")
    n = F.coalesce("n_truncated", F.lit(0))
    return joined.select("e.source", "n_docs", n.alias("n_truncated"), (n / F.col("n_docs")).alias("rate"))
