"""Missing or wrong document language labels (problem 5): hyperdimensional profiles.

Every letter has a random vector of +1 and -1, derived from its code point. An n-gram is bound by multiplying its letters'
vectors, each rotated by its place; a text is the bundle (sum) of its n-grams' vectors, a language's prototype that of its
samples' n-grams, weighted by how much they are the language's own. A text is given the language whose prototype has
the greatest cosine. The dot product of a bundle with a prototype is the sum of the dot
products of its n-grams, so these are computed once per n-gram and looked up after that; no text's own vector is stored.
Its norm is taken for that of as many independent vectors, which changes no text's order of languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import collect_bounded
from .scripts import CYRILLIC, GREEK, LATIN, unify

DIMENSIONS = 8192
ORDERS = (1, 2, 3)
SCALE = 1e5
MOST_SAMPLES = 50_000
#: Labelled texts beyond the samples that the fit draws, and the most characters of each: with these its memory is bounded.
MORE_SAMPLES, MOST_CHARS = 3_000, 20_000
MOST_KEPT = 2_000_000
CHUNK, MOST_LETTERS = 512, 10_000
LEAST_WORDS, LEAST_CHARS, LEAST_CLOSED = 3, 6, 3
SHARPNESS = 40.0
#: How much likelier a sentence is in the language of most of its text than in another, before it is read.
SAME_LANGUAGE = 8.0
NO_LANGUAGE = frozenset(["", "und", "unknown", "n/a", "na", "none", "null", "mul", "zxx", "xxx"])

_SPLIT = re.compile(r"(?<=[.!?。！？؟।॥…])[\"'»”’)\]）」』]*(?:\s+|(?<=[。！？]))|(?<=;)\s+|\s+[/|]\s+|\n+")
_SCRIPTS = [("latin", LATIN), ("cyrillic", CYRILLIC), ("greek", GREEK), ("arabic", re.compile("[\u0600-\u06ff]")), ("devanagari", re.compile("[\u0900-\u097f]")), ("east asian", re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]"))]
_KATAKANA = re.compile(r"[\W\u30a0-\u30ff]+")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿豈-﫿฀-๿]")
_MARKS_KEPT = re.compile(r"[^\ẁ-ͯऀ-ॿ؀-ۿ]+|[\d_]+", re.U)


def sentences(text: str) -> list[str]:
    """Sentences and lines of a text, in order; what has no letter is none.

    A piece whose words change from one script to another for good, with a sentence on either side, is two.
    """
    out = []
    for piece in _SPLIT.split(text):
        piece = piece.strip() if piece else ""
        if any(map(str.isalpha, piece)):
            out += [piece] if piece.isascii() else _by_script(piece)
    return out


def _script(word: str) -> str | None:
    for c in word:
        if c.isalpha():
            return next((name for name, own in _SCRIPTS if own.match(c)), "other")
    return None


def _by_script(piece: str) -> list[str]:
    words = piece.split()
    labels = [_script(w) for w in words]
    known = [x for x in labels if x]
    if len(set(known)) < 2 or known[0] == known[-1]:
        return [piece]
    first, last = known[0], known[-1]
    best = max(range(1, len(words)), key=lambda i: sum(x == first for x in labels[:i]) + sum(x == last for x in labels[i:]))
    left, right = " ".join(words[:best]), " ".join(words[best:])
    return [left, right] if is_sentence(left) and is_sentence(right) else [piece]


def letters(text: str) -> str:
    """Lower-case letters with single spaces between words and at both ends."""
    return f" {_MARKS_KEPT.sub(' ', unify(text).casefold()).strip()} "


def is_sentence(text: str) -> bool:
    """At least ``LEAST_WORDS`` words; where words are not spaced, a closed sentence or ``LEAST_CHARS`` letters. A name alone is none."""
    if _UNSPACED.search(text):
        n = sum(map(str.isalpha, text))
        return not _KATAKANA.fullmatch(text.strip()) and n >= (LEAST_CLOSED if text.rstrip()[-1:] in "。！？" else LEAST_CHARS)
    return sum(any(map(str.isalpha, w)) for w in text.split()) >= LEAST_WORDS


_letters: dict[int, np.ndarray] = {}


def _letter_vectors(codes: np.ndarray) -> np.ndarray:
    """The random vector of each code point, always the same for one; up to ``MOST_LETTERS`` are kept per process."""
    if len(_letters) > MOST_LETTERS:
        _letters.clear()
    out = np.empty((len(codes), DIMENSIONS), np.int8)
    for row, code in enumerate(codes.tolist()):
        if code not in _letters or len(_letters[code]) != DIMENSIONS:
            _letters[code] = np.random.default_rng(0x9E37 + code).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1
        out[row] = _letters[code]
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of all texts and the text of each; a code packs the order's code points, 21 bits each."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "uint32").astype("uint64")
    sizes = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    codes, owners = [], []
    for n in ORDERS:
        code = flat[: len(flat) - n + 1].copy()
        for k in range(1, n):
            code = code << np.uint64(21) | flat[k : len(flat) - n + 1 + k]
        whole = owner[: len(code)] == owner[n - 1 :] if n > 1 else np.ones(len(code), bool)
        whole &= code != sum(32 << 21 * k for k in range(n))  # spaces only
        codes.append(code[whole])
        owners.append(owner[: len(code)][whole])
    return np.concatenate(codes), np.concatenate(owners)


def _gram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors of n-gram codes. Code points are above 0, so the number of parts is the order."""
    parts = [codes & np.uint64(0x1FFFFF), codes >> np.uint64(21) & np.uint64(0x1FFFFF), codes >> np.uint64(42)]
    known, at = np.unique(np.concatenate(parts), return_inverse=True)
    base = _letter_vectors(known)
    base[known == 0] = 1
    out = np.ones((len(codes), DIMENSIONS), np.int8)
    for k, index in enumerate(np.split(at, 3)):
        out *= np.roll(base, k * 7 + k, axis=1)[index]
    return out


class Profiles:
    """Language prototypes and the scores of n-grams against them, kept per worker."""

    def __init__(self, languages: list[str], prototypes: np.ndarray):
        self.languages = languages
        self.prototypes = (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)).astype("float32")
        self.codes, self.scores = np.zeros(0, "uint64"), np.zeros((0, len(languages)), "float32")

    def __getstate__(self):
        return self.languages, self.prototypes

    def __setstate__(self, state):
        self.__init__(*state)

    def gram_scores(self, codes: np.ndarray) -> np.ndarray:
        """Rows of dot products for sorted distinct codes; new n-grams are added to those kept."""
        if len(self.codes) > MOST_KEPT:  # they can be computed again
            self.codes, self.scores = self.codes[:0], self.scores[:0]
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        if len(new):
            made = np.concatenate([_gram_vectors(new[i : i + CHUNK]).astype("float32") @ self.prototypes.T for i in range(0, len(new), CHUNK)])
            every = np.concatenate([self.codes, new])
            order = np.argsort(every, kind="stable")
            self.codes, self.scores = every[order], np.concatenate([self.scores, made])[order]
        return self.scores[np.searchsorted(self.codes, codes)]

    def cosines(self, texts: list[str]) -> np.ndarray:
        """Cosine of each text with each prototype; 0 for texts without letters."""
        out = np.zeros((len(texts), len(self.languages)), "float32")
        codes, owner = _grams(texts)
        if len(codes):
            distinct, at = np.unique(codes, return_inverse=True)
            scores = self.gram_scores(distinct)
            n = np.bincount(owner, minlength=len(texts))
            for k in range(out.shape[1]):
                out[:, k] = np.bincount(owner, scores[at, k], len(texts))
            out /= np.sqrt(np.maximum(n, 1) * DIMENSIONS)[:, None]
        return out

    def judge(self, texts: list[str], owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language of each text and the confidence: its share in the softmax of the cosines.

        ``owner`` tells which texts are parts of one: the language of most of its letters is then ``SAME_LANGUAGE`` times
        likelier for each part, so that short parts, which related languages share, follow the rest.
        """
        cos = self.cosines([letters(t) for t in texts])
        power = np.exp(SHARPNESS * (cos - cos.max(axis=1, keepdims=True)))
        if owner is not None and len(texts):
            share = power / power.sum(axis=1, keepdims=True) * np.array([len(t) for t in texts])[:, None]
            total = np.zeros((int(owner.max()) + 1, len(self.languages)))
            np.add.at(total, owner, share)
            power[np.arange(len(texts)), total.argmax(axis=1)[owner]] *= SAME_LANGUAGE
        best = power.argmax(axis=1)
        return best, (power.max(axis=1) / power.sum(axis=1)).astype("float64")


def train(samples: list[tuple[str, str]]) -> Profiles:
    """Prototypes from (language, text): the bundle of each language's n-grams.

    An n-gram is weighted by the logarithm of its share in the language, less the mean of these logarithms over the
    languages: what all languages have in common tells none from another.
    """
    rows = sorted({(lang, letters(text)) for lang, text in samples if lang and text})
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        raise ValueError("no labelled samples")
    seen = {}
    for lang in languages:
        texts = [t for x, t in rows if x == lang]
        blocks = [np.unique(_grams(texts[i : i + 200])[0], return_counts=True) for i in range(0, len(texts), 200)]
        every, at = np.unique(np.concatenate([c for c, _ in blocks]), return_inverse=True)
        seen[lang] = every, np.bincount(at, np.concatenate([n for _, n in blocks]), len(every))
    distinct = np.unique(np.concatenate([c for c, _ in seen.values()]))
    counts = np.zeros((len(languages), len(distinct)))
    for k, lang in enumerate(languages):
        counts[k, np.searchsorted(distinct, seen[lang][0])] = seen[lang][1]
    weights = np.log1p(SCALE * counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype("float32")
    weights -= weights.mean(axis=0)
    prototypes = np.zeros((len(languages), DIMENSIONS), "float32")
    for i in range(0, len(distinct), CHUNK):
        prototypes += weights[:, i : i + CHUNK] @ _gram_vectors(distinct[i : i + CHUNK]).astype("float32")
    return Profiles(languages, prototypes)


def label_table(languages: DataFrame) -> dict[str, str]:
    """Spellings of a label, in lower case with ``_``, and the code each stands for: codes, their language part, names."""
    rows = collect_bounded(languages.select("lang_code", "iso639_1", "english_name"), 100_000, "the languages")
    out: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: r["lang_code"] or ""):
        code = r["lang_code"]
        if code:
            for spelling in (code, code.split("_")[0], r["iso639_1"], r["english_name"]):
                if spelling:
                    out.setdefault(spelling.strip().lower().replace("-", "_"), code)
    return out


def read_label(label: str | None, table: dict[str, str]) -> str | None:
    """The code a label stands for, the label itself if it names a language unknown to the table, None if it names none."""
    plain = (label or "").strip().lower().replace("-", "_")
    if plain in table:
        return table[plain]
    head = plain.split("_")[0]
    if plain in NO_LANGUAGE or head in NO_LANGUAGE:
        return None
    return table.get(head)


def _parts(profiles, key: str, text: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Profiles = profiles.value
        for batch in batches:
            parts, rows = [], []
            for row, value in enumerate(batch[text]):
                for k, s in enumerate(sentences(unify(value)) if value else ()):
                    parts.append(s)
                    rows.append((row, k))
            if not parts:
                continue
            at = np.array([r for r, _ in rows])
            lang, sure = model.judge(parts, at)
            yield pd.DataFrame({
                key: batch[key].to_numpy()[at], "part": [k for _, k in rows], "text": parts, "lang": np.array(model.languages)[lang], "confidence": sure,
                "n_letters": [sum(map(str.isalpha, s)) for s in parts], "is_sentence": [is_sentence(s) for s in parts],
            })

    return run


def fit(samples: DataFrame, more: DataFrame | None = None, most: int = MORE_SAMPLES) -> Profiles:
    """Profiles from (lang, text): all ``samples``, checked to be at most ``MOST_SAMPLES``, and a bounded number of ``more``.

    ``more`` has (doc_id, lang, text); the ``most`` labelled rows with the least hash of doc_id are used, of languages in
    ``samples`` only and of at most ``MOST_CHARS`` characters. This bounds what the classifier is fitted on, not what it is
    applied to.
    """
    rows = [(r["lang"], r["text"]) for r in collect_bounded(samples.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL"), MOST_SAMPLES, "the samples")]
    if more is not None:
        known = {lang for lang, _ in rows}
        drawn = more.where(F.col("lang").isin(*known) & (F.length("text") <= MOST_CHARS)).select("lang", "text", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"))
        part = min(1.0, 4 * most / max(1, more.count()))  # so few rows reach the sort, however many there are
        drawn = drawn.where(F.col("h").bitwiseAND((1 << 52) - 1) < int(part * (1 << 52)))
        rows += [(r["lang"], r["text"]) for r in drawn.orderBy("h", "t").limit(most).collect()]
    return train(rows)


def segment_languages(df: DataFrame, profiles: Profiles, key: str = "pair_id", text: str = "anchor") -> DataFrame:
    """(``key``, part, text, lang, confidence, n_letters, is_sentence): each sentence or line of each text and its language.

    Neighbouring parts of one language are one segment to whoever groups them. Null texts and texts without letters have
    no row; a part of a repeated ``key`` comes once for each of its rows.
    """
    model = df.sparkSession.sparkContext.broadcast(profiles)
    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(_parts(model, key, text), f"`{key}` {kind}, part int, text string, lang string, confidence double, n_letters long, is_sentence boolean")


def _judged(profiles, table: dict[str, str], key: str, text: str):
    """Per text in one pass: main language, confidence, languages of its whole sentences, and the label read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Profiles = profiles.value
        for batch in batches:
            texts, labels = list(batch[text]), list(batch["label"])
            parts, owner = [], []
            for row, value in enumerate(texts):
                found = sentences(unify(value)) if value else []
                parts += found
                owner += [row] * len(found)
            out = []
            lang, sure = model.judge(parts, np.array(owner)) if parts else ((), ())
            at = 0
            while at < len(parts):
                stop = at
                weight: dict[str, float] = {}
                trust: dict[str, float] = {}
                whole: list[str] = []
                count = 0
                while stop < len(parts) and owner[stop] == owner[at]:
                    code, n = model.languages[lang[stop]], sum(map(str.isalpha, parts[stop]))
                    weight[code] = weight.get(code, 0) + n
                    trust[code] = trust.get(code, 0) + n * sure[stop]
                    if is_sentence(parts[stop]):
                        count += 1
                        if code not in whole:
                            whole.append(code)
                    stop += 1
                row = owner[at]
                in_sentences = {c: w for c, w in weight.items() if c in whole} or weight
                main = max(in_sentences, key=lambda c: (in_sentences[c], c))
                enough = count > 0 or (" " in texts[row].strip() and is_sentence(texts[row]))
                out.append((batch[key].iloc[row], main, float(trust[main] / weight[main]), whole or [main], read_label(labels[row], table), labels[row], enough))
                at = stop
            yield pd.DataFrame(out, columns=[key, "lang", "confidence", "langs", "label_code", "label", "enough"])

    return run


def text_languages(df: DataFrame, profiles: Profiles, languages: DataFrame, key: str, text: str, label) -> DataFrame:
    """(``key``, lang, confidence, langs, label_code, label, enough) per text that has letters.

    ``lang`` is the language of most letters, of whole sentences if there are any; ``langs`` those of its whole
    sentences; ``label_code`` what the label names, null if nothing; ``enough`` whether the text has a whole sentence.
    """
    model = df.sparkSession.sparkContext.broadcast(profiles)
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key), F.col(text), label.alias("label"))
    return rows.mapInPandas(_judged(model, label_table(languages), key, text), f"`{key}` {kind}, lang string, confidence double, langs array<string>, label_code string, label string, enough boolean")


def wrong_labels(judged: DataFrame, key: str = "pair_id") -> DataFrame:
    """(``key``, lang): texts whose label is missing or wrong, or that have a whole sentence in a second language; one row per language."""
    case = F.col("enough") & (F.col("label_code").isNull() | (F.col("label_code") != F.col("lang")) | (F.size("langs") > 1))
    return judged.where(case).select(key, F.explode("langs").alias("lang")).distinct()
