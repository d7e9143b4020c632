"""Terms by language for overlap: stop words and lemmas from optional libraries, where they are installed.

``simplemma`` has the lemmas of most languages, ``pymorphy3`` those of Russian, ``sudachipy`` cuts Japanese, and
``stopwordsiso`` has stop words. None of them is needed: without its library a language is cut as any other whose words are
spaced, or into letter pairs, and has no stop words. What is loaded is kept per worker process.
"""

from __future__ import annotations

import importlib
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import UNSEGMENTED_SCRIPTS, bigrams_of, canonical

# Language codes whose lemmas the library has, and its name for each.
LEMMA_LANGUAGES = {
    "ast": "ast", "bul": "bg", "cat": "ca", "ces": "cs", "cym": "cy", "dan": "da", "deu": "de", "ekk": "et", "ell": "el", "eng": "en", "enm": "enm", "epo": "eo", "est": "et", "fas": "fa", "fil": "tl",
    "fin": "fi", "fra": "fr", "gla": "gd", "gle": "ga", "glg": "gl", "glv": "gv", "hbs": "hbs", "hin": "hi", "hrv": "hbs", "hun": "hu", "hye": "hy", "ind": "id", "isl": "is", "ita": "it", "kat": "ka",
    "lat": "la", "lit": "lt", "ltz": "lb", "lvs": "lv", "mkd": "mk", "nld": "nl", "nno": "nn", "nob": "nb", "pol": "pl", "por": "pt", "ron": "ro", "rus": "ru", "slk": "sk", "slv": "sl", "sme": "se",
    "spa": "es", "sqi": "sq", "srp": "hbs", "swe": "sv", "swh": "sw", "tur": "tr", "ukr": "uk", "zsm": "ms",
}
# Further codes for which there are stop words only.
STOP_WORD_LANGUAGES = LEMMA_LANGUAGES | {"afr": "af", "arb": "ar", "ben": "bn", "eus": "eu", "heb": "he", "jpn": "ja", "kor": "ko", "tha": "th", "vie": "vi", "yue": "zh", "cmn": "zh"}
# Parts of speech that are no terms in Japanese: particles, auxiliaries, signs and space.
JAPANESE_IGNORED = ("助詞", "助動詞", "補助記号", "空白")
MOST_KEPT = 1 << 17
_WORDS = re.compile(r"[^\W\d_]+", re.U)


@lru_cache(None)
def library(name: str):
    """A library that may not be installed; None then."""
    try:
        return importlib.import_module(name)
    except ImportError:
        return None


@lru_cache(None)
def stop_words(code: str) -> frozenset[str]:
    """Canonical stop words of a language code; none without the library or its list."""
    name, lists = STOP_WORD_LANGUAGES.get(code), library("stopwordsiso")
    return frozenset(map(canonical, lists.stopwords(name))) if name and lists else frozenset()


@lru_cache(None)
def _russian():
    lib = library("pymorphy3")
    return lib and lib.MorphAnalyzer()


@lru_cache(None)
def _japanese():
    lib = library("sudachipy")
    return lib and lib.Dictionary().create(mode=lib.SplitMode.C)


@lru_cache(MOST_KEPT)
def lemma(word: str, code: str) -> str:
    """Base form of a canonical word; the word itself where no library knows better."""
    if code == "rus" and _russian():
        parsed = _russian().parse(word)
        return parsed[0].normal_form.casefold().replace("ё", "е") if parsed else word
    lib, name = library("simplemma"), LEMMA_LANGUAGES.get(code)
    return lib.lemmatize(word, lang=name).casefold() if lib and name and code != "rus" else word


def japanese_terms(text: str) -> list[str]:
    """Dictionary forms of the words of a Japanese text; its letter pairs without the library."""
    cutter = _japanese()
    if not cutter:
        return bigrams_of(text)
    out = set()
    for m in cutter.tokenize(unicodedata.normalize("NFKC", text)):
        if m.part_of_speech()[0] not in JAPANESE_IGNORED:
            base = m.dictionary_form().casefold().strip()
            base = m.surface().casefold().strip() if base in ("", "*") else base
            if any(c.isalnum() for c in base) and base not in stop_words("jpn"):
                out.add(base)
    return sorted(out)


def lemma_terms_of(text: str, language: str | None, stops: bool = True, fallback: str = "surface") -> list[str]:
    """Terms of a text under the router: Japanese by its own cutter, scripts without spaces as letter pairs, others as lemmas.

    Words below two letters and stop words are dropped, before and after. A language without lemmas keeps its words under
    the fallback ``surface`` and has no terms under ``reject``.
    """
    if fallback not in ("surface", "reject"):
        raise ValueError(f"unknown fallback {fallback}")
    code, _, script = (language or "").partition("_")
    code = code.casefold()
    if code == "jpn":
        return japanese_terms(text)
    if script in UNSEGMENTED_SCRIPTS:
        return bigrams_of(text)
    if code not in LEMMA_LANGUAGES and fallback == "reject":
        return []
    gone = stop_words(code) if stops else frozenset()
    words = (w for w in _WORDS.findall(canonical(text)) if len(w) > 1 and w not in gone)
    return sorted({base for base in (lemma(w, code) for w in words) if len(base) > 1 and base not in gone})


def lemma_terms(text: str | Column, language: str | Column, stops: bool = True, fallback: str = "surface") -> Column:
    """``lemma_terms_of`` of columns, in Arrow batches; a null text has no terms."""
    if fallback not in ("surface", "reject"):
        raise ValueError(f"unknown fallback {fallback}")

    def run(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([lemma_terms_of(t, lang, stops, fallback) if t else [] for t, lang in zip(texts, languages)])

    return F.pandas_udf(run, ArrayType(StringType()))(text, language)
