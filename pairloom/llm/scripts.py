"""One script per word: undoes look-alike letters of another script before words are compared or languages told apart."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from .lookalikes import HIDDEN

# Cyrillic and Greek letters that look like Latin ones, by which the script of a word is told.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ι": "i", "α": "a", "ρ": "p", "υ": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ɑ": "a", "ɡ": "g", "ı": "i",
}

LATIN, CYRILLIC, GREEK = re.compile(r"[A-Za-zÀ-ɏḀ-ỿ]"), re.compile(r"[Ѐ-ԯ]"), re.compile(r"[Ͱ-Ͽἀ-῿]")
_HIDDEN = dict.fromkeys(map(ord, HIDDEN))
_TO_LATIN = str.maketrans({c: p for c, p in LOOK_ALIKES.items() if p.isalpha()})
_TO_CYRILLIC = str.maketrans({p: c for c, p in LOOK_ALIKES.items() if CYRILLIC.match(c)} | {"ο": "о", "ν": "v", "Τ": "Т", "Ο": "О", "Α": "А", "Ε": "Е", "Μ": "М", "Ρ": "Р", "Κ": "К", "Β": "В", "Η": "Н", "Χ": "Х"})
_TO_GREEK = str.maketrans({p: c for c, p in LOOK_ALIKES.items() if GREEK.match(c) and c not in "ϲϳ"} | {"о": "ο", "О": "Ο", "а": "α", "А": "Α", "р": "ρ", "Р": "Ρ", "Т": "Τ", "Е": "Ε", "М": "Μ", "Н": "Η", "К": "Κ", "В": "Β", "Х": "Χ"})
_WORD = re.compile(r"[^\W\d_]+", re.U)
_OWN = {  # letters that no other script's letter looks like
    "latin": frozenset("bdfghklmnqrtuvwzFGLQRUVWDJS") | frozenset(chr(c) for c in range(0xC0, 0x250)),
    "cyrillic": frozenset(chr(c) for c in range(0x400, 0x530)) - frozenset(LOOK_ALIKES),
    "greek": frozenset(chr(c) for c in (*range(0x370, 0x400), *range(0x1F00, 0x2000))) - frozenset(LOOK_ALIKES),
}
_TO = {"latin": _TO_LATIN, "cyrillic": _TO_CYRILLIC, "greek": _TO_GREEK}


@cache
def _own(letter: str) -> str | None:
    base = unicodedata.normalize("NFD", letter)[0]
    for script, letters in _OWN.items():
        if base in letters or (letter in letters and base not in LOOK_ALIKES and not base.isascii()):
            return script
    return None


def _word_script(word: str) -> str | None:
    counts: dict[str, int] = {}
    for letter in word:
        script = _own(letter)
        if script:
            counts[script] = counts.get(script, 0) + 1
    return max(counts, key=counts.get) if counts else None


def unify(text: str) -> str:
    """``text`` under NFKC, without characters that are not displayed, each word in the script of its unmistakable letters.

    A word of look-alikes only takes the script of the nearest word before it that has one, else of the one after it.
    Texts of one script are returned after a few fast tests.
    """
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", text.translate(_HIDDEN))
    if (LATIN.search(text) is not None) + (CYRILLIC.search(text) is not None) + (GREEK.search(text) is not None) < 2:
        return text
    found = list(_WORD.finditer(text))
    known = [_word_script(m.group()) for m in found]
    out, at, last = [], 0, next((k for k in known if k), "latin")
    for m, script in zip(found, known):
        out.append(text[at : m.start()])
        last = script or last
        out.append(m.group().translate(_TO[last]))
        at = m.end()
    return unicodedata.normalize("NFC", "".join(out) + text[at:])
