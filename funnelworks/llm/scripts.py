"""Writing systems by ranges of code points."""

from __future__ import annotations

import numpy as np

#: First code point, last code point, script (Unicode blocks of living scripts).
RANGES = (
    (0x0041, 0x005A, "latin"),
    (0x0061, 0x007A, "latin"),
    (0x00AA, 0x00AA, "latin"),
    (0x00BA, 0x00BA, "latin"),
    (0x00B5, 0x00B5, "latin"),
    (0x00C0, 0x024F, "latin"),
    (0x0250, 0x02AF, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x06FF, "arabic"),
    (0x0750, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"),
    (0x0C00, 0x0C7F, "telugu"),
    (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"),
    (0x1200, 0x137F, "ethiopic"),
    (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x30FF, "kana"),
    (0x3400, 0x4DBF, "han"),
    (0x4E00, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
    (0xF900, 0xFAFF, "han"),
    (0x20000, 0x3134F, "han"),
)

NAMES = (*dict.fromkeys(name for *_, name in RANGES), "other")
OTHER = len(NAMES) - 1
_NUMBER = {name: i for i, name in enumerate(NAMES)}
_BY_CODE_POINT = np.full(0x3400, OTHER, np.int8)
for _a, _b, _name in RANGES:
    _BY_CODE_POINT[_a : _b + 1] = _NUMBER[_name]


def script_of(char: str) -> int:
    """Number in NAMES of the script of a letter; OTHER for letters of no listed range."""
    c = ord(char)
    if c < len(_BY_CODE_POINT):
        return int(_BY_CODE_POINT[c])
    return next((_NUMBER[name] for a, b, name in RANGES if a <= c <= b), OTHER)


_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
#: Letters below this one are Latin.
_AFTER_LATIN = "\u0250"


def letters_of(word: bytes) -> str:
    """The letters of a word, as written."""
    text = word.translate(None, _NO_LETTERS).decode()
    return text if not text or text.isalpha() else "".join(filter(str.isalpha, text))


def letters_by_script(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each word: how many letters it has, and the script of most of them (the first of equals)."""
    letters, scripts = np.zeros(len(words), np.int32), np.full(len(words), OTHER, np.int8)
    for i, raw in enumerate(words):
        word = letters_of(raw)
        if word:
            letters[i] = len(word)
            if max(word) < _AFTER_LATIN:
                scripts[i] = 0
            else:
                of = [script_of(c) for c in word]
                scripts[i] = max(dict.fromkeys(of), key=of.count)
    return letters, scripts
