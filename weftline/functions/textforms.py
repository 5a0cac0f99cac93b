"""Plain text forms used by the core: one spelling for blanks, hyphens, digits and stray letters.

The core folds only what its parsers need.  Finding and repairing look-alike
characters as a problem of its own is an operator elsewhere.
"""

from __future__ import annotations

import re
import unicodedata

# Letters of other alphabets, and small capitals, with the Latin letters or digits they look like, the likeliest first.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "к": "k", "г": "r", "ь": "b", "и": "u", "п": "n",
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "Il", "Ј": "J", "Ѕ": "S", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ь": "b",
    "ο": "o", "ν": "v", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "uv", "χ": "x", "γ": "y", "ω": "w", "η": "n", "σ": "o", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "Il", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U", "Լ": "L",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ᴀ": "a", "ʙ": "b", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ɢ": "g", "ʜ": "h", "ɪ": "i", "ᴊ": "j", "ᴋ": "k", "ʟ": "l", "ᴍ": "m", "ɴ": "n", "ᴏ": "o", "ᴘ": "p", "ʀ": "r", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ʏ": "y", "ᴢ": "z",
}

_WORD = re.compile(r"[^\W_]+")
_LATIN = re.compile(r"[A-Za-z]")
_TO_LATIN = str.maketrans({k: v[0] for k, v in LOOK_ALIKES.items()})


class _Tidy(dict):
    """str.translate table: drops ignorable characters, unifies blanks and hyphens."""

    def __missing__(self, code: int):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind == "Cf" or code == 0x034F or 0xFE00 <= code <= 0xFE0F:
            to = None
        elif kind == "Zs":
            to = " "
        elif 0x2010 <= code <= 0x2015 or code == 0x2212:
            to = "-"
        elif code in (0x201C, 0x201D):
            to = '"'
        elif code in (0x2018, 0x2019, 0x2032):
            to = "'"
        else:
            to = ch
        self[code] = to
        return to


_TIDY = _Tidy()


def _latin_word(m: re.Match) -> str:
    w = m[0]
    return w.translate(_TO_LATIN) if not w.isascii() and _LATIN.search(w) else w


def fold(text: str | None) -> str:
    """Compatibility form without ignorable characters, look-alikes inside Latin words made Latin; ``None`` gives ``""``."""
    if not text:
        return ""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", text).translate(_TIDY)
    return text if text.isascii() else _WORD.sub(_latin_word, text)


def squash(text: str | None) -> str:
    """Folded text with single blanks and none at its ends."""
    return " ".join(fold(text).split())
