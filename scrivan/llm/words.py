"""Words that ignore letter case, accents, punctuation and spacing; used where texts are compared word by word."""

from __future__ import annotations

import re
import sys
import unicodedata

_WORD = re.compile(r"[^\W_]+")
_PLAIN = re.compile(r"[0-9a-z]+")
_fold: dict[int, str] = {}


def fold_table() -> dict[int, str]:
    """Code point -> what stays of it without accents, from Unicode's decompositions; built once a process."""
    if not _fold:
        for cp in range(0xC0, sys.maxunicode + 1 if sys.maxunicode < 0x3000 else 0x3000):
            ch = chr(cp)
            plain = "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c))
            if plain != ch:
                _fold[cp] = plain
        _fold[ord("đ")] = "d"
        _fold[ord("Đ")] = "d"
    return _fold


def words(text: str) -> list[str]:
    """The runs of letters or digits of a text in lower case without accents."""
    low = text.lower()
    if not low.isascii():
        low = low.translate(fold_table())
        if not low.isascii():
            return _WORD.findall(unicodedata.normalize("NFKC", low))
    return _PLAIN.findall(low)


def located(text: str) -> list[tuple[str, int, int]]:
    """The words of a text with where each begins and ends in it."""
    table = fold_table()
    plain, at = [], []
    for k, ch in enumerate(text):
        for c in ch.lower().translate(table):
            plain.append(c)
            at.append(k)
    return [(m.group(), at[m.start()], at[m.end() - 1] + 1) for m in _WORD.finditer("".join(plain))]
