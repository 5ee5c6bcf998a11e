"""Words of a text: lower-cased ASCII letters, digits and all characters beyond ASCII, in UTF-8 bytes."""

from __future__ import annotations

import re

#: ASCII letters lower-cased, other ASCII characters that are no digits to spaces; bytes keep their places.
TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() and b < 0x80 else 0x20 for b in range(256)).lower()
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every word in the text's UTF-8 bytes."""
    return [m.span() for m in _WORD.finditer(text.encode().translate(TABLE))]
