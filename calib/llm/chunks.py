"""Texts read in pieces of bounded size, cut where no term runs."""

from __future__ import annotations

import re
from collections.abc import Iterator

PIECE = 1 << 20
#: What ends a word, a term of letters and digits, and a term of letters.
SPACE = re.compile(rb"[\x09-\x0d\x20]")
NOT_ALNUM = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
NOT_ALPHA = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")


def chunks(text: bytes, ends: re.Pattern[bytes], piece: int = PIECE) -> Iterator[bytes]:
    """``text`` in pieces of about ``piece`` bytes, each but the last followed by an end."""
    start = 0
    while start < len(text):
        found = ends.search(text, start + piece) if len(text) - start > piece else None
        stop = found.start() if found else len(text)
        yield text[start:stop]
        start = stop


def folded(ends: re.Pattern[bytes]) -> bytes:
    """A table for ``bytes.translate``: A-Z become a-z and ends become spaces."""
    table = bytearray(range(256))
    for b in range(256):
        if ends.fullmatch(bytes([b])):
            table[b] = 0x20
        elif 0x41 <= b <= 0x5A:
            table[b] = b + 0x20
    return bytes(table)
