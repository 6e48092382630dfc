"""Words of whole texts as UTF-8 bytes, in pieces of bounded size.

Only A-Z are lower-cased. A word is a run of bytes that a pattern takes; every byte from 0x80 on belongs to words, so
a run of bytes is a run of code points. A text is cut between words only, so no word is lost or split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

# What parts words.
LETTERS = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LETTERS_AND_DIGITS = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Bytes of text that are words at a time.
PIECE = 1 << 20


def word_pieces(text: bytes | None, pattern: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, as lists of those in about ``PIECE`` bytes; nothing for null or empty text."""
    if not text:
        return
    words, gap = re.compile(pattern), re.compile(pattern.replace(b"[^", b"[", 1)[:-1])
    text, at = text.lower(), 0  # of bytes: A-Z alone
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            found = gap.search(text, at + PIECE)
            end = found.start() if found else end
        yield words.findall(text[at:end])
        at = end
