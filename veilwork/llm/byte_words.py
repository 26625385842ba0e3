"""Words of UTF-8 bytes by a translate table, a bounded piece of a text at a time."""

from __future__ import annotations

from collections.abc import Iterator

#: Words of a text are split a piece of so many bytes at a time, so that a very long text makes no list of all its words.
PIECE = 1 << 20


def letters_table(digits: bool = False) -> bytes:
    """For bytes.translate: A-Z become a-z; a-z, bytes above 127 and, if asked for, digits stay; the rest turn blank."""
    table = bytearray(b" " * 256)
    for b in range(256):
        if b > 127 or 97 <= b <= 122 or digits and 48 <= b <= 57:
            table[b] = b
        elif 65 <= b <= 90:
            table[b] = b + 32
    return bytes(table)


def word_pieces(text: bytes, table: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of the translated text in order, in lists of those of about ``size`` bytes."""
    if len(text) <= size:
        yield text.translate(table).split()
        return
    text, at = text.translate(table), 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end
