"""Words of texts as bytes, by tables of the bytes that words are made of."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text that are split at a time.
SLICE = 1 << 20


def table(digits: bool) -> bytes:
    """For bytes.translate: letters in lower case, digits if asked for, and the bytes of characters outside ASCII stay; all others part words."""
    stays = lambda b: b > 0x7F or chr(b).isalpha() or digits and chr(b).isdigit()
    return bytes(b if stays(b) else 0x20 for b in range(256)).lower()


def words_of(text: bytes, kept: bytes) -> Iterator[list[bytes]]:
    """The words of a text in slices that end between words, so that a very long text is never all split at once."""
    plain = text.translate(kept)
    at = 0
    while at < len(plain):
        end = len(plain)
        if end - at > SLICE:
            end = plain.rfind(b" ", at, at + SLICE)
            if end < 0:  # a word longer than a slice
                end = plain.find(b" ", at + SLICE)
                end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end + 1
