"""Words of whole UTF-8 texts by byte tables, a bounded piece of the text at a time."""

from __future__ import annotations

from collections.abc import Iterator

#: How many bytes are cut into words at once, so that a very long text never becomes one list of words.
SLICE_BYTES = 1 << 20


def byte_table(blank: bytes, breaks: bytes = b"") -> bytes:
    """A translation table: A-Z to a-z, ``blank`` bytes to a space, ``breaks`` to a line feed."""
    table = bytearray(range(256))
    table[0x41:0x5B] = range(0x61, 0x7B)
    for b in blank:
        table[b] = 0x20
    for b in breaks:
        table[b] = 0x0A
    return bytes(table)


def slices(data: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes that end with a space; a longer word stays whole."""
    at = 0
    while len(data) - at > size:
        cut = data.rfind(b" ", at, at + size)
        if cut < 0:
            cut = data.find(b" ", at + size)
        if cut < 0:
            break
        yield data[at : cut + 1]
        at = cut + 1
    yield data[at:] if at else data
