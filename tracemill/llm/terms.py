"""Plain words of a text: runs of digits, ASCII letters and all characters beyond ASCII, with A-Z in lower case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_TABLE = bytes(lower if (lower := b + 32 if 0x41 <= b <= 0x5A else b) in _WORD else 0x20 for b in range(256))


def text_bytes(text: str = "text") -> Column:
    """A text as its UTF-8 bytes."""
    return F.col(text).cast("string").cast("binary")


def spaced(data: bytes | None) -> bytes:
    """The text with lower-case words and a space for every other byte; a null is an empty text."""
    return (data or b"").translate(_TABLE)


def words(data: bytes | None) -> list[bytes]:
    return spaced(data).split()
