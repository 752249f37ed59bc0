"""Words of texts as bytes: A-Z lowered, all ASCII but letters and digits a break, all else a letter."""

from __future__ import annotations

import pyarrow as pa

SPACE, STOP = 32, 0
#: Byte to byte: a word's bytes, or a space. Bytes of code points beyond ASCII belong to words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else SPACE for b in range(256))
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20


def folded(column: pa.Array) -> list[bytes]:
    """Each text of an Arrow column with its words between spaces; a null is empty."""
    return [t.translate(FOLD) if t else b"" for t in column.cast(pa.binary()).to_pylist()]


def pieces(text: bytes, size: int = PIECE):
    """Parts of a folded text that are cut at spaces, never inside a word."""
    at = 0
    while len(text) - at > size:
        end = text.find(b" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text
