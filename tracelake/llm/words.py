"""Words of a text: A-Z in lower case, runs of letters, digits and everything beyond ASCII."""

from __future__ import annotations

import re

import pyarrow as pa

#: Of UTF-8 bytes: A-Z to a-z, other ASCII but letters and digits to a space.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
#: The same words in a text that still has its capitals.
WORD_IN_TEXT = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def normal_words(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_TABLE).split()


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str | int = "text") -> list[bytes]:
    """The texts of a column of a batch, by name or place."""
    return as_bytes(batch.column(name if isinstance(name, int) else batch.schema.get_field_index(name)))
