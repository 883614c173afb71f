"""Token id arrays: the UTF-8 byte codec, truncation, masks, prompt cutting.

A codec is any object with ``encode(text, max_len)``, ``count(text, max_len)``
and ``decode(ids)`` over columns, and the ids ``eos_id`` and ``pad_id``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


def truncate(ids: Column, max_len: int | None) -> Column:
    """Keep the first ``max_len`` ids."""
    return ids if max_len is None else F.slice(ids, 1, max_len)


def attention_mask(ids: Column) -> Column:
    """One per id."""
    return F.array_repeat(F.lit(1), F.size(ids))


def cut_prompt(ids: Column, prompt_len: Column) -> Column:
    """The ids after the first ``prompt_len``."""
    return F.slice(ids, prompt_len + 1, F.greatest(F.size(ids) - prompt_len, F.lit(0)))


def drop_special(ids: Column, special: tuple[int, ...]) -> Column:
    """Remove special ids, keeping order."""
    return F.filter(ids, lambda i: ~i.isin(*special)) if special else ids


def resolve_pad_id(pad_id: Column, eos_id: Column) -> Column:
    """The pad id, or the end-of-sequence id where none is set."""
    return F.coalesce(pad_id, eos_id)


@dataclass(frozen=True)
class ByteCodec:
    """Ids 0-255 are the UTF-8 bytes of the text; special ids lie above.

    Stays inside the JVM: the bytes are read as Latin-1, where each byte is one
    character, so a split and a code point lookup give the ids.
    """

    eos_id: int = 256
    pad: int | None = None

    @property
    def pad_id(self) -> int:
        return self.eos_id if self.pad is None else self.pad

    @property
    def special_ids(self) -> tuple[int, ...]:
        return tuple(sorted({self.eos_id, self.pad_id}))

    def encode(self, text: Column, max_len: int | None = None) -> Column:
        # A character is at least one byte: cutting the text first loses no id
        # that truncation keeps, and spares the bytes it would drop.
        head = text if max_len is None else F.left(text, F.lit(max_len))
        latin = F.decode(F.encode(head, "UTF-8"), "ISO-8859-1")
        ids = F.transform(F.split(latin, ""), lambda c: F.ascii(c))
        none = F.array().cast("array<int>")
        return F.when(head == "", none).when(head.isNotNull(), truncate(ids, max_len))

    def count(self, text: Column, max_len: int | None = None) -> Column:
        """Number of ids ``encode`` would give, without making them."""
        n = F.octet_length(text)
        return n if max_len is None else F.least(n, F.lit(max_len))

    def decode(self, ids: Column) -> Column:
        """Text of the ids without special ids; a cut character becomes U+FFFD."""
        kept = drop_special(ids, self.special_ids)
        latin = F.array_join(F.transform(kept, lambda i: F.char(i)), "")
        return F.make_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string"))
