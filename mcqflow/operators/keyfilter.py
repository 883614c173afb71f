"""A Bloom filter of keys as a column test, built by an aggregate and bounded in size.

The filter is an array of 64-bit words. A key sets ``PROBES`` bits of one word, so a test reads one
word. It reaches the tasks as the value of a scalar subquery. Above ``MAX_WORDS`` it doesn't
grow: more keys then let more others pass, which is why an exact join must follow.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BITS_PER_KEY = 12
PROBES = 4
MAX_WORDS = 1 << 18  # two megabytes


def word_count(keys: int) -> int:
    """A power of two with ``BITS_PER_KEY`` bits for each key, up to ``MAX_WORDS``."""
    return min(MAX_WORDS, 1 << max(0, (max(keys, 1) * BITS_PER_KEY - 1) // 64).bit_length())


def _same(columns: Sequence[str]) -> list[Column]:
    """A key as text: integers of any width have one hash, as they are equal in a join."""
    return [F.col(c).cast("string") for c in columns]


def _word(columns: Sequence[str], words: int) -> Column:
    return F.pmod(F.xxhash64(*_same(columns)), F.lit(words)).cast("int")


def _bits(columns: Sequence[str]) -> Column:
    """The bits that a key sets in its word."""
    h, one = F.xxhash64(F.lit(PROBES), *_same(columns)), F.lit(1).cast("bigint")
    out = F.lit(0).cast("bigint")
    for i in range(PROBES):
        at = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", one, at))
    return out


@dataclass(frozen=True)
class KeyFilter:
    """Tests whether a row's ``columns`` may be among the keys; surely not where it says no."""

    columns: tuple[str, ...]
    words: int
    table: DataFrame

    @classmethod
    def of(cls, keys: DataFrame, columns: Sequence[str], at_most: int) -> KeyFilter:
        """A filter of the keys in ``columns``, for no more than ``at_most`` different ones."""
        words = word_count(at_most)
        some = keys.groupBy(_word(columns, words).alias("word")).agg(F.bit_or(_bits(columns)).alias("bits"))
        every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("word")).join(some, "word", "left")
        row = F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
        return cls(tuple(columns), words, every.agg(F.array_sort(F.collect_list(row))["bits"].alias("bits")))

    def may_hold(self) -> Column:
        bits = _bits(self.columns)
        return F.get(self.table.scalar(), _word(self.columns, self.words)).bitwiseAND(bits) == bits
