"""A keyed permutation of 0 .. n-1 as a column: a position is computed, not ranked.

An index is a pair of digits (left, right) of the mixed base a x b, where a is the root of n,
rounded up. A round adds a keyed digest of one digit to the other, modulo its base, so each
can be undone and all together permute the a x b pairs. There are at most a - 1 pairs too
many. An index that lands on one of them walks on, through the permutation again, until it
is back below n: it must be after at most as many steps as there are such pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

ROUNDS = 6


def sides(n: int) -> tuple[int, int]:
    """The bases of the two digits; their product is at least n, and below n + the first."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _once(index: Column, n: int, key: Column) -> Column:
    """The permutation of all pairs."""
    a, b = sides(n)
    pair = F.struct(F.floor(index / b).cast("bigint").alias("left"), (index % b).alias("right"))
    turns = F.sequence(F.lit(0), F.lit(ROUNDS // 2 - 1))

    def turn(state: Column, i: Column) -> Column:
        def side(k: int, digit: Column, base: int) -> Column:
            text = F.concat(key, F.lit(f":{k}:"), i.cast("string"), F.lit(":"), digit.cast("string"))
            return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % base

        left = (state["left"] + side(0, state["right"], a)) % a
        return F.get(F.transform(F.array(left), lambda x: F.struct(
            x.alias("left"), ((state["right"] + side(1, x, b)) % b).alias("right")
        )), F.lit(0))

    return F.aggregate(turns, pair, turn, lambda state: state["left"] * b + state["right"])


def permuted(index: Column, n: int, key: Column) -> Column:
    """The position of ``index`` in the order that the string ``key`` gives 0 .. n-1."""
    a, b = sides(n)
    index = index.cast("bigint")
    more = a * b - n
    if not more:
        return _once(index, n, key)
    steps = F.sequence(F.lit(1), F.lit(more))

    def walk(first: Column) -> Column:
        return F.when(first < n, first).otherwise(
            F.aggregate(steps, first, lambda at, _: F.when(at < n, at).otherwise(_once(at, n, key)))
        )

    return F.get(F.transform(F.array(_once(index, n, key)), walk), F.lit(0))
