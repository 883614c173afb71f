"""Supervision labels and first-token scoring over id arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the label a loss function skips.
IGNORE = -100


def ignored(n: Column) -> Column:
    """``n`` ignore labels."""
    return F.array_repeat(F.lit(IGNORE), n)


def mask_prompt(ids: Column, prompt_len: Column) -> Column:
    """Labels equal to the ids, with the first ``prompt_len`` ignored."""
    masked = F.least(prompt_len, F.size(ids))
    return F.concat(ignored(masked), F.slice(ids, masked + 1, F.size(ids) - masked))


def has_supervision(labels: Column) -> Column:
    """Whether any label is not ignored."""
    return F.exists(labels, lambda x: x != IGNORE)


def first_supervised(labels: Column) -> Column:
    """0-based position of the first label that is not ignored, or null."""
    found = F.array_position(F.transform(labels, lambda x: x != IGNORE), F.lit(True))
    return F.when(found > 0, (found - 1).cast("int"))


def argmax(scores: Column) -> Column:
    """0-based position of the largest score, the first one on ties; NaN counts as largest."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def token_at(ids: Column, position: Column) -> Column:
    """The id at a 0-based position, null outside the array."""
    return F.get(ids, position.cast("int"))
