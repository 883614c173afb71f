"""Gold answers, letters parsed from model text, and the correctness flag."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The four option letters, in option order.
LETTERS = ("A", "B", "C", "D")

# Everything Python's str.strip() removes: Java's \s lacks the separators
# U+001C..U+001F, NEL and the Unicode space, line and paragraph separators.
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]*"
# One letter, or a digit 0-3 after any zeros: the look-ahead fixes the form, the
# group takes the character that decides.
_ANSWER = rf"\A{_SPACE}(?=(?:[ABCD]|0*[0-3]){_SPACE}\z)0*([ABCD0-3]){_SPACE}\z"

# A stand-alone capital A-D. Spelled with look-around because Java's \b and
# \w disagree with Python's on characters such as a superscript two.
_STANDALONE = r"(?<![\p{L}\p{N}_])([ABCD])(?![\p{L}\p{N}_])"

INVALID_MODES = ("raise", "null")


def _letter_of(code: Column, extra: dict[str, str] | None = None) -> Column:
    """The letter a code stands for, or null. A constant map, so that the code
    expression is evaluated once, which a ``when`` on it would not."""
    known = {letter: letter for letter in LETTERS} | (extra or {})
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.try_element_at(table, code)


def answer_letter(answer: Column, on_invalid: str = "raise") -> Column:
    """Letter of a gold answer given as 0-3, a digit string or a letter.

    Works on integer and string columns alike (cast a boolean column to int
    first). White space around a string is ignored. Digits must be ASCII.
    Anything else, null included, is an error, or null with
    ``on_invalid="null"``. The error is evaluated lazily: Spark raises it only
    if the column is used; see ``operators.contract`` for an eager check.
    """
    if on_invalid not in INVALID_MODES:
        raise ValueError(f"on_invalid must be one of {INVALID_MODES}, got {on_invalid!r}")
    digits = {str(i): letter for i, letter in enumerate(LETTERS)}
    letter = _letter_of(F.regexp_extract(answer.cast("string"), _ANSWER, 1), digits)
    if on_invalid == "null":
        return letter
    shown = F.coalesce(answer.cast("string"), F.lit("null"))
    return F.coalesce(letter, F.raise_error(F.concat(F.lit("unexpected answer: "), shown)))


def parse_letter(text: Column) -> Column:
    """First stand-alone capital A-D, else the first character if it is a-d/A-D, else null."""
    found = _letter_of(F.regexp_extract(text, _STANDALONE, 1))
    lower = {letter.lower(): letter for letter in LETTERS}
    return F.coalesce(found, _letter_of(F.substring(text, 1, 1), lower))


def is_correct(predicted: Column, gold: Column) -> Column:
    """Whether the prediction equals gold; a missing prediction is wrong, never null."""
    return F.coalesce(predicted == gold, F.lit(False))
