"""Suffix-array dedup: column-wise construction over many documents.

A 200-byte string holds one anchor, the 32-byte string in it with the smallest digest, the
leftmost of equal ones; equal strings have equal anchors at equal places. So a document is a
row of anchors, each with the stretch of text whose strings chose it. Stretches are brought
together by anchor (``repeats``); those whose anchor stands nowhere else can't repeat.

A part lines its stretches up at their anchors and builds their suffix order column by
column from the right: each round reads one column of the text that it holds, puts one symbol
in front of each stretch's suffix, and updates the order (the symbols in it are the
collection's Burrows-Wheeler transform for that column) and the common prefixes of
neighbours, by a stable sort of the order by symbol and range minima of the old prefixes.
Stretches join when their last column comes and leave behind their first. Where a common
prefix reaches 200 bytes the string repeats, and so does its neighbour's. Equal stretches of
one chunk are sent once, so what many texts share isn't gathered row by row.

Texts are their UTF-8 bytes; a null text is empty. Matches never cross documents. Every
string that starts anywhere else is removed, in all its places; overlaps count. Rows with
equal id and text are places of their own: they repeat each other. An empty table gives an
empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mcqflow.llm.repeats import ANSWERED, ASKED, find_repeats, merged, spans_of
from mcqflow.llm.words import U, mix

LENGTH = 200
GRAM = 32
PLACE_BITS = 22  # of a sliding minimum: the place in a slice
SLICE = 3 << 20

DDL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
)


def gram_digests(data: np.ndarray, size: int) -> np.ndarray:
    """A digest of each ``size`` bytes (a power of two), by doubling."""
    table = mix(np.arange(256, dtype=U) + U(0x5851F42D4C957F2D))
    digest, done, factor = table[data], 1, 0x9E3779B97F4A7C15
    while done < size:
        digest = digest[:-done] * U(factor) + digest[done:]
        factor = factor * factor % 2**64 | 1
        done *= 2
    return mix(digest)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


@dataclass
class Found:
    """Anchors of a chunk: strings that start at [first, last] chose the gram at ``at``; places in ``data``."""

    data: bytes
    base: np.ndarray  # where each document starts in data
    name: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray


def anchors_of(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """name, place, first and last string of each anchor of one text."""
    out = []
    step = SLICE - length + 1
    for begin in range(0, max(len(data) - length + 1, 0), step):
        piece = data[begin : begin + SLICE]
        digest = gram_digests(piece, gram)
        low = U((1 << PLACE_BITS) - 1)
        keyed = (digest & ~low) | np.arange(len(digest), dtype=U)
        at = (sliding_minimum(keyed, length - gram + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        out.append((digest[at[first]], at[first] + begin, first + begin, last + begin))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(U), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class ByteStrings:
    """Byte strings of one length that start anywhere else."""

    chunk = 1 << 20

    def __init__(self, length: int = LENGTH, gram: int = GRAM) -> None:
        if length < gram:
            raise ValueError("a string must hold a gram")
        self.length, self.gram = length, gram

    def anchors(self, texts: list[bytes]) -> Found:
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        base = np.cumsum(sizes) - sizes
        data = b"".join(texts)
        each = []
        for i, (b, n) in enumerate(zip(base, sizes, strict=True)):
            name, at, first, last = anchors_of(np.frombuffer(data, np.uint8, n, b), self.length, self.gram)
            each.append((name, np.full(len(name), i), at + b, first + b, last + b))
        return Found(data, base, *(np.concatenate(x) for x in zip(*each, strict=True)))

    def questions(
        self, numbers: np.ndarray, keys: np.ndarray, found: Found, wanted: np.ndarray, parts: int
    ) -> Iterator[tuple]:
        known: dict[tuple[bytes, int], int] = {}
        kept: list[int] = []
        twice: list[int] = []
        for i in np.flatnonzero(wanted).tolist():
            first, last = int(found.first[i]), int(found.last[i]) + self.length
            stretch = (found.data[first:last], int(found.at[i]) - first)
            other = known.setdefault(stretch, i)
            if other == i:
                kept.append(i)
            else:
                twice += [i, other]
        if twice:
            all_ = np.unique(np.array(twice))
            doc = found.doc[all_]
            start = found.first[all_] - found.base[doc]
            stop = found.last[all_] + self.length - found.base[doc]
            yield 0, ANSWERED, (numbers[doc], start, stop)
        which = np.array(kept, dtype=np.int64)
        part = (mix(found.name[which]) % U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            here = which[order[cuts[p] : cuts[p + 1]]]
            if len(here):
                first, stop = found.first[here], found.last[here] + self.length
                text = b"".join([found.data[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)])
                yield p, ASKED, (
                    numbers[found.doc[here]], found.name[here], first - found.base[found.doc[here]],
                    (found.at[here] - first).astype(np.uint16), (stop - first).astype(np.uint16), text,
                )

    def answer(self, asked: list[tuple]) -> Iterator[tuple]:
        if not asked:
            return
        name, left, size = (np.concatenate([d[i] for _, d in asked]) for i in (1, 3, 4))
        stretch, place = repeated_strings(name, left, size, b"".join(d[5] for _, d in asked), self.length)
        order = np.argsort(stretch, kind="stable")
        stretch, place = stretch[order], place[order]
        at = 0
        for grp, (doc, _, first, *_) in asked:
            a, b = np.searchsorted(stretch, [at, at + len(doc)])
            mine = stretch[a:b] - at
            at += len(doc)
            if b > a:
                begin = first[mine] + place[a:b]
                yield grp, spans_of(doc[mine], begin, self.length)

    def removed(self, text: bytes, start: np.ndarray, stop: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        if rows > 1 and len(text) >= self.length:
            return np.array([0]), np.array([len(text)])
        return merged(start, stop)

    def result(self, doc_id: int | None, text: bytes, start: np.ndarray, stop: np.ndarray, rows: int) -> tuple:
        digest, at, gone = hashlib.sha256(), 0, 0
        spans = list(zip(*(x.tolist() for x in self.removed(text, start, stop, rows)), strict=True))
        for a, b in spans:
            digest.update(text[at:a])
            at, gone = b, gone + b - a
        digest.update(text[at:])
        return doc_id, len(text), gone, len(spans), digest.hexdigest()


def _range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first..last] for each pair."""
    span = last - first + 1
    out = values[first]
    reach = 1
    table = values
    level = np.zeros(len(span), dtype=np.int64)
    if len(span):
        level = np.frexp(span)[1] - 1
    for k in range(int(level.max(initial=0)) + 1):
        here = np.flatnonzero(level == k)
        if len(here):
            out[here] = np.minimum(table[first[here]], table[last[here] - reach + 1])
        if len(table) > reach:
            table = np.minimum(table[:-reach], table[reach:])
        reach *= 2
    return out


def repeated_strings(
    name: np.ndarray, left: np.ndarray, size: np.ndarray, text: bytes, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, place in it) of each string that starts in two stretches.

    Stretches of one name are compared, at equal distance from their anchors.
    """
    none = np.zeros(0, dtype=np.int64)
    _, group, count = np.unique(name, return_inverse=True, return_counts=True)
    start = np.cumsum(size.astype(np.int64)) - size
    mine = np.flatnonzero(count[group] > 1)
    if not len(mine):
        return none, none
    mine = mine[np.argsort(group[mine], kind="stable")]
    group, left, size, start = group[mine], left[mine].astype(np.int64), size[mine].astype(np.int64), start[mine]
    data = np.frombuffer(text, np.uint8)
    leftmost, rightmost = int(left.max()), int((size - left).max())
    joins = np.argsort(-(size - left), kind="stable")  # in the order in which they join
    ends = -(size - left)[joins]
    order, prefix, joined_ = none, none, 0
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(rightmost - 1, -leftmost - 1, -1):
        # A column of the collection, read from the text that the task holds.
        inside = (c < size - left) & (c >= -left)
        column = np.where(inside, data[np.where(inside, start + left + c, 0)], 0).astype(np.uint8)
        # Those that end here join with an empty suffix, the smallest of their group.
        until = int(np.searchsorted(ends, -(c + 1), side="right"))
        if until > joined_:
            new = np.sort(joins[joined_:until])
            joined_ = until
            both = np.r_[new, order]
            sorting = np.argsort(group[both], kind="stable")
            was_new = np.r_[np.ones(len(new), dtype=bool), np.zeros(len(order), dtype=bool)][sorting]
            prefix = np.r_[np.zeros(len(new), dtype=np.int64), prefix][sorting]
            prefix[np.r_[False, was_new[:-1]]] = 0
            order = both[sorting]
        # Those that began one column to the right leave; their neighbours' prefix is the smaller one.
        stay = c >= -left[order]
        if not stay.all():
            at = np.flatnonzero(stay)
            before = np.r_[-1, at[:-1]]
            prefix = _range_minima(prefix, before + 1, at) if len(at) else none
            order = order[at]
        if not len(order):
            continue
        key = group[order] * 256 + column[order]
        place = np.argsort(key, kind="stable")
        key = key[place]
        fresh = np.zeros(len(order), dtype=np.int64)
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        fresh[same] = _range_minima(prefix, place[same - 1] + 1, place[same]) + 1
        order, prefix = order[place], fresh
        long = prefix >= length
        if long.any():
            hit = order[long | np.r_[long[1:], False]]
            found.append((mine[hit], c + left[hit]))
    if not found:
        return none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Counts and digest of what is left of each document."""
    return find_repeats(docs, ByteStrings(length), DDL, SCHEMA)


class KeptText(ByteStrings):
    """What is left of a text. A character that loses one of its bytes goes as a whole."""

    def result(self, doc_id: int | None, text: bytes, start: np.ndarray, stop: np.ndarray, rows: int) -> tuple:
        start, stop = self.removed(text, start, stop, rows)
        at, kept = 0, []
        for a, b in zip(start.tolist(), stop.tolist(), strict=True):
            kept.append(text[at:a])
            at = b
        left = b"".join(k.decode("utf-8", "ignore").encode() for k in [*kept, text[at:]]).decode()
        return doc_id, left, len(left)


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents without their repeated strings; ``n_chars`` is that of the new text."""
    kept = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64())])
    found = find_repeats(docs, KeptText(length), "doc_id bigint, text string, n_chars bigint", schema, carried=kept)
    names = {c: f"c{i}" for i, c in enumerate(kept)}
    return found.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
