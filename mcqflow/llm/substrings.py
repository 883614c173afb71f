"""Substring dedup by recompression.

Words become names; rounds then name runs of equal names and pairs of neighbours, the same
way in every text: which neighbours make a pair depends on their own names only. So equal
passages get equal symbols inside, and only at their ends may symbols differ. For each
symbol the words that decide it, its context, are known. A window of words picks the highest
symbol whose context lies in it, the leftmost one; equal windows pick equal symbols at equal
places. Names are 64-bit digests of what they stand for, so all tasks agree on them.

The names picked anywhere are asked for first (``repeats``). Windows around a name that
stands only once can't repeat. The windows of the others are compared by a 96-bit digest,
and all but the first of each are removed, with the words they cover.

Words are runs of anything but ASCII white space. A null text is empty, has no words and
keeps the digest of the empty string. A text with fewer words than a window keeps them all.
"Earlier" is by doc_id (null last; texts that share an id by the hash of the text), then by
place. An empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mcqflow.llm.repeats import ANSWERED, ASKED, find_repeats, merged, numbered, spans_of
from mcqflow.llm.words import U, joined, mix, stretches, words_of_texts

WINDOW = 20
ROUNDS = 7

DDL = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


@dataclass
class Symbols:
    """One round's symbols in text order: words [start, stop) decided by words [low, high)."""

    name: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    low: np.ndarray
    high: np.ndarray


def name_runs(words: np.ndarray, doc: np.ndarray) -> Symbols:
    """Runs of one word become one symbol; a run is decided by one word more on both sides."""
    n = len(words)
    new = np.ones(n, dtype=bool)
    new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    stop = np.r_[start[1:], n]
    name, times = words[start], (stop - start).astype(U)
    return Symbols(np.where(times > 1, joined(name, times), name), doc[start], start, stop, start - 1, stop + 1)


def name_pairs(s: Symbols, salt: int, longest: int) -> Symbols:
    """Neighbours (left, right) become one symbol; a bit of its name makes a symbol left or right.

    A left symbol never ends a pair and a right one never begins one, so pairs don't overlap.
    The open side of a symbol is decided by its neighbour too.
    """
    left = (mix(s.name + U(salt * 0x1000193)) >> U(63)).astype(bool)
    same = s.doc[1:] == s.doc[:-1]
    size = s.stop - s.start
    pair = left[:-1] & ~left[1:] & same & (size[:-1] + size[1:] <= longest)
    begins, ends = np.r_[pair, False], np.r_[False, pair]
    first = np.flatnonzero(~ends)
    last = first + begins[first]
    before = np.r_[s.start[:1] - 1, np.where(same, s.low[:-1], s.start[1:] - 1)]
    after = np.r_[np.where(same, s.high[1:], s.stop[:-1] + 1), s.stop[-1:] + 1]
    low = np.where(left, s.low, np.minimum(s.low, before))
    high = np.where(left, np.maximum(s.high, after), s.high)
    name = np.where(begins[first], joined(s.name[first], s.name[last]), s.name[first])
    return Symbols(name, s.doc[first], s.start[first], s.stop[last], low[first], high[last])


def recompress(words: np.ndarray, doc: np.ndarray, longest: int, rounds: int = ROUNDS) -> list[Symbols]:
    """The words themselves, then the symbols of each round."""
    place = np.arange(len(words))
    out = [Symbols(words, doc, place, place + 1, place, place + 1), name_runs(words, doc)]
    for salt in range(1, rounds + 1):
        out.append(name_pairs(out[-1], salt, longest))
    return out


def picks(levels: list[Symbols], doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window start: whether there is a window, the name it picks, and which symbol that is."""
    n = len(doc)
    count = max(0, n - window + 1)
    is_window = doc[:count] == doc[n - count :]
    name, symbol = np.zeros(count, dtype=U), np.full(count, -1, dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        s = levels[level]
        # The windows of which a symbol is the leftmost that fits: runs that don't overlap.
        low = np.maximum(np.maximum(s.high - window, np.r_[-1, s.low[:-1]] + 1), 0)
        times = np.maximum(np.minimum(s.low, count - 1) - low + 1, 0)
        total = int(times.sum())
        at = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(total)
        which = np.repeat(np.arange(len(s.name)), times)
        free = (symbol[at] < 0) & is_window[at]
        at, which = at[free], which[free]
        name[at] = s.name[which]
        symbol[at] = which * 16 + level
        if level and (symbol[is_window] >= 0).all():
            break
    return is_window, name, symbol


def window_digests(words: np.ndarray, window: int, seed: int) -> np.ndarray:
    """A digest of each window of words."""
    start = np.arange(max(0, len(words) - window + 1))
    return stretches(words, start, start + window, seed)


@dataclass
class Found:
    """A chunk's words, windows and anchors."""

    words: np.ndarray
    place: np.ndarray  # of the chunk's words in their documents
    owner: np.ndarray
    anchor: np.ndarray  # of each window start, -1 where there is no window
    name: np.ndarray
    doc: np.ndarray


class WordWindows:
    """Windows of words that also start earlier."""

    chunk = 2 << 20

    def __init__(self, window: int = WINDOW, rounds: int = ROUNDS) -> None:
        self.window, self.rounds = window, rounds

    def anchors(self, texts: list[bytes]) -> Found:
        words, cuts = words_of_texts(texts)
        sizes = np.diff(cuts)
        doc = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(words)) - np.repeat(cuts[:-1], sizes)
        none = np.zeros(0, dtype=np.int64)
        if len(words) < self.window:
            return Found(words, place, doc, none, none.astype(U), none)
        levels = recompress(words, doc, self.window // 2, self.rounds)
        is_window, name, symbol = picks(levels, doc, self.window)
        start = np.flatnonzero(is_window)
        new = np.r_[True, symbol[start[1:]] != symbol[start[:-1]]] if len(start) else np.zeros(0, dtype=bool)
        anchor = np.full(len(is_window), -1, dtype=np.int64)
        anchor[start] = np.cumsum(new) - 1
        first = start[new]
        # A symbol is asked for with its whole context, which is in each of its windows.
        context = np.array([symbol[first] % 16, symbol[first] // 16])
        low, high = (np.zeros(len(first), dtype=np.int64) for _ in range(2))
        for level in np.unique(context[0]).tolist():
            mine = context[0] == level
            low[mine], high[mine] = levels[level].low[context[1][mine]], levels[level].high[context[1][mine]]
        return Found(words, place, doc, anchor, joined(name[first], stretches(words, low, high)), doc[first])

    def questions(
        self, numbers: np.ndarray, keys: np.ndarray, found: Found, wanted: np.ndarray, parts: int
    ) -> Iterator[tuple]:
        if not wanted.any():
            return
        start = np.flatnonzero((found.anchor >= 0) & np.r_[wanted, False][found.anchor])
        high = window_digests(found.words, self.window, 1)[start]
        low = window_digests(found.words, self.window, 2)[start].astype(np.uint32)
        # In order of digest, document and place; numbers follow the order of the keys.
        doc = found.owner[start]
        order = np.lexsort((found.place[start], numbers[doc], low, high))
        start, high, low, doc = start[order], high[order], low[order], doc[order].astype(np.int32)
        place = found.place[start].astype(np.int64)
        first = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]
        later = ~first
        if later.any():
            yield 0, ANSWERED, spans_of(numbers[doc[later]], place[later], self.window)
        high, low, doc, place = high[first], low[first], doc[first], place[first]
        part = (mix(high) % U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            here = order[cuts[p] : cuts[p + 1]]
            if len(here):
                used, local = numbered(doc[here])
                yield p, ASKED, (keys[used], numbers[used], local, high[here], low[here], place[here].astype(np.uint32))

    def answer(self, asked: list[tuple]) -> Iterator[tuple]:
        if not asked:
            return
        high, low, place = (np.concatenate([d[i] for _, d in asked]) for i in (3, 4, 5))
        key = np.concatenate([d[0][d[2]] for _, d in asked])
        order = np.lexsort((place, key[:, 1], key[:, 0], low, high))
        later = np.zeros(len(order), dtype=bool)
        a, b = order[1:], order[:-1]
        later[a] = (high[a] == high[b]) & (low[a] == low[b])
        at = 0
        for grp, (_, numbers, doc, _, _, start) in asked:
            here = later[at : at + len(doc)]
            at += len(doc)
            if here.any():
                yield grp, spans_of(numbers[doc[here]], start[here].astype(np.int64), self.window)

    def result(self, doc_id: int | None, text: bytes, start: np.ndarray, stop: np.ndarray, rows: int) -> tuple:
        words = text.split()
        keep = np.ones(len(words), dtype=bool)
        for a, b in zip(*merged(start, stop), strict=True):
            keep[a:b] = False
        kept = b" ".join(compress(words, keep.tolist()))
        return doc_id, len(words), int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest()


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """What is left of each document when its repeated windows are gone."""
    return find_repeats(docs, WordWindows(window), DDL, SCHEMA)
