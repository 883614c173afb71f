"""Packing: documents into windows by the sum-of-squares rule.

A task packs the documents of its partition as they come. Whole windows are cut off a long
document; what is left of it goes to the fill level at which the sum of the squared numbers
of partly filled windows grows least, tracked in an array with a count for each level. When
the documents end, the open windows are filled up with pieces cut off the emptiest ones, and
the last one is cut into runs whose lengths are powers of two. So no sequence is padded.

Nothing is exchanged: a task holds its open windows only, and a sequence's id is made of its
partition and its number there. A null text is empty; every document ends with the end id,
so an empty one has one id. Repeated rows are documents of their own, null ids stay null,
extra columns are ignored, an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from mcqflow.llm.common import text_of

WINDOW = 2048
END_ID = 1
KNOWN_WORDS = 1_000_000
TEXTS, TEXT_BYTES = 4000, 4 << 20  # encoded at a time, or one longer text

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
    " sequence_id bigint, offset bigint"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# How the tokenizer cuts a lower-case text into words, and texts for which that
# isn't surely the same here: special tokens, controls, and letters with irregular lower case.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_UNSURE = re.compile("<\\||[\u03a3\u0130\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f\u180e\u200b-\u200f\u2028\u2029\ufeff]")


# The same over ASCII, the Latin letters up to U+017F and common punctuation, for the quicker matcher:
# none of these characters is a number, a space or a mark, and composing leaves them as they are.
_FAR = re.compile("[^\x00-\x7f\xa1\xab\xbb\xbf\xc0-\xd6\xd8-\xf6\xf8-\u017f\u2010-\u2027]")
_NEAR_WORD = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xc0-\xd6\xd8-\xf6\xf8-\u017f]+|[0-9]|[^\\sa-z0-9\xc0-\xd6\xd8-\xf6\xf8-\u017f]+"
)


class WordIds:
    """Ids of texts as little-endian 32-bit bytes, by the ids of their words.

    For lower-casing BPE with an end mark on the last token of each word. Words are encoded
    once and kept; a text in which words might be found otherwise is encoded as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        self.mark = model.get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(self.mark) and token.endswith(self.mark)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of single words, many at a time."""
        out: dict[str, bytes] = {}
        groups = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        for group, ids in zip(groups, self.encode([" ".join(g) for g in groups]), strict=True):
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            raw = ids.tobytes()
            if len(stops) == len(group):
                out.update((w, raw[a:b]) for w, a, b in zip(group, [0, *stops.tolist()], stops.tolist(), strict=False))
            else:
                out.update((w, i.tobytes()) for w, i in zip(group, self.encode(group), strict=True))
        return out

    def words(self, text: str) -> list[str] | None:
        if not self.mark or _UNSURE.search(text):
            return None
        if not _FAR.search(text):
            return _NEAR_WORD.findall(text.lower())
        return _WORD.findall(unicodedata.normalize("NFC", text).lower())

    def texts(self, texts: list[str]) -> list[bytes]:
        cut = [self.words(t) for t in texts]
        whole = [i for i, words in enumerate(cut) if words is None]
        out = dict(zip(whole, (e.tobytes() for e in self.encode([texts[i] for i in whole])), strict=True))
        # Each different word of these texts is looked up once; its ids are laid out by offsets.
        coded = pa.array([w for words in cut if words for w in words], pa.string()).dictionary_encode()
        every = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        missing = [w for w in every if w not in self.known]
        if len(self.known) + len(missing) > KNOWN_WORDS:
            missing, self.known = every, {}
        self.known.update(self.learn(missing))
        found = [self.known[w] for w in every]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        index = coded.indices.to_numpy()
        taken = sizes[index]
        ends = np.concatenate([[0], np.cumsum(taken)])
        starts = np.repeat((np.cumsum(sizes) - sizes)[index] - ends[:-1], taken)
        ids = np.frombuffer(b"".join(found), dtype="<u4")[starts + np.arange(ends[-1])]
        stops = np.cumsum([0 if words is None else len(words) for words in cut])
        last = ends[stops]
        first = np.concatenate([[0], last[:-1]])
        return [out[i] if i in out else ids[a:b].tobytes() for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True))]


@dataclass
class Piece:
    doc: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """The first n ids and the rest."""
        head, tail = self.ids[: 4 * n], self.ids[4 * n :]
        return Piece(self.doc, self.start, head, self.doc_tokens), Piece(self.doc, self.start + n, tail, self.doc_tokens)

    def __len__(self) -> int:
        return len(self.ids) // 4


class Packer:
    """Open windows by fill level."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def level_for(self, size: int) -> int:
        """The level where a piece of the size adds least to the sum of squares; 0: a new window."""
        from_, to = self.levels[: self.window - size + 1], self.levels[size:]
        growth = 2 * (to - from_) + 2
        growth[0] -= 1  # an empty window isn't counted
        growth[-1] -= 1  # nor is a full one
        growth[1:][from_[1:] == 0] = np.iinfo(np.int64).max
        return int(len(growth) - 1 - np.argmin(growth[::-1]))  # of equal ones the fullest

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Put a piece in; yields the windows that are full now."""
        while len(piece) >= self.window:
            head, piece = piece.cut(self.window)
            yield [head]
        if not len(piece):
            return
        level = self.level_for(len(piece))
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
        pieces.append(piece)
        level += len(piece)
        if level == self.window:
            yield pieces
        else:
            self.open.setdefault(level, []).append(pieces)
            self.levels[level] += 1

    def finish(self) -> Iterator[list[Piece]]:
        """The open windows, filled up with pieces of the emptiest; the last in powers of two."""
        left = deque(w for level in sorted(self.open) for w in self.open[level])
        while len(left) > 1:
            full = left.pop()
            gap = self.window - sum(map(len, full))
            while gap and left:
                piece = left[0].pop()
                if len(piece) > gap:
                    piece, rest = piece.cut(gap)
                    left[0].append(rest)
                elif not left[0]:
                    left.popleft()
                full.append(piece)
                gap -= len(piece)
            if gap:
                left.append(full)
            else:
                yield full
        for pieces in left:
            total = sum(map(len, pieces))
            while total:
                size = 1 << (total.bit_length() - 1)
                total -= size
                sequence = []
                while size:
                    piece = pieces.pop(0)
                    if len(piece) > size:
                        piece, rest = piece.cut(size)
                        pieces.insert(0, rest)
                    size -= len(piece)
                    sequence.append(piece)
                yield sequence


def _pack(batches: Iterator[pa.RecordBatch], path: str, window: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    words, packer, base = WordIds(path), Packer(window), TaskContext.get().partitionId() << 40
    end = np.asarray([END_ID], dtype="<u4").tobytes()
    sequences = 0

    def rows(full: Iterator[list[Piece]]) -> Iterator[tuple]:
        nonlocal sequences
        for pieces in full:
            offset = 0
            for p in pieces:
                row = (p.doc, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, base + sequences, offset)
                yield (*row, p.ids) if with_ids else row
                offset += len(p)
            sequences += 1

    def batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
        names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
        columns = zip(*found, strict=True) if found else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for b in batches:
        sizes, at = pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64), 0
        while at < b.num_rows:
            fits = int(np.searchsorted(np.cumsum(sizes[at : at + TEXTS]), TEXT_BYTES, side="right"))
            few = b.slice(at, max(1, fits))
            at += few.num_rows
            found: list[tuple] = []
            for doc, ids in zip(few.column("doc_id").to_pylist(), words.texts(few.column("text").to_pylist()), strict=True):
                ids += end
                found.extend(rows(packer.add(Piece(doc, 0, ids, len(ids) // 4))))
            yield batch(found)
    yield batch(list(rows(packer.finish())))


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document; ``with_ids`` adds its ids as little-endian bytes."""
    path = tokenizer or default_tokenizer()
    work = functools.partial(_pack, path=path, window=window, with_ids=with_ids)
    read = docs.select("doc_id", text_of("text").alias("text"))
    return read.mapInArrow(work, SCHEMA + ", ids binary" * with_ids)
