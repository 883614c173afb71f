"""Finding repeats across documents in two questions, shared by the repeat operators.

Texts are dealt to even groups once; Spark reuses that exchange for every step. A step runs
over one group of texts, in chunks, and asks: it sends packed arrays to a part chosen by the
hash of what is asked for. A part answers each sender. What a chunk can answer itself goes
with the question and comes back as it is, so that a name or string that a third of all
texts share is sent once by each chunk and not once by each text.

1. names: which anchors' names stand at two places or more?
2. strings: what exactly repeats around those anchors?

Texts that share a doc_id are different documents if the texts differ (in the order of their
hashes); rows with equal id and text are one document, and each row gets its result. Null
ids come after all others.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mcqflow.llm.common import text_of
from mcqflow.llm.words import mix

ASK = "part int, grp int, kind int, data binary"
ASKED, ANSWERED = 0, 1
_ASK = pa.schema([("part", pa.int32()), ("grp", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])

NULL_ID = 2**63 - 1  # stands for a null id


def groups_for(df: DataFrame) -> int:
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(docs: DataFrame, groups: int, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, text, its hash, the group of each row, and the carried columns as c0, c1, ..."""
    more = [F.col(c).alias(f"c{i}") for i, c in enumerate(carried)]
    read = docs.select("doc_id", text_of("text").alias("text"), *more).withColumn("hash", F.xxhash64("text"))
    return read.withColumn("grp", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(groups)).cast("int"))


class Group:
    """The documents of a group of rows, numbered in the order of id and hash, whatever the order of the rows."""

    def __init__(self, table: pa.Table) -> None:
        ids = table.column("doc_id").to_pylist()
        self.ids = ids
        keys = np.array([(NULL_ID if i is None else i) for i in ids], dtype=np.int64)
        hashes = np.array(table.column("hash").to_pylist(), dtype=np.int64)
        order = np.lexsort((hashes, keys))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
        self.number = np.empty(len(order), dtype=np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.key = np.stack([keys[order][new], hashes[order][new]], axis=1) if len(order) else np.zeros((0, 2), np.int64)
        self.first = order[new]  # a row of each document
        self.texts = table.column("text").combine_chunks() if len(ids) else []
        self.grp = table.column("grp")[0].as_py() if len(ids) else 0

    def text(self, row: int) -> bytes:
        return self.texts[row].as_py().encode()

    def chunks(self, most: int, numbers: Iterable[int]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """Numbers and texts, up to so many bytes or one text at a time."""
        held, texts, mine = 0, [], []
        for number in numbers:
            text = self.text(self.first[number])
            if texts and held + len(text) > most:
                yield np.array(mine, dtype=np.int32), texts
                held, texts, mine = 0, [], []
            mine.append(number)
            texts.append(text)
            held += len(text)
        if texts:
            yield np.array(mine, dtype=np.int32), texts


def packed(rows: list[tuple[int, int, int, Any]]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    part, grp, kind, data = (list(c) for c in columns)
    arrays = [part, grp, kind, [pickle.dumps(d, protocol=5) for d in data]]
    return pa.table([pa.array(a, f.type) for a, f in zip(arrays, _ASK, strict=True)], schema=_ASK)


def unpacked(table: pa.Table) -> Iterator[tuple[int, int, int, Any]]:
    for part, grp, kind, data in zip(*(table.column(c) for c in ("part", "grp", "kind", "data")), strict=True):
        yield part.as_py(), grp.as_py(), kind.as_py(), pickle.loads(data.as_py())


class Finder(Protocol):
    """What a repeat operator brings: how to cut texts and what to compare."""

    chunk: int

    def anchors(self, texts: list[bytes]) -> Any:
        """For the chunk: arrays ``name`` and ``doc`` (its number in the chunk) of each anchor, and more."""

    def questions(
        self, numbers: np.ndarray, keys: np.ndarray, found: Any, wanted: np.ndarray, parts: int
    ) -> Iterator[tuple[int, int, Any]]:
        """(part, kind, data) about the wanted anchors of a chunk, whose documents have these numbers and
        keys (id, hash); answered data is (number, start, stop)."""

    def answer(self, asked: list[tuple[int, Any]]) -> Iterator[tuple[int, Any]]:
        """(group, (number, start, stop)) for the questions of one part."""

    def result(self, doc_id: int | None, text: bytes, start: np.ndarray, stop: np.ndarray, rows: int) -> tuple:
        """The output row of a text, given what repeats and how many rows hold this id and text."""


def short(names: np.ndarray) -> np.ndarray:
    """Five bytes of each name; with the part, which the rest of it chose, that tells names apart.
    Names taken for one by mistake only make a question more."""
    return np.ascontiguousarray(np.ascontiguousarray(names).view(np.uint8).reshape(-1, 8)[:, :5])


def long(names: np.ndarray) -> np.ndarray:
    out = np.zeros((len(names), 8), dtype=np.uint8)
    out[:, :5] = names
    return out.view(np.uint64).ravel()


def numbered(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers, and the index among them of each; a short form of the array."""
    used, local = np.unique(numbers, return_inverse=True)
    return used, local.astype(np.uint16 if len(used) < 2**16 else np.uint32)


def spans_of(number: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, start and stop of the runs that stretches of a length make in each document."""
    far = number.astype(np.int64) << 40
    low, high = merged(far + start, far + start + length)
    owner = low >> 40
    return owner.astype(np.int32), low - (owner << 40), high - (owner << 40)


def _parts(names: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the names by part, and where each part starts."""
    part = (mix(names) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _ask_names(table: pa.Table, finder: Finder, parts: int) -> pa.Table:
    """For each chunk: its distinct names, and the answer for those it holds twice."""
    rows, group = [], Group(table)
    grp = group.grp
    for numbers, texts in group.chunks(finder.chunk, range(len(group.first))):
        found = finder.anchors(texts)
        owner = numbers[found.doc]
        name, first, inverse, count = np.unique(
            found.name, return_index=True, return_inverse=True, return_counts=True
        )
        twice = count > 1
        known = twice[inverse]
        if known.any():
            rows.append((grp % parts, grp, ANSWERED, (*numbered(owner[known]), short(found.name[known]))))
        order, cuts = _parts(name, parts)
        for p in range(parts):
            here = order[cuts[p] : cuts[p + 1]]
            if len(here):
                rows.append((p, grp, ASKED, (*numbered(owner[first[here]]), short(name[here]), np.packbits(twice[here]))))
    return packed(rows)


def _answer_names(table: pa.Table) -> pa.Table:
    """Names that two chunks hold, or one of them twice, to every chunk that asked for them."""
    rows, asked = [], []
    for part, grp, kind, data in unpacked(table):
        if kind == ANSWERED:
            rows.append((part, grp, kind, data))
        else:
            asked.append((grp, data))
    if asked:
        names = long(np.concatenate([d[2] for _, d in asked]))
        twice = np.concatenate([np.unpackbits(d[3], count=len(d[2])) for _, d in asked]).astype(bool)
        _, inverse, count = np.unique(names, return_inverse=True, return_counts=True)
        flagged = np.zeros(len(count), dtype=bool)
        flagged[inverse[twice]] = True
        wanted = ((count > 1) | flagged)[inverse] & ~twice
        at = 0
        for grp, (numbers, local, name, _) in asked:
            here = wanted[at : at + len(name)]
            at += len(name)
            if here.any():
                rows.append((0, grp, ANSWERED, (*numbered(numbers[local[here]]), name[here])))
    return packed(rows)


def _by_doc(doc: np.ndarray, *values: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """The values of each document, by its number."""
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else np.zeros(1, dtype=np.int64)
    values = tuple(v[order] for v in values)
    return {int(doc[a]): tuple(v[a:b] for v in values) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}


def _ask_strings(texts: pa.Table, names: pa.Table, finder: Finder, parts: int) -> pa.Table:
    rows, group = [], Group(texts)
    told = [data for *_, data in unpacked(names)]
    if not told:
        return packed(rows)
    doc, name = np.concatenate([d[0][d[1]] for d in told]), long(np.concatenate([d[2] for d in told]))
    wanted = {k: v[0] for k, v in _by_doc(doc, name).items()}
    golden = np.uint64(0x9E3779B97F4A7C15)
    for numbers, chunk in group.chunks(finder.chunk, sorted(wanted)):
        found = finder.anchors(chunk)
        # Pairs (document, name) that are wanted.
        asked = [wanted[k] for k in numbers.tolist()]
        doc = np.repeat(np.arange(len(numbers)), [len(a) for a in asked]).astype(np.uint64)
        pairs = mix(np.concatenate(asked) + doc * golden)
        here = mix(long(short(found.name)) + found.doc.astype(np.uint64) * golden)
        for part, kind, data in finder.questions(numbers, group.key[numbers], found, np.isin(here, pairs), parts):
            rows.append((part if kind == ASKED else group.grp % parts, group.grp, kind, data))
    return packed(rows)


def _answer_strings(table: pa.Table, finder: Finder) -> pa.Table:
    rows, asked = [], []
    for part, grp, kind, data in unpacked(table):
        if kind == ANSWERED:
            rows.append((part, grp, kind, data))
        else:
            asked.append((grp, data))
    rows.extend((0, grp, ANSWERED, data) for grp, data in finder.answer(asked))
    return packed(rows)


def _results(texts: pa.Table, answers: pa.Table, finder: Finder, schema: pa.Schema) -> pa.Table:
    group, none = Group(texts), (np.zeros(0, dtype=np.int64),) * 2
    told = [data for *_, data in unpacked(answers)]
    spans = _by_doc(*(np.concatenate([d[i] for d in told]) for i in range(3))) if told else {}
    times = np.bincount(group.number) if len(group.number) else []
    rows = [
        finder.result(group.ids[i], group.text(i), *spans.get(int(n), none), int(times[n]))
        for i, n in enumerate(group.number)
    ]
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    carried = [c for c in texts.column_names if c[0] == "c"]
    return pa.table([*arrays, *(texts.column(c) for c in carried)], names=[*schema.names, *carried])


def find_repeats(
    docs: DataFrame, finder: Finder, ddl: str, schema: pa.Schema, groups: int | None = None, carried: Sequence[str] = ()
) -> DataFrame:
    """``finder.result`` of every row of ``docs``, and its carried columns as c0, c1, ..."""
    n = groups or groups_for(docs)
    texts = dealt(docs, n, carried)
    ddl = ", ".join([ddl, *(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carried))])

    by_group = texts.groupBy("grp")
    asked = by_group.applyInArrow(lambda t: _ask_names(t, finder, n), ASK)
    names = asked.groupBy("part").applyInArrow(_answer_names, ASK)
    more = by_group.cogroup(names.groupBy("grp")).applyInArrow(lambda t, a: _ask_strings(t, a, finder, n), ASK)
    strings = more.groupBy("part").applyInArrow(lambda t: _answer_strings(t, finder), ASK)
    return by_group.cogroup(strings.groupBy("grp")).applyInArrow(lambda t, a: _results(t, a, finder, schema), ddl)


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open runs, as sorted runs that don't touch."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.r_[True, start[1:] > reach[:-1]]
    return start[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]]
