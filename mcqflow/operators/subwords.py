"""Subword vocabularies: pair merges trained on word counts, and a codec that applies them.

A text is cut into pieces that leave nothing out, and a piece into its UTF-8 bytes, so every
text can be encoded and comes back unchanged. A symbol is written as one character: a byte as
the character of its number, a merged pair as the next free one. A piece is then a string, a
pair two characters of it, and merging a pair everywhere one ``replace``.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mcqflow.functions.tokens import drop_special, truncate
from mcqflow.operators.slices import slicer
from mcqflow.operators.vocabulary import MAX_INLINE_TOKENS, _constant, pieces
from mcqflow.sources.shared import shared_folder
from mcqflow.sources.sinks import write_prepared

BYTE_IDS = 256
# Words, numbers and runs of other signs with the blank before them, and other white space.
# Every character is in one of them. The blank is looked at once, and a run never given back.
SUBWORD_PIECE = r" ?+(?:\p{L}++|\p{N}++|[^\x09-\x0D\x20\p{L}\p{N}]++)|[\x09-\x0D\x20]++"

# Characters 0xD800 to 0xDFFF stand for nothing by themselves, so ids step over them.
_GAP, _GAP_SIZE = 0xD800, 0x800

CANDIDATES = 256  # most frequent pairs looked at in a round
MAX_KNOWN_PIECES = 250_000  # whose ids a task remembers, twice
MAX_KNOWN_CHARS = 100  # of such a piece
MAX_SLICE_PIECES = 1 << 17  # merged at a time, of a megabyte at most
REWRITE = 32  # merges after which the words are written anew


def symbol(i: int) -> str:
    """The character that stands for an id."""
    return chr(i if i < _GAP else i + _GAP_SIZE)


def symbol_id(char: str) -> int:
    code = ord(char)
    return code if code < _GAP else code - _GAP_SIZE


def byte_symbols(piece: Column) -> Column:
    """The bytes of a piece, a character each."""
    return F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1")


def adjacent(word: Column) -> Column:
    """The pairs of neighbours in a word, as strings of two characters."""
    n = F.char_length(word)
    none = F.array().cast("array<string>")
    return F.when(n < 2, none).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(word, i, 2)))


def _merges(merges: list[tuple[str, str]]) -> Column:
    """A constant; the generated code is the same whatever it holds."""
    return F.array(*(F.struct(F.lit(pair).alias("pair"), F.lit(new).alias("new")) for pair, new in merges))


def merged(word: Column, merges: list[tuple[str, str]]) -> Column:
    """The word after each pair, in order, became its symbol."""
    if not merges:
        return word
    return F.aggregate(_merges(merges), word, lambda w, m: F.replace(w, m["pair"], m["new"]))


def spelled(pair: str, merges: list[tuple[str, str]]) -> str:
    """The symbols that became a pair, as they stood before the merges."""
    for old, new in reversed(merges):
        pair = pair.replace(new, old)
    return pair


def word_counts(df: DataFrame, text: str, pattern: str = SUBWORD_PIECE) -> DataFrame:
    """``(word, n)``: the different pieces as byte symbols, and how often each occurs."""
    found = df.select(F.explode(pieces(F.col(text), pattern)).alias("piece"))
    return found.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).select(byte_symbols(F.col("piece")).alias("word"), "n")


def _pair_counts(words: DataFrame) -> DataFrame:
    return words.select(F.explode(adjacent(F.col("word"))).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))


def _ranked(pairs: DataFrame) -> list:
    """The most frequent pairs. Of equally frequent ones those of older symbols come first."""
    left, right = F.substring("pair", 1, 1), F.substring("pair", 2, 1)
    order = [F.desc("n"), F.greatest(left, right), left, right]
    return pairs.orderBy(*order).limit(CANDIDATES).collect()


def independent(ranked: list, room: int, min_count: int) -> list:
    """The first pairs of a ranking that can be merged at once: no symbol is the left one of a
    pair and the right one of another.

    Then no two of their occurrences overlap, so merging one leaves the counts of the others as
    they are. A pair with a new symbol occurs at most as often as the old pair at its seam;
    that one begins with a right symbol or ends with a left one, so it was not merged and
    ranks below all of these; with equal counts, older symbols go first. A symbol merged with
    itself can be at its own seam, so it is the last of a round.
    """
    out, left, right = [], set(), set()
    for row in ranked[:room]:
        a, b = row.pair
        if row.n < min_count or a in right or b in left or (a == b and a in left | right):
            break
        out.append(row)
        left.add(a)
        right.add(b)
        if a == b:
            break
    return out


def train_merges(
    df: DataFrame, text: str, merges: int, min_count: int = 2, pattern: str = SUBWORD_PIECE
) -> DataFrame:
    """``(rank, left_id, right_id, id, n)`` of the pairs that greedy merging takes, the most frequent
    first; ``n`` is how often the pair occurred when it was merged.

    The corpus is read once, for its different words and their counts. Pair counts are
    made of these once and then changed by what each round does to the words that hold its
    pairs; only words that hold the symbols a pair was made of go through the merges they
    lack. A round merges all leading pairs that cannot influence each other, so
    the result is that of merging one at a time, in fewer jobs. The driver sees
    ``CANDIDATES`` pairs a round; words and pair counts stay in tables under the shared folder.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    words = write_prepared(word_counts(df, text, pattern), f"{folder}/words-0", partition_by=())
    pairs = write_prepared(_pair_counts(words), f"{folder}/pairs-0", partition_by=())
    done: list[tuple[int, int, int, int, int]] = []
    since: list[tuple[str, str]] = []  # merges that the stored words don't have yet
    rounds = 0
    while len(done) < merges:
        best = independent(_ranked(pairs), merges - len(done), min_count)
        if not best:
            break
        step = []
        for row in best:
            new = BYTE_IDS + len(done)
            left, right = map(symbol_id, row.pair)
            done.append((len(done), left, right, new, row.n))
            step.append((row.pair, symbol(new)))
        rounds += 1
        some = words.where(reduce(or_, (F.contains(F.col("word"), F.lit(spelled(pair, since))) for pair, _ in step)))
        # The generator keeps the filter above it, which would repeat the merges for each pair.
        before = some.select(F.explode(F.array(merged(F.col("word"), since))).alias("word"), "n")
        holds = F.exists(_merges(step), lambda m: F.contains(F.col("word"), m["pair"]))
        after = before.where(holds).select("word", "n", merged(F.col("word"), step).alias("now"))
        gone = F.transform(adjacent(F.col("word")), lambda p: F.struct(p.alias("pair"), (-F.col("n")).alias("n")))
        come = F.transform(adjacent(F.col("now")), lambda p: F.struct(p.alias("pair"), F.col("n").alias("n")))
        delta = after.select(F.inline(F.concat(gone, come)))
        counts = pairs.unionByName(delta).groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") > 0)
        pairs = write_prepared(counts, f"{folder}/pairs-{rounds}", partition_by=())
        since += step
        if len(since) >= REWRITE:
            now = words.select(merged(F.col("word"), since).alias("word"), "n")
            words, since = write_prepared(now, f"{folder}/words-{rounds}", partition_by=()), []
    return _table(spark, done)


def _table(spark: SparkSession, rows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "rank int, left_id int, right_id int, id int, n bigint")


def _encoder(
    merges: tuple[tuple[int, int], ...], counted: bool = False, most: int | None = None
) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """Lists of pieces to lists of ids, or to their number, ``most`` at most, where they are
    ``counted``. Nested, so that executors don't need this package."""
    first_merge, known_pieces, known_chars = BYTE_IDS, MAX_KNOWN_PIECES, MAX_KNOWN_CHARS
    most = np.iinfo(np.int32).max if most is None else most
    by_pieces, by_bytes = slicer(MAX_SLICE_PIECES), slicer()

    def parts(lists: pa.Array) -> Iterator[pa.Array]:
        """Lists of up to so many pieces and bytes, or one."""
        for some in by_pieces(lists, pc.list_value_length(lists)):
            ends = np.concatenate([[0], np.cumsum(pc.binary_length(some.flatten()).to_numpy(), dtype=np.int64)])
            sizes = np.diff(ends[some.offsets.to_numpy() - some.offsets[0].as_py()])
            yield from by_bytes(some, pa.array(sizes))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks = {pair: i for i, pair in enumerate(merges)}
        known: dict[str, bytes] = {}
        older: dict[str, bytes] = {}

        def ids_of(piece: str) -> bytes:
            """The pair of least rank is merged first, of equal ones the leftmost."""
            ids = list(piece.encode())
            n = len(ids)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            waiting = [(ranks[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
            heapq.heapify(waiting)
            while waiting:
                rank, i = heapq.heappop(waiting)
                j = after[i] if ids[i] >= 0 else n
                if j >= n or (ids[i], ids[j]) != merges[rank]:
                    continue  # one of the two was merged with another symbol
                ids[i], ids[j] = first_merge + rank, -1
                after[i] = after[j]
                if after[j] < n:
                    before[after[j]] = i
                    pair = (ids[i], ids[after[j]])
                    if pair in ranks:
                        heapq.heappush(waiting, (ranks[pair], i))
                if before[i] >= 0:
                    pair = (ids[before[i]], ids[i])
                    if pair in ranks:
                        heapq.heappush(waiting, (ranks[pair], before[i]))
            return array("i", [i for i in ids if i >= 0]).tobytes()

        for lists in (part for batch in batches for part in parts(batch)):
            coded = lists.flatten().dictionary_encode()
            found = []
            for piece in coded.dictionary.to_pylist():
                ids = known.get(piece)
                if ids is None:
                    ids = older.get(piece) or ids_of(piece)
                    if len(piece) <= known_chars:
                        if len(known) >= known_pieces:
                            known, older = {}, known
                        known[piece] = ids
                found.append(ids)
            # Each piece takes its run of the ids of the different ones.
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
            index = coded.indices.to_numpy(zero_copy_only=False)
            taken = sizes[index]
            ends = np.cumsum(taken)
            cuts = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            missing = ~lists.is_valid().to_numpy(zero_copy_only=False)
            if counted:
                yield pa.array(np.minimum(np.diff(cuts), most), pa.int32(), mask=missing)
                continue
            pool = np.frombuffer(b"".join(found), dtype=np.int32)
            starts = (np.cumsum(sizes) - sizes)[index]
            flat = pool[np.repeat(starts - (ends - taken), taken) + np.arange(ends[-1] if len(ends) else 0)]
            offsets = pa.array(cuts, pa.int32(), mask=np.append(missing, False))
            yield pa.ListArray.from_arrays(offsets, pa.array(flat))

    return run


@dataclass(frozen=True)
class SubwordCodec:
    """Codec over trained merges: ids 0-255 are bytes, then one for each merge, then the end.

    Pieces are cut in the JVM and merged over Arrow arrays: each different piece of a batch once,
    the pair of least rank first, and ids are laid out by offsets. Decoding stays in the JVM.
    """

    merges: tuple[tuple[int, int], ...]
    tokens: str
    eos_id: int
    pad: int | None = None
    pattern: str = SUBWORD_PIECE

    @classmethod
    def load(
        cls, merges: DataFrame, pad: int | None = None, pattern: str = SUBWORD_PIECE, max_merges: int = MAX_INLINE_TOKENS
    ) -> SubwordCodec:
        """Read a table of merges whose size is checked against ``max_merges`` first."""
        rows = merges.select("rank", "left_id", "right_id").limit(max_merges + 1).collect()
        if len(rows) > max_merges:
            raise ValueError(f"over {max_merges} merges")
        rows.sort(key=lambda r: r.rank)
        if [r.rank for r in rows] != list(range(len(rows))):
            raise ValueError("ranks must be 0, 1, 2, ...")
        if any(not 0 <= i < BYTE_IDS + r.rank for r in rows for i in (r.left_id, r.right_id)):
            raise ValueError("a merge must take symbols that exist")
        pairs = tuple((r.left_id, r.right_id) for r in rows)
        if len(set(pairs)) < len(pairs):
            raise ValueError("a pair has two ranks")
        tokens = [chr(i) for i in range(BYTE_IDS)]
        for left, right in pairs:
            tokens.append(tokens[left] + tokens[right])
        return cls(pairs, json.dumps(tokens), len(tokens), pad, pattern)

    @property
    def pad_id(self) -> int:
        return self.eos_id if self.pad is None else self.pad

    @property
    def special_ids(self) -> tuple[int, ...]:
        return tuple(sorted({self.eos_id, self.pad_id}))

    def encode(self, text: Column, max_len: int | None = None) -> Column:
        # A piece has at least one id, so the pieces beyond the limit are not merged.
        cut = truncate(pieces(text, self.pattern), max_len)
        # Declared non-deterministic so that the optimizer neither repeats it nor pushes a filter below it.
        merge = F.arrow_udf(_encoder(self.merges), "array<int>").asNondeterministic()
        return truncate(merge(cut), max_len)

    def count(self, text: Column, max_len: int | None = None) -> Column:
        """Number of ids ``encode`` would give, which are not laid out for it."""
        cut = truncate(pieces(text, self.pattern), max_len)
        return F.arrow_udf(_encoder(self.merges, True, max_len), "int").asNondeterministic()(cut)

    def decode(self, ids: Column) -> Column:
        """Text of the ids without special ids; a cut character becomes U+FFFD."""
        tokens = _constant(self.tokens, "array<string>")
        latin = F.array_join(F.transform(drop_special(ids, self.special_ids), lambda i: F.get(tokens, i)), "")
        return F.make_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string"))
