"""Importance resampling towards a target distribution, by hashed runs of words.

Features are runs of one to three words in hashed buckets; a bucket's gain is the logarithm of
how much likelier it is in the target texts than in the corpus. A document's score is the sum
of the gains of its features and a random term of its own, and the highest scores are drawn.

Texts are scanned once, in chunks of bounded size. The distinct words of a chunk make an
Aho-Corasick dictionary: each stands between two delimiters and carries its CRC and its
length. One scan of the automaton emits the payloads in the order of the text, and the CRC of
a run follows from the payloads of its words, without a look at the text again. A dictionary
of all the corpus would grow with it; one for each chunk does not. Words above ``LONGEST``
bytes are not put in; their payloads are taken directly, at a place that the automaton emits.

The buckets of a document are stored, two bytes for each feature, in parts of at most a
chunk's words. Corpus and target are counted by task and then by bucket, so the driver sees
one number for each bucket. Places in the draw are prefix sums over even ranges of scores.

Words are runs of ASCII letters, digits and all other characters beyond ASCII, A-Z in lower
case. A null text has none. Rows that share an id are documents of their own, of equal ones
any comes first; a null id counts as an empty one in the random term and comes after others.
Extra columns are ignored. Empty corpora give empty tables, without target texts all buckets
count as unseen there.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mcqflow.llm.common import checkpointed, fresh, new_folder, text_of
from mcqflow.operators.numbering import default_buckets, quantile_buckets

BUCKETS = 10_000
RUN = 3
PERCENT = 5
LEAST_WORDS = 20
SEED = 42
CHUNK = 4 << 20  # bytes of text in one automaton
LONGEST = 256

PARTS = "row bigint, doc_id bigint, n_words bigint, n_features bigint, buckets binary"
_PARTS = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary())]
)

# Letters and digits of ASCII, in lower case, and all bytes of other characters; the rest delimits.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_LONG = re.compile(rb"[^ ]{%d,}" % (LONGEST + 1))
_ELSEWHERE = 1 << 63
_SPACE = zlib.crc32(b" ")


@lru_cache(maxsize=1)
def _steps() -> np.ndarray:
    """[k, j, b]: what byte j of a CRC, being b, becomes when 2**k zero bytes follow."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    out = np.zeros((32, 4, 256), dtype=np.uint32)
    for j in range(4):
        value = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
        out[0, j] = one[value & 255] ^ (value >> 8)
    for k in range(1, 32):
        out[k] = _step(out[k - 1], out[k - 1])
    return out


def _step(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def followed(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What each CRC becomes when so many zero bytes follow; that of a concatenation is this of
    the first part and the CRC of the second, combined by exclusive or."""
    steps, out = _steps(), crc.copy()
    for k in range(int(sizes.max(initial=0)).bit_length()):
        rows = np.flatnonzero((sizes >> k) & 1)
        out[rows] = _step(steps[k], out[rows])
    return out


def _payload(word: bytes) -> int:
    return len(word) << 32 | zlib.crc32(word)


def payloads(texts: list[bytes]) -> np.ndarray:
    """Of each word in order its length and CRC, in one number; 0 between two texts."""
    import ahocorasick

    joined, elsewhere = b" \n ".join(texts), []

    def kept(found: re.Match) -> bytes:
        elsewhere.append(_payload(found.group()))
        return b"\1"

    joined = _LONG.sub(kept, joined)
    words = set(joined.split(b" ")) - {b"", b"\n", b"\1"}
    dictionary = ahocorasick.Automaton()
    for word in words:
        dictionary.add_word(f" {word.decode('latin-1')} ", _payload(word))
    dictionary.add_word(" \n ", 0)
    dictionary.add_word(" \1 ", _ELSEWHERE)
    dictionary.make_automaton()
    emitted = map(itemgetter(1), dictionary.iter(f" {joined.decode('latin-1')} "))
    out = np.fromiter(emitted, dtype=np.uint64)
    out[out == _ELSEWHERE] = elsewhere
    return out


@dataclass
class Segment:
    """Words of one document; the first ``known`` ones were counted with the segment before."""

    row: int
    doc_id: int | None
    text: bytes
    known: int


def segments(row: int, doc_id: int | None, text: bytes, most: int) -> Iterator[Segment]:
    """The text in pieces that end between words, each after the last words of the one before."""
    text, begin, before = text.translate(_BYTES), 0, []
    while True:
        end = len(text) if len(text) - begin <= most else text.find(b" ", begin + most)
        end = len(text) if end < 0 else end
        piece = b" ".join([*before, text[begin:end]])
        yield Segment(row, doc_id, piece, len(before))
        if end >= len(text):
            return
        begin, before = end, piece.rsplit(None, RUN - 1)[1 - RUN :]


def _featured(parts: list[Segment], buckets: int) -> pa.RecordBatch:
    """Buckets of the runs that end in each segment's new words."""
    word = payloads([p.text for p in parts])
    cut = word == 0
    part = np.cumsum(cut)[~cut]
    word = word[~cut]
    n = len(word)
    crc, size = (word & np.uint64(0xFFFFFFFF)).astype(np.uint32), (word >> np.uint64(32)).astype(np.int64)
    total = np.bincount(part, minlength=len(parts))
    at = np.arange(n) - (np.cumsum(total) - total)[part]
    known = np.array([p.known for p in parts])[part]
    runs, run = np.zeros((n, RUN), dtype=np.uint32), crc
    valid = np.zeros((n, RUN), dtype=bool)
    for k in range(RUN):
        runs[k:, k] = run
        valid[:, k] = at >= np.maximum(known, k)
        # The run that ended a word before, a space, and the word.
        spaced = _step(_steps()[0], run[:-1]) ^ np.uint32(_SPACE)
        run = followed(spaced, size[k + 1 :]) ^ crc[k + 1 :]
    found = (runs[valid] % np.uint32(buckets)).astype(np.uint16)
    features = np.bincount(part, weights=valid.sum(axis=1), minlength=len(parts)).astype(np.int64)
    new = total - np.array([p.known for p in parts])
    ends = np.concatenate([[0], np.cumsum(features * 2)]).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(found.tobytes())])
    columns = [pa.array([p.row for p in parts], pa.int64()), pa.array([p.doc_id for p in parts], pa.int64()), pa.array(new), pa.array(features), data]
    return pa.RecordBatch.from_arrays(columns, schema=_PARTS)


def _scan(batches: Iterator[pa.RecordBatch], buckets: int, chunk: int) -> Iterator[pa.RecordBatch]:
    held, parts = 0, []
    for batch in batches:
        for row, doc_id, text in zip(*(batch.column(c) for c in ("row", "doc_id", "text")), strict=True):
            for part in segments(row.as_py(), doc_id.as_py(), text.as_py().encode(), chunk):
                parts.append(part)
                held += len(part.text) + 3
                if held >= chunk:
                    yield _featured(parts, buckets)
                    held, parts = 0, []
    if parts:
        yield _featured(parts, buckets)


def features(docs: DataFrame, buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """Parts of documents: row, doc_id, n_words, n_features and the buckets, as 16-bit numbers."""
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("buckets must be 1 to 65536")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_of("text").alias("text"))
    return rows.mapInArrow(lambda batches: _scan(batches, buckets, chunk), PARTS)


def stored(found: DataFrame) -> DataFrame:
    """Written to the shared folder and read again."""
    path = new_folder(found.sparkSession, "features")
    found.write.parquet(path)
    return found.sparkSession.read.parquet(path)


def _joined(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs; one number for each bucket, whatever the corpus."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_joined(batch.column("buckets")), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["bucket", "n"])

    rows = found.select("buckets").mapInArrow(counted, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    out[[r.bucket for r in rows]] = [r.n for r in rows]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed odds of each bucket."""
    S, T, more = float(corpus.sum()), float(target.sum()), float(len(corpus))
    odds = (target + 1.0) * (S + more) / ((corpus + 1.0) * (T + more))
    return np.floor(1000 * np.log(odds)).astype(np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """row, doc_id, n_words, n_features and weight of each document."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.concatenate([[0], np.cumsum(gain[_joined(batch.column("buckets"))])])
            ends = np.cumsum(batch.column("n_features").to_numpy())
            weight = sums[ends] - sums[ends - batch.column("n_features").to_numpy()]
            columns = [batch.column(c) for c in ("row", "doc_id", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(weight)], names=["row", "doc_id", "n_words", "n_features", "weight"])

    parts = found.mapInArrow(summed, "row bigint, doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    return parts.groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A draw from a Gumbel distribution, by the id, in thousandths."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Add ``rank``: the place among the highest scores that are drawn, else null."""
    long_enough = scored.where(F.col("n_words") >= least_words)
    most = long_enough.count() * percent // 100
    rows = quantile_buckets(long_enough.withColumn("low", -F.col("score")), "low", "bucket", default_buckets(scored))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    earlier = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # as many rows as buckets
    offsets = sizes.select("bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    placed = rows.join(F.broadcast(offsets), "bucket")
    order = W.partitionBy("bucket").orderBy("low", F.col("doc_id").asc_nulls_last(), "row")
    place = F.col("offset") + F.row_number().over(order)
    upper = placed.where(F.col("offset") < most).withColumn("rank", F.when(place <= most, place))
    none = F.lit(None).cast("bigint")
    rest = placed.where(F.col("offset") >= most).withColumn("rank", none)
    short = scored.where(F.col("n_words") < least_words).withColumn("rank", none)
    columns = [*scored.columns, "rank"]
    return upper.select(columns).unionByName(rest.select(columns)).unionByName(short.select(columns))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each document; ``target`` has texts in ``text``."""
    found = stored(features(docs, buckets, chunk))
    wanted = features(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), buckets, chunk)
    weights = weighed(found, gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets)))
    score = (F.col("weight") + noise(F.col("doc_id"))).alias("score")
    scored = checkpointed(weights.select("row", "doc_id", "n_words", "n_features", "weight", score))
    return drawn(scored).select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The documents that are drawn, with all their columns; ids must be unique."""
    rank = fresh(docs.columns, "_rank")
    ids = resample(docs, target).where("rank is not null").select("doc_id", F.col("rank").alias(rank))
    return docs.join(ids, "doc_id").drop(rank).select(docs.columns)
