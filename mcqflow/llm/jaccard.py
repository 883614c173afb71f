"""N-gram Jaccard join with a count-vector R-tree.

A document's set holds the digests of its distinct word 5-grams. Documents with equal sets
are one class. Two classes link if their sets' Jaccard similarity is at least the threshold;
a component is what links connect.

1. A sketch counts all shingles in hashed buckets. It is a fixed number of bytes, whatever
   the corpus, and orders shingles from rare to frequent. Any order gives right results;
   this one keeps what many texts share out of the way.
2. Linked sets share one of their first ``n - ceil(threshold * n) + 1`` shingles. Those
   prefixes are asked for by packed arrays; a shingle in one class's prefix only is dropped,
   and so is a class's row where no other class that has the shingle is of a size that can link.
   Classes that are left with a shingle are active, and their sets are stored.
3. Each class has a count vector, the number of its shingles in each of ``DIMENSIONS``
   hashed groups. The overlap of two sets is at most the sum of the coordinates' minima. Each different
   pair that meets at a shingle of few classes is bounded once; so no set moves for what meets by
   chance, which grows faster than the corpus. What passes, and what meets at a shingle of
   many classes, makes clusters that no link leaves. A cluster of bounded size is searched by one
   task, so each set moves once: an R-tree bounds the overlap for all below a node, what
   passes is verified on the sets, and classes that are connected already aren't compared again.
4. Classes of larger clusters meet at their leading shared shingles, large groups in even parts,
   and are searched in the same way.
5. Prefix shingles at which different components still meet are searched in the same way,
   with vectors only: first for each class the best partner in each other component, then
   for all pairs. Pairs are verified by a join with the sets. So no link is lost, and a group
   of near copies doesn't turn into all of its pairs.

Words are runs of anything but ASCII white space, A-Z in lower case. With fewer words than a
shingle the whole sequence is one shingle; without words, or text, the set is empty and
links with nothing. Rows that share a doc_id are documents of their own, each with its row;
null ids are never a component's name unless all its ids are null. An empty table gives an
empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window as W, functions as F

from mcqflow.llm.common import checkpointed, fresh, text_of
from mcqflow.llm.components import components
from mcqflow.llm.words import U, mix, words_of_texts

SHINGLE = 5
PERCENT = 75
SKETCH_BITS = 25  # 32 MB, whatever the corpus
SLICES = 64
DIMENSIONS = 256
LEAF = 16
LEADS = 2  # groups in which the sets of an active class are compared
PART_ROWS = 4000  # of a group, compared by one task
BROADCAST_ROWS = 250_000  # of at most 32 bytes

FEW = 16  # rows of a group whose pairs are bounded one by one
CLUSTER_SHINGLES = 4 << 20  # of a cluster, searched by one task

CHUNK = 1 << 18
ID_BYTES = 12  # of a set's digest

# Odd factors of a shingle's words; the differences of any two are not multiples of 16.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


class Shingler:
    """Sets of texts."""

    def __init__(self, size: int = SHINGLE) -> None:
        if not 1 <= size <= len(_FACTORS):
            raise ValueError(f"a shingle has 1 to {len(_FACTORS)} words")
        self.size = size

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The distinct shingles of each text."""
        words, cuts = words_of_texts(texts, lower=True)
        n = max(0, len(words) - self.size + 1)
        total = np.zeros(n, dtype=U)
        for i, factor in enumerate(_FACTORS[: self.size]):
            total += words[i : i + n] * U(factor)
        total = mix(total)
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= self.size:
                out.append(np.unique(total[a : b - self.size + 1]))
            elif b > a:
                # All words of a short text; its length keeps it apart from longer shingles.
                short = sum((words[a + i : a + i + 1] * U(_FACTORS[i]) for i in range(b - a)), U(b - a) << U(32))
                out.append(mix(short))
            else:
                out.append(words[:0])
        return out


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=ID_BYTES).digest()


def needed(a, b, percent: int = PERCENT):
    """Least overlap of linked sets of sizes a and b: 100 o >= percent (a + b - o)."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - math.ceil(percent * n / 100) + 1 if n else 0


def may_meet(group: np.ndarray, size: np.ndarray, at: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether another row of the group (groups ascend) is of a size with which a row can link here.

    If two linked sets first share the shingle at a place of each, they share no more than what
    is left there, so ``100 (size - at) >= percent * (both sizes - overlap)`` bounds the other's
    size, as the threshold itself does. Of two linked sets that share a shingle first, both rows stay.
    """
    left = size - at
    least = -(-percent * size // 100)
    most = np.minimum(100 * size // percent, (100 + percent) * left // percent - size)
    span = int(size.max(initial=0)) + 2
    order = np.lexsort((size, group))
    code = group[order].astype(np.int64) * span + size[order]
    low = np.searchsorted(code, group * span + least, side="left")
    high = np.searchsorted(code, group * span + np.minimum(most, span - 1), side="right")
    itself = (size >= least) & (size <= most)
    return high - low > itself


def _asked(width: int) -> np.dtype:
    """A set that asks for a shingle: the first 40 bits of the shingle's hash, the set's size and the
    shingle's place in its order, in so many bytes each. It holds the whole id: the more parts
    there are, the fewer shingles a set sends to one."""
    number = f"<u{width}"
    return np.dtype([("id", f"V{ID_BYTES}"), ("low", "<u4"), ("high", "u1"), ("size", number), ("at", number)])


def count_vector(shingles: np.ndarray) -> np.ndarray:
    groups = (mix(shingles + U(11)) >> U(40)) % U(DIMENSIONS)
    return np.minimum(np.bincount(groups.astype(np.int64), minlength=DIMENSIONS), 2**31 - 1).astype(np.uint32)


def stored(vector: np.ndarray) -> bytes:
    """Two bytes for each count; what is too large for them is read back as the largest count,
    so bounds stay bounds."""
    return np.minimum(vector, 2**16 - 1).astype(np.uint16).tobytes()


def loaded(vectors: pa.ChunkedArray) -> np.ndarray:
    raw = np.frombuffer(b"".join(vectors.to_pylist()), np.uint16).reshape(-1, DIMENSIONS).astype(np.uint32)
    raw[raw == 2**16 - 1] = 2**31 - 1
    return raw


class RTree:
    """Count vectors in packed nodes; a node holds the largest coordinates and sizes below it.

    Only upper corners matter to the bound. Rows are packed in the order of size and leading
    coordinates, so near sets share leaves.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.lexsort((*vectors[:, 7::-1].T, sizes))
        self.vectors, self.sizes = vectors[self.order], sizes[self.order]
        self.levels = [(self.vectors, self.sizes, self.sizes)]
        while len(self.levels[-1][0]) > LEAF:
            v, low, high = self.levels[-1]
            at = np.arange(0, len(v), LEAF)
            self.levels.append(
                (np.maximum.reduceat(v, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at))
            )

    def search(self, vector: np.ndarray, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may link with a set of this vector, and the bound of their overlap."""
        here = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            v, low, high = self.levels[level]
            # Sizes of linked sets differ by no more than the threshold allows.
            here = here[(100 * high[here] >= percent * size) & (percent * low[here] <= 100 * size)]
            bound = np.minimum(v[here], vector).sum(axis=1, dtype=np.int64)
            least = np.maximum(low[here], math.ceil(percent * size / 100))
            keep = bound >= needed(size, least, percent)
            here, bound = here[keep], bound[keep]
            if level:
                below = len(self.levels[level - 1][0])
                here = (here[:, None] * LEAF + np.arange(LEAF)).ravel()
                here = here[here < below]
        return self.order[here], bound


def links_in_group(ids: list[bytes], sets: list[np.ndarray], percent: int = PERCENT) -> Iterator[tuple[bytes, bytes]]:
    """Links that connect all that is connected in the group; not all links."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    vectors = np.stack([count_vector(s) for s in sets])
    tree = RTree(vectors, sizes)
    root = np.arange(len(ids))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        rows, bound = tree.search(vectors[i], int(sizes[i]), percent)
        mine = rows < i
        rows, bound = rows[mine], bound[mine]
        for j in rows[np.argsort(-bound, kind="stable")].tolist():
            a, b = top(i), top(j)
            if a == b:
                continue
            both = np.intersect1d(sets[i], sets[j], assume_unique=True).size
            if 100 * both >= percent * (int(sizes[i] + sizes[j]) - both):
                root[a] = b
                yield ids[i], ids[j]


def pairs_in_group(
    rows: np.ndarray, comp: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, best: bool, percent: int = PERCENT
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different components that pass the bound; ``best``: one for each row and component."""
    tree = RTree(vectors[rows], sizes[rows])
    mine, left, right = comp[rows], [], []
    for i, row in enumerate(rows.tolist()):
        found, bound = tree.search(vectors[row], int(sizes[row]), percent)
        other = mine[found] != mine[i]
        if not best:
            other &= found < i
        found, bound = found[other], bound[other]
        if best and len(found):
            order = np.lexsort((-bound, mine[found]))
            found = found[order]
            found = found[np.r_[True, mine[found[1:]] != mine[found[:-1]]]]
        left.append(np.full(len(found), row))
        right.append(rows[found])
    return np.concatenate(left), np.concatenate(right)


def pairs_of_leaves(
    group: np.ndarray, comp: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, percent: int = PERCENT
) -> tuple[np.ndarray, np.ndarray]:
    """The same for many groups of at most one leaf, whose rows stand together: rows at distance
    1, 2, ... are bounded side by side."""
    left, right = [], []
    for distance in range(1, LEAF):
        i = np.arange(max(0, len(group) - distance))
        j = i + distance
        keep = (group[i] == group[j]) & (comp[i] != comp[j])
        keep &= (100 * sizes[i] >= percent * sizes[j]) & (100 * sizes[j] >= percent * sizes[i])
        i, j = i[keep], j[keep]
        for at in range(0, len(i), 20_000):
            a, b = i[at : at + 20_000], j[at : at + 20_000]
            bound = np.minimum(vectors[a], vectors[b]).sum(axis=1, dtype=np.int64)
            passes = bound >= needed(sizes[a], sizes[b], percent)
            left.append(a[passes])
            right.append(b[passes])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


@dataclass
class Order:
    """The order of shingles: quarter-octaves of bucket counts, then the digest."""

    sketch: Broadcast
    bits: int

    def sort(self, shingles: np.ndarray) -> np.ndarray:
        level = np.frombuffer(self.sketch.value, np.uint8)[(mix(shingles + U(5)) >> U(64 - self.bits)).astype(np.int64)]
        return shingles[np.lexsort((shingles, level))]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows and their texts, up to so many bytes or one text at a time."""
    for b in batches:
        sizes, at = pc.binary_length(b.column("text")).to_pylist(), 0
        while at < b.num_rows:
            stop, held = at + 1, sizes[at]
            while stop < b.num_rows and held + sizes[stop] <= CHUNK:
                held += sizes[stop]
                stop += 1
            some = b.slice(at, stop - at)
            yield some, some.column("text").cast(pa.binary()).to_pylist()
            at = stop


def _frame(columns: tuple, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_SETS = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary())])
_SKETCH = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])
_ASKED = pa.schema([("part", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])
_ACTIVE = pa.schema(
    [("set_id", pa.binary()), ("size", pa.int64()), ("shingles", pa.list_(pa.int64())), ("vector", pa.binary())]
)


def read_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, hash of the text, size and digest of the set of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for rows, texts in _chunks(batches):
            sets = shingler.sets(texts)
            yield _frame((rows.column("doc_id"), rows.column("hash"), [len(s) for s in sets], [fingerprint(s) for s in sets]), _SETS)

    return docs.mapInArrow(work, "doc_id bigint, hash bigint, n_shingles bigint, set_id binary")


def sketch_order(docs: DataFrame, bits: int = SKETCH_BITS, size: int = SHINGLE) -> Order:
    """Counts of all shingles by bucket, as a table of one byte for each bucket."""
    width = (1 << bits) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task counts to 255, which is frequent enough for an order.
        shingler, counts = Shingler(size), np.zeros(1 << bits, dtype=np.uint8)
        for _, texts in _chunks(batches):
            every = np.concatenate(shingler.sets(texts))
            at, times = np.unique((mix(every + U(5)) >> U(64 - bits)).astype(np.uint32), return_counts=True)
            counts[at] = np.minimum(counts[at] + times, 255)
        blobs = [zlib.compress(counts[i * width : (i + 1) * width].tobytes(), 1) for i in range(SLICES)]
        yield _frame((list(range(SLICES)), blobs), _SKETCH)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, dtype=np.uint64)
        for blob in table.column("counts"):
            total += np.frombuffer(zlib.decompress(blob.as_py()), np.uint8)
        level = np.minimum(np.floor(4 * np.log2(total + 1.0)), 255).astype(np.uint8)
        return pa.table([table.column("slice")[:1], pa.array([level.tobytes()], pa.binary())], schema=_SKETCH)

    ddl = "slice int, counts binary"
    rows = docs.mapInArrow(count, ddl).groupBy("slice").applyInArrow(add, ddl).collect()
    parts = {r["slice"]: bytes(r["counts"]) for r in rows}
    table = b"".join(parts.get(i, bytes(width)) for i in range(SLICES))
    return Order(docs.sparkSession.sparkContext.broadcast(table), bits)


def shared_prefixes(docs: DataFrame, order: Order, parts: int, percent: int, size: int) -> DataFrame:
    """set_id and those shingles of its prefix that another set's prefix has too, with their counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        ids: list[bytes] = []
        keys: list[np.ndarray] = []
        sizes: list[int] = []
        held, seen = 0, set()

        def send() -> pa.RecordBatch:
            hashed = mix(np.concatenate(keys))
            owner = np.repeat(np.arange(len(ids), dtype=np.int32), [len(k) for k in keys])
            width = 2 if max(sizes) < 1 << 16 else 4
            rows = np.empty(len(hashed), _asked(width))
            rows["id"] = np.frombuffer(b"".join(ids), f"V{ID_BYTES}")[owner]
            rows["low"], rows["high"] = (hashed >> U(24)) & U(2**32 - 1), hashed >> U(56)
            rows["size"] = np.array(sizes, dtype=np.int64)[owner]
            rows["at"] = np.concatenate([np.arange(len(k)) for k in keys])
            part = (hashed % U(parts)).astype(np.int32)
            by = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by], np.arange(parts + 1))
            used = np.flatnonzero(np.diff(cuts))
            data = [rows[by[cuts[p] : cuts[p + 1]]].tobytes() for p in used.tolist()]
            return _frame((used, np.full(len(used), width), data), _ASKED)

        for shingles in (s for _, texts in _chunks(batches) for s in shingler.sets(texts)):
            if not len(shingles):
                continue
            set_id = fingerprint(shingles)
            if set_id in seen:
                continue
            seen.add(set_id)
            prefix = order.sort(shingles)[: prefix_length(len(shingles), percent)]
            ids.append(set_id)
            keys.append(prefix)
            sizes.append(len(shingles))
            held += len(prefix)
            if held >= 500_000:
                yield send()
                ids, keys, sizes, held = [], [], [], 0
                seen.clear()
        if ids:
            yield send()

    def answer(table: pa.Table) -> pa.Table:
        pieces = zip(table.column("data"), table.column("width"), strict=True)
        rows = np.concatenate([np.frombuffer(d.as_py(), _asked(w.as_py())).astype(_asked(4)) for d, w in pieces])
        key = (rows["high"].astype(U) << U(32)) | rows["low"]
        low = np.ascontiguousarray(rows["id"]).view(np.uint32).reshape(-1, ID_BYTES // 4)
        by = np.lexsort((*low.T, key))
        key, low = key[by], low[by]
        new_key = np.r_[True, key[1:] != key[:-1]]
        new = new_key | np.r_[True, (low[1:] != low[:-1]).any(axis=1)]
        by = by[new]
        rows, key, new_key = rows[by], key[new], new_key[new]
        owner, size, at = (rows["id"], rows["size"].astype(np.int64), rows["at"].astype(np.int64))
        met = may_meet(np.cumsum(new_key) - 1, size, at, percent)
        key, owner = key[met], owner[met]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
        times = np.diff(np.r_[start, len(key)])
        times = np.repeat(times, times)
        keep = times > 1
        return pa.table(
            [
                pa.array(owner[keep].tolist(), pa.binary()),
                # Shingles of a part whose hashes share 40 bits are one; that adds candidates and loses none.
                pa.array(key[keep].view(np.int64) | (table.column("part")[0].as_py() << 40)),
                pa.array(times[keep]),
            ],
            names=["set_id", "key", "sets"],
        )

    asked = docs.mapInArrow(ask, "part int, width int, data binary")
    return asked.groupBy("part").applyInArrow(answer, "set_id binary, key bigint, sets bigint")


def _active_sets(texts: DataFrame, size: int) -> DataFrame:
    """Set and count vector of each text; the text stands for its class. A task gives a class once,
    however many equal rows it reads."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(size), set()
        for rows, texts in _chunks(batches):
            ids = rows.column("set_id").to_pylist()
            new = [i for i, x in enumerate(ids) if not (x in seen or seen.add(x))]
            if not new:
                continue
            rows, sets = rows.take(pa.array(new)), shingler.sets([texts[i] for i in new])
            vectors = [stored(count_vector(s)) for s in sets]
            yield _frame((rows.column("set_id"), [len(s) for s in sets], [s.view(np.int64) for s in sets], vectors), _ACTIVE)

    return texts.mapInArrow(work, "set_id binary, size bigint, shingles array<bigint>, vector binary")


_EDGE = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _near_pairs(keys: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """Pairs that meet in a group of at most ``FEW`` rows and pass the bound of their count vectors. Each
    different pair is bounded once, however many shingles it shares."""
    ids = F.array_sort(F.collect_list("set_id"))
    met = keys.where(F.col("sets") <= FEW).groupBy("key").agg(ids.alias("ids"))
    each = F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, FEW), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    pairs = met.select(F.inline(F.flatten(each))).distinct()
    for x in ("a", "b"):
        side = active.select(F.col("set_id").alias(x), F.col("size").alias(f"size_{x}"), F.col("vector").alias(f"vector_{x}"))
        pairs = pairs.join(side, x)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                a, b = (loaded(rows.column(f"vector_{x}")) for x in ("a", "b"))
                least = needed(*(rows.column(f"size_{x}").to_numpy() for x in ("a", "b")), percent)
                passes = np.minimum(a, b).sum(axis=1, dtype=np.int64) >= least
                yield rows.select(["a", "b"]).filter(pa.array(passes))

    return pairs.mapInArrow(bounded, "a binary, b binary")


def _clusters(keys: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """set_id, cluster, and whether that is small, of the classes that may link; no link leaves a cluster."""
    large = keys.where(F.col("sets") > FEW)
    stars = large.join(large.groupBy("key").agg(F.min("set_id").alias("b")), "key").select(F.col("set_id").alias("a"), "b")
    edges = checkpointed(_near_pairs(keys, active, percent).union(stars.distinct()))
    found = components(edges.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), edges)
    found = found.withColumnRenamed("comp", "cluster")
    sized = found.join(active.select("set_id", "size"), "set_id").groupBy("cluster")
    small = (F.count(F.lit(1)) <= PART_ROWS) & (F.sum("size") <= CLUSTER_SHINGLES)
    return checkpointed(found.join(sized.agg(small.alias("small")), "cluster"))


def _groups(table: pa.Table) -> Iterator[tuple[list[bytes], list[np.ndarray]]]:
    """Ids and sets of the rows with each value of ``at``."""
    _, at = np.unique(np.array(table.column("at").to_pylist()), return_inverse=True)
    order = np.argsort(at, kind="stable")
    cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(at[order]) != 0]), len(order)]
    ids, shingles = table.column("set_id"), table.column("shingles")
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        group = order[x:y].tolist()
        yield [ids[i].as_py() for i in group], [shingles[i].values.to_numpy().view(U) for i in group]


def _solved(active: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """set_id and comp in clusters that a task can hold."""

    def work(table: pa.Table) -> pa.Table:
        rows: list[tuple[bytes, bytes]] = []
        for ids, sets in _groups(table):
            root = {x: x for x in ids}

            def top(x: bytes, root: dict[bytes, bytes] = root) -> bytes:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in links_in_group(ids, sets, percent):
                a, b = sorted((top(a), top(b)))
                root[b] = a
            rows += [(x, top(x)) for x in ids]
        return pa.table([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=["set_id", "comp"])

    many = int(active.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    rows = _asked_sets(active, clusters).select("set_id", "shingles", F.xxhash64("cluster").alias("at"))
    return rows.withColumn("bucket", F.pmod("at", F.lit(many))).groupBy("bucket").applyInArrow(work, "set_id binary, comp binary")


def _lead_links(active: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """Links found where classes meet at their leading shared shingles, with their sets."""
    # Of the most frequent ones those with the smallest hashes: near copies agree on them.
    level = F.floor(F.log2("sets"))
    rank = F.row_number().over(W.partitionBy("set_id").orderBy(F.desc(level), F.xxhash64("key"), "key"))
    lead = keys.withColumn("rank", rank).where(F.col("rank") <= LEADS)
    part = F.pmod(F.xxhash64("set_id"), F.ceil(F.col("sets") / PART_ROWS))
    lead = lead.select("set_id", "key", part.alias("part"))
    counted = lead.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    lead = lead.join(counted, ["key", "part"])

    def work(table: pa.Table) -> pa.Table:
        found = [link for ids, sets in _groups(table) for link in links_in_group(ids, sets, percent)]
        return pa.table([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], schema=_EDGE)

    many = int(active.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    rows = _asked_sets(active, checkpointed(lead)).select("set_id", "shingles", F.xxhash64("key", "part").alias("at"))
    return rows.withColumn("bucket", F.pmod("at", F.lit(many))).groupBy("bucket").applyInArrow(work, "a binary, b binary")


def _meeting_pairs(active: DataFrame, keys: DataFrame, comps: DataFrame, best: bool, percent: int) -> DataFrame:
    """Pairs of classes of different components that meet at a shingle and pass the bound."""
    rows = keys.join(F.broadcast(comps) if comps.count() <= BROADCAST_ROWS else comps, "set_id")
    open_ = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    rows = rows.join(open_, "key").join(active.select("set_id", "size", "vector"), "set_id")
    if best:
        part = F.pmod(F.xxhash64("set_id"), F.ceil(F.col("sets") / PART_ROWS)).cast("long")
        rows = rows.withColumn("part", part)
    else:
        # A large group is cut into blocks; a row goes to every pair of blocks that its own is in.
        blocks = F.ceil(F.col("sets") / PART_ROWS).cast("int")
        own = F.pmod(F.xxhash64("set_id"), blocks).cast("int")
        pairs = F.transform(
            F.sequence(F.lit(0), blocks - 1),
            lambda x: F.least(x, own).cast("long") * F.lit(1 << 31) + F.greatest(x, own).cast("long"),
        )
        rows = rows.withColumn("part", F.explode(pairs))

    def work(table: pa.Table) -> pa.Table:
        ids = np.array(table.column("set_id").to_pylist(), dtype=object)
        _, group = np.unique(np.array(table.column("at").to_pylist()), return_inverse=True)
        order = np.argsort(group, kind="stable")
        _, comp = np.unique(np.array(table.column("comp").to_pylist(), dtype=object), return_inverse=True)
        sizes, vectors = table.column("size").to_numpy(), loaded(table.column("vector"))
        cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(group[order]) > 0]), len(order)]
        times = np.repeat(np.diff(cuts), np.diff(cuts))
        few = order[times <= LEAF]
        a, b = pairs_of_leaves(group[few], comp[few], vectors[few], sizes[few], percent)
        pairs = [(few[a], few[b])]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if y - x > LEAF:
                pairs.append(pairs_in_group(order[x:y], comp, vectors, sizes, best, percent))
        left, right = (ids[np.concatenate([p[k] for p in pairs])] for k in (0, 1))
        swap = left > right
        left, right = np.where(swap, right, left), np.where(swap, left, right)
        both = sorted(set(zip(left.tolist(), right.tolist(), strict=True)))
        return pa.table([pa.array([p[k] for p in both], pa.binary()) for k in (0, 1)], schema=_EDGE)

    # Small groups are searched many at a time; the rows of one group stay together.
    many = int(active.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    kept = rows.select(F.xxhash64("key", "part").alias("at"), "set_id", "comp", "size", "vector")
    kept = kept.withColumn("bucket", F.pmod("at", F.lit(many)))
    return kept.groupBy("bucket").applyInArrow(work, "a binary, b binary").distinct()


def _asked_sets(active: DataFrame, ids: DataFrame) -> DataFrame:
    """Sets of the classes of a stored table, of ids that may repeat, with its other columns. While the
    table is small it goes to the sets, and none moves that isn't asked for."""
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return active.select("set_id", "shingles").join(wanted, "set_id")


def _verified(pairs: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    pairs = checkpointed(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    sets = _asked_sets(active, checkpointed(ids)).select("set_id", "shingles")
    left = sets.withColumnsRenamed({"set_id": "a", "shingles": "left"})
    right = sets.withColumnsRenamed({"set_id": "b", "shingles": "right"})
    both = F.size(F.array_intersect("left", "right"))
    rows = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    enough = 100 * F.col("both") >= percent * (F.size("left") + F.size("right") - F.col("both"))
    return rows.where(enough).select("a", "b")


def _linked_at_keys(keys: DataFrame, active: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """set_id and comp of classes, by the shingles at which they meet."""
    comps = components(nodes, checkpointed(_lead_links(active, keys, percent)))
    for best in (True, False):
        pairs = _meeting_pairs(active, keys, comps, best, percent)
        more = checkpointed(_verified(pairs, active, percent))
        if not more.isEmpty():
            a = comps.withColumnsRenamed({"set_id": "a", "comp": "x"})
            b = comps.withColumnsRenamed({"set_id": "b", "comp": "y"})
            between = more.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
            merged = components(comps.select(F.col("comp").alias("set_id")).distinct(), between)
            merged = merged.select(F.col("set_id").alias("comp"), F.col("comp").alias("new"))
            comps = checkpointed(comps.join(merged, "comp").select("set_id", F.col("new").alias("comp")))
    return comps


def link_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, hash, n_shingles, component and component_id of each document."""
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", text_of("text").alias("text")).withColumn("hash", F.xxhash64("text"))
    sets = checkpointed(read_sets(texts, size))
    order = sketch_order(texts, size=size)
    keys = checkpointed(shared_prefixes(texts, order, parts, percent, size))

    # One text for each active class.
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash")).alias("first")
    active_ids = keys.select("set_id").distinct()
    chosen = sets.join(active_ids, "set_id").groupBy("set_id").agg(first)
    chosen = checkpointed(chosen.select("set_id", F.col("first.doc_id").alias("_id"), F.col("first.hash").alias("_hash")))
    n = chosen.count()
    wanted = F.broadcast(chosen) if n <= BROADCAST_ROWS else chosen
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    active = checkpointed(_active_sets(texts.join(wanted, same).select("set_id", "text"), size))
    if active.count() > n:  # equal rows, read by several tasks
        active = checkpointed(active.dropDuplicates(["set_id"]))

    clusters = _clusters(keys, active, percent)
    comps = checkpointed(_solved(active, checkpointed(clusters.where("small").select("set_id", "cluster")), percent))
    rest = checkpointed(clusters.where("not small").select("set_id"))
    n = rest.count()
    if n:
        some = keys.join(F.broadcast(rest) if n <= BROADCAST_ROWS else rest, "set_id")
        comps = comps.unionByName(_linked_at_keys(checkpointed(some), active, rest, percent))

    # A class that isn't active is a component of its own; an empty set is no class.
    named = sets.where("n_shingles > 0").join(comps, "set_id", "left").withColumn("component", F.coalesce("comp", "set_id"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    columns = ["doc_id", "hash", "n_shingles", "component", "component_id"]
    linked = named.join(smallest, "component").select(columns)
    alone = sets.where("n_shingles = 0").withColumn("component", F.lit(None).cast("binary"))
    return linked.unionByName(alone.withColumn("component_id", F.col("doc_id")).select(columns))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that of the smallest id, with all its columns; of rows
    that share that id and text one stays. Documents without words stay."""
    columns = docs.columns
    h, i, o, nth = (fresh(columns, x) for x in ("_hash", "_id", "_of", "_nth"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash")).alias("x")
    best = link_components(docs, percent).where("n_shingles > 0").groupBy("component").agg(first)
    best = checkpointed(best.select(F.col("x.doc_id").alias(i), F.col("x.hash").alias(o)).distinct())
    best = F.broadcast(best) if best.count() <= BROADCAST_ROWS else best  # two numbers a row
    rows = docs.withColumn(h, F.xxhash64(text_of("text")))
    kept = rows.join(best, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(o)))
    order = [c for c in columns if c not in ("doc_id", "text")] or [h]
    kept = kept.withColumn(nth, F.row_number().over(W.partitionBy("doc_id", h).orderBy(*order))).where(F.col(nth) == 1)
    empty = docs.where(~text_of("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(columns).unionByName(empty)
