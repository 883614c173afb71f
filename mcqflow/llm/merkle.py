"""Merkle manifest of a dataset: a persistent tree, copied along the paths that change.

A document's leaf is a digest of its fields. The leaves of a language, in the order of
doc_id, make a tree in which every eight nodes have a parent; the roots of the languages make
the tree above. Leaves are numbered in even buckets, not in one task. A task builds the tree
over an aligned block of 512 nodes (``BLOCK_LEVELS``), whose root is a node of the next round, until one is left.

Going down, each block learns the siblings that stand beside the path from its root to the
dataset's. A changed leaf makes a version of the tree: it copies its ancestors within its block
and then, beside those siblings, the ones above, all in the task that holds the leaf, so that
versions are spread as the leaves are. Whatever a path doesn't pass is shared with the tree as
it was.

Null fields are written ``-``. Null languages are a language, which comes first. Null ids come
first and are never changed. Rows that share an id are leaves of their own, in the order of
their digests, so repeated rows are interchangeable. Extra columns are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mcqflow.llm.common import ascii_lower, checkpointed
from mcqflow.operators.numbering import default_buckets, quantile_buckets, text_index

FANOUT = 8
BLOCK_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CHANGED_ONE_IN = 3

NODES = "tree string, at bigint, total bigint, digest binary"
_NODES = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("total", pa.int64()), ("digest", pa.binary())])
_SIBLINGS = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
PATHS = "tree string, at bigint, path array<struct<before: binary, after: binary>>, subroot binary"
_PATHS = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("path", _SIBLINGS), ("subroot", pa.binary())])
PROOFS = "doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string, copied array<string>"
_PROOFS = pa.schema(
    [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()),
     ("folded_root", pa.string()), ("copied", pa.list_(pa.string()))]
)


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of the values, each with its number of bytes."""

    def written(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(written, fields)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree, the leaf as it is and, where the document was tampered with, the changed one."""
    same = [F.col(f) for f in FIELDS]
    lowered = [ascii_lower(c) if f == "text" else c for f, c in zip(FIELDS, same, strict=True)]
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % CHANGED_ONE_IN == 0
    # A null language sorts before all others, an empty one included.
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    return docs.select("doc_id", tree.alias("tree"), leaf(same).alias("digest"), F.when(drawn, leaf(lowered)).alias("changed"))


def placed(found: DataFrame) -> DataFrame:
    """Add ``at``, the place in the tree by id, and ``total``, the number of its leaves."""
    rows = quantile_buckets(found, "doc_id", "bucket", default_buckets(found))
    tree = W.partitionBy("tree")
    earlier = tree.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("tree", "bucket").agg(F.count(F.lit(1)).alias("size"))
    offsets = sizes.select(
        "tree", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"), F.sum("size").over(tree).alias("total")
    )
    here = W.partitionBy("tree", "bucket").orderBy("doc_id", "digest", "changed")
    at = F.col("offset") + F.row_number().over(here) - 1
    return rows.join(offsets, ["tree", "bucket"]).withColumn("at", at).drop("bucket", "offset")


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels_of(total: int) -> int:
    """Levels above so many leaves."""
    levels = 0
    while total > 1:
        total, levels = -(-total // FANOUT), levels + 1
    return levels


class Block:
    """An aligned run of a tree's nodes and the levels above it, up to the block's root."""

    def __init__(self, table: pa.Table, height: int) -> None:
        at = table.column("at").to_numpy()
        self.table = table.take(pa.array(np.argsort(at, kind="stable")))
        self.tree = table.column("tree")[0].as_py()
        self.number = int(at.min()) // FANOUT**height
        self.total = table.column("total")[0].as_py()
        nodes = [d.hex() for d in self.table.column("digest").to_pylist()]
        self.levels = [nodes]
        self.runs: list[list[str]] = []
        for _ in range(min(height, levels_of(self.total))):
            runs = ["".join(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
            nodes = [_hash(r) for r in runs]
            self.runs.append(runs)
            self.levels.append(nodes)

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, i: int) -> list[tuple[str, str]]:
        """What stands before and after node i and its ancestors in this block."""
        out = []
        for runs in self.runs:
            run, k = runs[i // FANOUT], 64 * (i % FANOUT)
            out.append((run[:k], run[k + 64 :]))
            i //= FANOUT
        return out


def copied_path(digest: str, siblings: Sequence[tuple[str, str]]) -> list[str]:
    """The ancestors of a leaf that holds the digest, from its parent to the root."""
    out = []
    for before, after in siblings:
        digest = _hash(before + digest + after)
        out.append(digest)
    return out


def _parent(table: pa.Table, height: int) -> pa.Table:
    block = Block(table, height)
    total = -(-block.total // FANOUT**height)
    return pa.table([[block.tree], [block.number], [total], [bytes.fromhex(block.root)]], schema=_NODES)


def _above(paths: pa.Table) -> tuple[list[tuple[str, str]], bytes | None]:
    row = paths.to_pylist()[0]
    return [(s["before"].hex(), s["after"].hex()) for s in row["path"]], row["subroot"]


def _descend(nodes: pa.Table, paths: pa.Table, height: int) -> pa.Table:
    block, (above, subroot) = Block(nodes, height), _above(paths)
    n, rows = len(block.levels[0]), []
    for i in range(n):
        rows.append([{"before": bytes.fromhex(b), "after": bytes.fromhex(a)} for b, a in (*block.siblings(i), *above)])
    return pa.table(
        [pa.repeat(block.tree, n), block.table.column("at"), pa.array(rows, _SIBLINGS), pa.array([subroot] * n, pa.binary())], schema=_PATHS
    )


def _prove(nodes: pa.Table, paths: pa.Table, height: int) -> pa.Table:
    block, (above, subroot) = Block(nodes, height), _above(paths)
    shared = {len(block.runs): [("".join(b + a for b, a in above))]}
    for level in range(len(block.runs) - 1, 0, -1):
        # Of each node of the level, what a proof holds from there on; its children's share it.
        upper = shared[level + 1]
        shared[level] = []
        for i in range(len(block.levels[level])):
            run, k = block.runs[level][i // FANOUT], 64 * (i % FANOUT)
            shared[level].append(run[:k] + run[k + 64 :] + upper[i // FANOUT])
    proofs, folded, copied = [], [], []
    changed = block.table.column("changed").to_pylist()
    for i, digest in enumerate(block.levels[0]):
        siblings = [*block.siblings(i), *above]
        if block.runs:
            before, after = siblings[0]
            proofs.append(_hash(before + after + shared[1][i // FANOUT]))
        else:
            proofs.append(_hash(shared[0][0]))
        now = digest if changed[i] is None else changed[i].hex()
        path = copied_path(now, siblings)
        folded.append(path[-1] if path else now)
        copied.append(path if now != digest else [])
    n = len(proofs)
    columns = [block.table.column("doc_id"), block.levels[0], pa.repeat(subroot.hex(), n), proofs, folded, pa.array(copied, pa.list_(pa.string()))]
    return pa.table(columns, schema=_PROOFS)


def _blocked(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / FANOUT**height))


def _joined(nodes: DataFrame, paths: DataFrame, work: Callable, height: int, schema: str) -> DataFrame:
    """Each block of nodes beside the path from its root."""
    both = _blocked(nodes, height).groupBy("tree", "block").cogroup(paths.groupBy("tree", "at"))
    return both.applyInArrow(lambda n, p: work(n, p, height), schema)


def climb(nodes: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes that each round starts with, and the root of each tree."""
    largest, rounds = nodes.agg(F.max("total")).first()[0] or 0, []
    while largest > 1:
        rounds.append(nodes)
        blocks = _blocked(nodes.select("tree", "at", "total", "digest"), height).groupBy("tree", "block")
        nodes = checkpointed(blocks.applyInArrow(lambda table: _parent(table, height), NODES))
        largest = -(-largest // FANOUT**height)
    return rounds, nodes


def versions(docs: DataFrame, height: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and ``copied``: the nodes
    that the document's version has of its own, from the leaf's parent to the root. A block has
    ``height`` levels above its nodes."""
    found = checkpointed(placed(leaves(docs)))
    rounds, subroots = climb(found, height)
    trees = text_index(subroots.select(F.col("tree").alias("name"), F.col("digest").alias("subroot")), "name", "at")
    total = F.lit(subroots.count()).cast("bigint")
    top = checkpointed(trees.select("name", "subroot", F.lit("").alias("tree"), "at", total.alias("total"), F.col("subroot").alias("digest")))
    top_rounds, roots = climb(top, height)
    top_root = roots.first()
    root = F.lit(top_root["digest"].hex() if top_root else None).cast("string")
    none = F.array().cast("array<struct<before: binary, after: binary>>")
    paths = roots.select("tree", "at", none.alias("path"), F.lit(None).cast("binary").alias("subroot"))
    for nodes in reversed(top_rounds):
        paths = _joined(nodes, paths, _descend, height, PATHS)
    named = top.select("at", F.col("name"), F.col("subroot").alias("own"))
    paths = paths.join(named, "at").select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("at"), "path", F.col("own").alias("subroot"))
    for nodes in reversed(rounds[1:]):
        paths = _joined(nodes, paths, _descend, height, PATHS)
    proofs = _joined(found, paths, _prove, height, PROOFS)
    return proofs.select(
        "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"), "copied"
    )


def manifest(docs: DataFrame, height: int = BLOCK_LEVELS) -> DataFrame:
    """The rows of ``versions`` without the copied nodes."""
    return versions(docs, height).drop("copied")
