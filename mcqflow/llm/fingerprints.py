"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line; longer ones are cut where their content says so: after the first end
of a sentence beyond ``SHORTEST`` characters, without one after the first word there that ends
in a vowel. The rule is the same for texts of every length, and after an insertion the cuts
fall on the old places again. A sketch is a row of cells (count, XOR of digests, XOR of check digests); each
distinct paragraph digest is added to three of them. Two sketches of one size subtract cell
by cell, what both texts hold cancels, and peeling the cells with one digest left recovers
the digests in which the texts differ. If peeling gets stuck, the digests are spread over as
many larger sketches as they need; a part that gets stuck even there is compared
directly, so the result is exact.

A null text is an empty one; it has no paragraphs, and two empty texts are alike (1.0).
Equal texts have equal fingerprints. Null ids come last; rows that share an id follow each
other in the order of their texts. An empty table gives an empty table, extra columns are
ignored. The text is exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mcqflow.llm.common import let, span, text_of
from mcqflow.operators.numbering import default_buckets, quantile_buckets

CELLS = 24  # of a published fingerprint; a multiple of three
LARGER = 48
SPREAD = 24  # digests for each sketch of the second attempt
ROUNDS = 12
SHORTEST, LONGEST = 128, 640
PIECE = (
    rf"[^\n]{{{SHORTEST},{LONGEST}}}?[.!?](?=\s|$)|[^\n]{{{SHORTEST},{LONGEST}}}?[aeiou](?= )|[^\n]{{1,{LONGEST}}}"
)

_CHECK = 7


def paragraphs(text: Column) -> Column:
    """Distinct digests of a text's paragraphs."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _entry(key: Column, sign: Column, cells: int) -> Column:
    third = cells // 3
    places = [(F.pmod(F.xxhash64(key, F.lit(j)), F.lit(third)) + j * third).cast("int").alias(f"p{j}") for j in range(3)]
    return F.struct(sign.alias("n"), key.alias("key"), F.xxhash64(key, F.lit(_CHECK)).alias("check"), *places)


def _add(cell: Column, entry: Column, place: Column) -> Column:
    here = (entry["p0"] == place) | (entry["p1"] == place) | (entry["p2"] == place)
    added = F.struct(
        (cell["n"] + entry["n"]).alias("n"),
        cell["key"].bitwiseXOR(entry["key"]).alias("key"),
        cell["check"].bitwiseXOR(entry["check"]).alias("check"),
    )
    return F.when(here, added).otherwise(cell)


def sketch(digests: Column, cells: int = CELLS) -> Column:
    """The cells over an array of distinct digests."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check"))
    entries = F.transform(digests, lambda d: _entry(d, F.lit(1), cells))
    return let(
        entries,
        lambda e: F.transform(
            span(F.lit(0), F.lit(cells)), lambda place: F.aggregate(e, zero, lambda cell, x: _add(cell, x, place))
        ),
    )


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(
        left,
        right,
        lambda a, b: F.struct(
            (a["n"] - b["n"]).alias("n"),
            a["key"].bitwiseXOR(b["key"]).alias("key"),
            a["check"].bitwiseXOR(b["check"]).alias("check"),
        ),
    )


def peel(difference: Column, cells: int) -> Column:
    """The digests in which two texts differ, as (n, key) with n = 1 on the left and -1 on
    the right; null if some cells can't be resolved."""
    none = F.array().cast("array<struct<n:int,key:bigint>>")

    def resolve(state: Column, _: Column) -> Column:
        pure = F.array_distinct(
            F.transform(
                F.filter(
                    state["cells"],
                    lambda c: (F.abs(c["n"]) == 1) & (c["check"] == F.xxhash64(c["key"], F.lit(_CHECK))),
                ),
                lambda c: F.struct(c["n"].alias("n"), c["key"].alias("key")),
            )
        )

        def removed(found: Column) -> Column:
            entries = F.transform(found, lambda c: _entry(c["key"], -c["n"], cells))
            left = let(
                entries,
                lambda e: F.transform(
                    state["cells"], lambda cell, place: F.aggregate(e, cell, lambda c, x: _add(c, x, place))
                ),
            )
            new = F.struct(left.alias("cells"), F.concat(state["found"], found).alias("found"))
            return F.when(F.size(found) == 0, state).otherwise(new)

        return let(pure, removed)

    start = F.struct(difference.alias("cells"), none.alias("found"))
    empty = lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0)
    return F.aggregate(
        span(F.lit(0), F.lit(ROUNDS)),
        start,
        resolve,
        lambda s: F.when(F.forall(s["cells"], empty), s["found"]),
    )


def _differing(left: Column, right: Column, cells: int) -> Column:
    """Number of digests in one array only; null if a sketch of this size can't tell."""
    return F.when(
        F.abs(F.size(left) - F.size(right)) <= cells,
        let(peel(subtract(sketch(left, cells), sketch(right, cells)), cells), lambda found: _count(found)),
    )


def _count(found: Column) -> Column:
    return F.when(found.isNotNull(), F.size(found))


def _spread(left: Column, right: Column) -> Column:
    parts = F.ceil((F.size(left) + F.size(right)) / SPREAD).cast("int")

    def part(i: Column) -> Column:
        mine = lambda d: F.pmod(d, parts) == i
        return let(
            F.struct(F.filter(left, mine).alias("a"), F.filter(right, mine).alias("b")),
            lambda p: F.coalesce(
                _differing(p["a"], p["b"], LARGER),
                F.size(F.array_except(p["a"], p["b"])) + F.size(F.array_except(p["b"], p["a"])),
            ),
        )

    return F.aggregate(F.transform(span(F.lit(0), parts), part), F.lit(0), lambda a, x: a + x)


def likeness(left: Column, right: Column, left_sketch: Column, right_sketch: Column) -> Column:
    """Shared part of the paragraph digests of two texts, 0 to 1."""
    published = let(peel(subtract(left_sketch, right_sketch), CELLS), _count)
    differing = F.coalesce(
        F.when(F.abs(F.size(left) - F.size(right)) <= CELLS, published),
        _spread(left, right),
    )
    total = F.size(left) + F.size(right)
    return F.when(total == 0, F.lit(1.0)).otherwise(let(differing, lambda d: (total - d) / (total + d)))


def printed(cells: Column) -> Column:
    """A sketch as a string."""
    return F.array_join(
        F.transform(cells, lambda c: F.concat_ws(".", c["n"].cast("string"), F.hex(c["key"]), F.hex(c["check"]))), " "
    )


def with_next(docs: DataFrame, payload: list[str], key: str = "doc_id", tie: str = "text") -> DataFrame:
    """Each row with ``next``, the payload of the row that follows in descending order of the
    key; after the last comes the first.

    Rows go to buckets of the key, one window each. The first row of a bucket is also put
    behind the last one of the bucket above it, so no window has to look beyond its bucket.
    """
    ranked = docs.withColumn("_place", F.coalesce(F.col(key), F.lit(-(2**63))))
    dealt = quantile_buckets(ranked, "_place", "_bucket", default_buckets(docs))
    # One row for each bucket, and there are at most 65,536 of those.
    tops = sorted(tuple(r) for r in dealt.groupBy("_bucket").agg(F.max("_place")).collect())
    if not tops:
        return docs.withColumn("next", F.struct(*payload))
    after = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    lookup = docs.sparkSession.createDataFrame(after, "_place bigint, _to int")
    heads = (
        ranked.join(F.broadcast(lookup), "_place")
        .groupBy("_to")
        .agg(F.min_by(F.struct(*docs.columns, "_place"), F.col(tie)).alias("h"))
        .select("h.*", F.col("_to").alias("_bucket"), F.lit(1).alias("_copy"))
    )
    both = dealt.select(*docs.columns, "_place", "_bucket", F.lit(0).alias("_copy")).unionByName(heads)
    order = W.partitionBy("_bucket").orderBy("_copy", F.desc("_place"), tie)
    return (
        both.withColumn("next", F.lead(F.struct(*payload)).over(order))
        .where("_copy = 0")
        .drop("_copy", "_bucket", "_place")
    )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside that of an edited version and of the next document."""
    read = docs.select("doc_id", text_of("text").alias("text")).withColumn("digests", paragraphs(F.col("text")))
    n, part = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), n - part), F.substring(F.col("next.text"), F.lit(1), part)
    )
    rows = (
        with_next(read, ["text", "digests"])
        .select("doc_id", n.cast("long").alias("n_chars"), "digests", F.col("next.digests").alias("_nd"), edited.alias("_e"))
        .select("doc_id", "n_chars", "digests", "_nd", F.sha2("_e", 256).alias("edited_sha256"), paragraphs(F.col("_e")).alias("_ed"))
        .select("*", sketch(F.col("digests")).alias("_s"), sketch(F.col("_ed")).alias("_es"), sketch(F.col("_nd")).alias("_ns"))
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("_s")).alias("fingerprint"),
        printed(F.col("_es")).alias("edited_fingerprint"),
        likeness(F.col("digests"), F.col("_ed"), F.col("_s"), F.col("_es")).alias("near_edited"),
        likeness(F.col("digests"), F.col("_nd"), F.col("_s"), F.col("_ns")).alias("near_next"),
    )
