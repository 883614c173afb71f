"""Vocabulary tables ``(token, id)`` and the two ways to look tokens up in one."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from mcqflow.functions.tokens import drop_special, resolve_pad_id, truncate
from mcqflow.operators.numbering import text_index
from mcqflow.sources.shared import shared_folder
from mcqflow.sources.sinks import write_prepared

# A run of letters, a run of digits, or one other visible character.
PIECE = r"\p{L}+|\p{N}+|[^\s\x0b\p{Z}\p{L}\p{N}]"

# Largest vocabulary an expression carries, and largest one a join broadcasts.
MAX_INLINE_TOKENS = 100_000
MAX_BROADCAST_TOKENS = 2_000_000
MAX_BROADCAST_BYTES = 64 << 20
# JSON readers bound the length of a key.
MAX_INLINE_TOKEN_CHARS = 10_000


def pieces(text: Column, pattern: str = PIECE) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def build_vocabulary(
    df: DataFrame, text: str, size: int, min_count: int = 1, pattern: str = PIECE
) -> DataFrame:
    """``(token, id, n)`` of the ``size`` most frequent tokens; ties go by token.

    Counting folds inside each task first, so a very common token costs one row
    per task. The counts are stored under the shared folder, so the corpus is read once.
    A histogram of the counts gives the least count that is kept and how
    many tokens are more frequent than each; a token's id is that and its position
    among the tokens of its count, so no task orders the whole table. Counting and two
    small jobs run when this is called.
    """
    counts = (
        df.select(F.explode(pieces(F.col(text), pattern)).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if min_count > 1:
        counts = counts.where(F.col("n") >= min_count)
    counts = write_prepared(counts, shared_folder(df.sparkSession) + "/counts", partition_by=())
    # Different counts are few: their number is at most the root of twice the number of words.
    more = W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    steps = counts.groupBy("n").agg(F.count(F.lit(1)).alias("_m")).select(
        "n", F.coalesce(F.sum("_m").over(more), F.lit(0)).alias("_above")
    ).where(F.col("_above") < size)
    least = steps.agg(F.min("n")).first()[0]
    if least is None:
        return counts.select("token", F.lit(0).alias("id"), "n").where(F.lit(False))
    kept = text_index(counts.where(F.col("n") >= least), "token", "_rank", ["n"])
    ids = (F.col("_above") + F.col("_rank")).cast("int")
    return kept.join(steps, "n").select("token", ids.alias("id"), "n").where(F.col("id") < size)


def special_ids(vocabulary: DataFrame, pad_id: int | None = None) -> DataFrame:
    """One row: ``size`` and the ids after the last token: unknown, end of sequence,
    and padding, which falls back to end of sequence."""
    after = F.coalesce(F.max("id") + 1, F.lit(0)).cast("int")
    pad = F.lit(pad_id).cast("int")
    return (
        vocabulary.agg(F.count(F.lit(1)).alias("size"), after.alias("unk_id"))
        .withColumn("eos_id", F.col("unk_id") + 1)
        .withColumn("pad_id", resolve_pad_id(pad, F.col("eos_id")))
    )


@dataclass(frozen=True)
class VocabularyCodec:
    """Codec over a vocabulary small enough to travel inside the plan.

    The tokens sit in an array of small maps indexed by hash, built once as a
    constant: a lookup is one array access and a short map search, with no
    explode, join or exchange. Decoding joins tokens by one space, since the
    pieces do not record the space between them.
    """

    table: str
    slots: int
    tokens: str
    unk_id: int
    eos_id: int
    pad: int | None = None
    pattern: str = PIECE

    @classmethod
    def load(
        cls,
        vocabulary: DataFrame,
        pad: int | None = None,
        pattern: str = PIECE,
        max_tokens: int = MAX_INLINE_TOKENS,
    ) -> VocabularyCodec:
        """Read a vocabulary whose size is checked against ``max_tokens`` first.
        Ids must run from 0; a larger vocabulary is an error: use the join."""
        slot = F.pmod(F.xxhash64("token"), F.lit(_slots(max_tokens)))
        rows = vocabulary.select("token", "id", slot.alias("slot")).limit(max_tokens + 1).collect()
        if len(rows) > max_tokens:
            raise ValueError(f"over {max_tokens} tokens: use encode_by_join")
        if any(len(r.token) > MAX_INLINE_TOKEN_CHARS for r in rows):
            raise ValueError("a token is too long to inline: use encode_by_join")
        ordered = sorted(rows, key=lambda r: r.id)
        if [r.id for r in ordered] != list(range(len(ordered))):
            raise ValueError("ids must be 0, 1, 2, ...")
        slots = _slots(len(rows))
        maps: list[dict[str, int]] = [{} for _ in range(slots)]
        for r in rows:
            # Slot counts are powers of two, so the wider slot folds down.
            maps[r.slot % slots][r.token] = r.id
        return cls(
            table=json.dumps(maps, ensure_ascii=False),
            slots=slots,
            tokens=json.dumps([r.token for r in ordered], ensure_ascii=False),
            unk_id=len(rows),
            eos_id=len(rows) + 1,
            pad=pad,
            pattern=pattern,
        )

    @property
    def pad_id(self) -> int:
        return self.eos_id if self.pad is None else self.pad

    @property
    def special_ids(self) -> tuple[int, ...]:
        return tuple(sorted({self.eos_id, self.pad_id}))

    def encode(self, text: Column, max_len: int | None = None) -> Column:
        table = _constant(self.table, "array<map<string,int>>")

        def lookup(piece: Column) -> Column:
            slot = F.pmod(F.xxhash64(piece), F.lit(self.slots)).cast("int")
            return F.coalesce(F.try_element_at(F.get(table, slot), piece), F.lit(self.unk_id))

        return F.transform(truncate(pieces(text, self.pattern), max_len), lookup)

    def count(self, text: Column, max_len: int | None = None) -> Column:
        n = F.regexp_count(text, F.lit(self.pattern))
        return n if max_len is None else F.least(n, F.lit(max_len))

    def decode(self, ids: Column) -> Column:
        """Tokens joined by a space; special and unknown ids are left out."""
        tokens = _constant(self.tokens, "array<string>")
        kept = drop_special(ids, tuple(sorted({*self.special_ids, self.unk_id})))
        return F.array_join(F.transform(kept, lambda i: F.get(tokens, i)), " ")


def _slots(tokens: int) -> int:
    return 1 << max(tokens - 1, 1).bit_length()


def _constant(text: str, schema: str) -> Column:
    """A constant the optimizer folds once; a bad text fails instead of being null."""
    return F.from_json(F.lit(text), schema, {"mode": "FAILFAST"})


def _fits(vocabulary: DataFrame, max_rows: int) -> bool:
    """Whether the table can be broadcast, by rows and by bytes, in one aggregate."""
    n, chars = vocabulary.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("token")), F.lit(0))).first()
    return n <= max_rows and chars + 16 * n <= MAX_BROADCAST_BYTES


def _salted(tokens: DataFrame, vocabulary: DataFrame, key: str, salts: int) -> DataFrame:
    """Look up ``key`` in a large vocabulary. Words that make up more than a thousandth of the
    counted ones are spread over ``salts`` copies; there are less than a thousand of them.
    Without counts every word is."""
    table = vocabulary.select("token", "id")
    spread = F.pmod("pos", F.lit(salts))
    copies = F.sequence(F.lit(0), F.lit(salts - 1))
    if "n" not in vocabulary.columns:
        salted = tokens.withColumn("salt", spread)
        return salted.join(table.withColumn("salt", F.explode(copies)), [key, "salt"], "left")
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(vocabulary.where(F.col("n") > total / 1000).select(F.col(key).alias("_heavy")))
    same = F.col(key) == F.col("_heavy")
    salted = tokens.join(heavy, same, "left").withColumn("salt", F.when(F.col("_heavy").isNotNull(), spread).otherwise(0))
    wide = table.join(heavy, same, "left")
    wide = wide.withColumn("salt", F.explode(F.when(F.col("_heavy").isNotNull(), copies).otherwise(F.array(F.lit(0)))))
    return salted.drop("_heavy").join(wide.drop("_heavy"), [key, "salt"], "left")


def _keyed(df: DataFrame, item: str) -> DataFrame:
    """Rows by item; rows without an item are kept apart by their place in the scan."""
    return _with_row(df, item).repartition(item, "_row")


def _with_row(df: DataFrame, item: str) -> DataFrame:
    row = F.when(F.col(item).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("bigint"))
    return df.withColumn("_row", row)


def _runs(found: DataFrame, item: str, value: str) -> DataFrame:
    """``(item, _row, start, run)``: values at following positions of an item as one row.

    Rows come in the order of the scan, so a text is a run or a few; in another order there were
    more runs, with the same values at the same positions.
    """
    rows = found.select(F.col(item).alias("item"), "_row", F.col("pos").alias("start"), F.col(value).alias("run"))
    schema = StructType([*rows.schema.fields[:3], StructField("run", ArrayType(rows.schema["run"].dataType))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, row, pos, values = batch.columns
            row, at = row.to_numpy(), pos.fill_null(-2).to_numpy(zero_copy_only=False)
            # An item is null only where its row number differs from all others.
            other = pc.not_equal(key.slice(0, n - 1), key.slice(1)).fill_null(False).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, other | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)])
            first = pa.array(cuts)
            # A row without a position stands for a text without values.
            known = at != -2
            ends = np.concatenate([[0], np.cumsum(known)])
            bounds = pa.array(ends[np.append(cuts, n)], pa.int32())
            run = pa.ListArray.from_arrays(bounds, values.filter(pa.array(known)))
            yield pa.RecordBatch.from_arrays([key.take(first), batch.column(1).take(first), pos.take(first), run], names=["item", "_row", "start", "run"])

    return rows.mapInArrow(fold, schema).withColumnRenamed("item", item)


def _gathered(runs: DataFrame, item: str) -> DataFrame:
    """The values of each item in the order of their positions, as ``t``; nulls among them stay."""
    each = F.collect_list(F.struct("start", "run"))
    many = runs.repartition(item, "_row").groupBy(item, "_row").agg(each.alias("r"))
    placed = F.flatten(
        F.transform("r", lambda r: F.transform(r["run"], lambda x, i: F.struct((r["start"] + i).alias("pos"), x.alias("value"))))
    )
    return many.select(item, F.when(F.size("r") == 1, F.col("r")[0]["run"]).otherwise(F.array_sort(placed)["value"]).alias("t"))


def _places(texts: DataFrame, item: str, tokens: Column) -> DataFrame:
    """``(item, _row, token, at)``: the different tokens of each text with their positions; a text
    without tokens has one row, without a token."""
    rows = texts.select(F.col(item).alias("item"), "_row", tokens.alias("tokens"))
    schema = StructType([*rows.schema.fields[:2], StructField("token", StringType()), StructField("at", ArrayType(IntegerType()))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            coded = lists.flatten().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(code)) - np.repeat(ends - sizes, sizes)
            both = owner * (len(coded.dictionary) + 1) + code
            order = np.argsort(both, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(both[order]) != 0]) if len(code) else np.zeros(0, dtype=np.int64)
            none = np.flatnonzero(sizes == 0)
            first = pa.array(np.concatenate([owner[order][cuts], none]))
            token = pa.array(np.concatenate([code[order][cuts], none * 0]), mask=np.arange(len(first)) >= len(cuts))
            bounds = np.concatenate([cuts, np.full(len(none) + 1, len(code))])
            at = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(pos[order], pa.int32()))
            columns = [batch.column(0).take(first), batch.column(1).take(first), coded.dictionary.take(token), at]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "_row", "token", "at"])

    return rows.mapInArrow(fold, schema).withColumnRenamed("item", item)


def encode_by_join(
    df: DataFrame,
    vocabulary: DataFrame,
    text: str,
    unk_id: int,
    item: str = "item_id",
    out: str = "input_ids",
    max_len: int | None = None,
    pattern: str = PIECE,
    max_broadcast: int = MAX_BROADCAST_TOKENS,
    salts: int = 64,
) -> DataFrame:
    """``(item, out)`` with tokens looked up by a join, for a vocabulary of any size.

    When the vocabulary fits a broadcast, which is checked by rows and bytes, the ids
    are put together where they are looked up and cross one exchange as arrays, by item;
    the tokens are neither exchanged nor sorted. For a larger vocabulary the texts are hashed by item
    before they are split, each different token of a text becomes a row with its positions, and these are
    joined on ``(token, salt)``; without the salt a common word would go to one task. Rows without
    an item stay apart.
    """
    kept = truncate(pieces(F.col(text), pattern), max_len)
    split = F.posexplode_outer(kept).alias("pos", "token")
    if _fits(vocabulary, max_broadcast):
        tokens = _with_row(df, item).select(item, "_row", split)
        found = tokens.join(F.broadcast(vocabulary.select("token", "id")), "token", "left")
        known = found.withColumn("id", F.coalesce("id", F.lit(unk_id)))
        return _gathered(_runs(known, item, "id"), item).select(item, F.col("t").alias(out))
    tokens = _places(_keyed(df, item), item, kept).withColumn("pos", F.xxhash64(item, "_row", F.get("at", F.lit(0))))
    found = _salted(tokens, vocabulary, "token", salts)
    places = F.struct("at", F.coalesce("id", F.lit(unk_id)).alias("id"))
    each = F.transform("r", lambda r: F.transform(r["at"], lambda x: F.struct(x.alias("pos"), r["id"].alias("id"))))
    gathered = found.groupBy(item, "_row").agg(F.collect_list(places).alias("r"))
    gathered = gathered.select(item, F.array_sort(F.flatten(each)).alias("t"))
    return gathered.select(item, F.col("t.id").alias(out))


def decode_by_join(
    df: DataFrame,
    vocabulary: DataFrame,
    ids: str = "input_ids",
    item: str = "item_id",
    out: str = "text",
    max_broadcast: int = MAX_BROADCAST_TOKENS,
    salts: int = 64,
) -> DataFrame:
    """``(item, out)``: the reverse lookup by join; ids not in the table are left out."""
    split = F.posexplode_outer(ids).alias("pos", "id")
    if _fits(vocabulary, max_broadcast):
        at = _with_row(df, item).select(item, "_row", split)
        found = at.join(F.broadcast(vocabulary.select("token", "id")), "id", "left")
        return _gathered(_runs(found, item, "token"), item).select(item, F.array_join("t", " ").alias(out))
    at = _keyed(df, item).select(item, "_row", split)
    found = _salted(at, vocabulary, "id", salts)
    kept = F.when(F.col("token").isNotNull(), F.struct("pos", "token"))
    gathered = found.groupBy(item, "_row").agg(F.array_sort(F.collect_list(kept)).alias("t"))
    return gathered.select(item, F.array_join("t.token", " ").alias(out))
