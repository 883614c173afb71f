"""Plug-in points for the user's own tokenizer and model.

A plug-in is given as a loader: a function without arguments that returns the
callable. It runs once per task, on the executor. Functions here that Spark
ships are nested, so an executor needs the loader's imports but not this package.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, IntegerType, StructType

from mcqflow.functions.tokens import drop_special, truncate
from mcqflow.operators.slices import slicer

Tokenizer = Callable[[list[str]], list[list[int]]]
Detokenizer = Callable[[list[list[int]]], list[str]]


@dataclass(frozen=True)
class PluginCodec:
    """A codec around a tokenizer: a list of texts to a list of id lists.

    An Arrow batch is given to it in slices of bounded size: only those become Python objects.
    """

    load: Callable[[], Tokenizer]
    eos_id: int
    pad: int | None = None
    load_decoder: Callable[[], Detokenizer] | None = None

    @property
    def pad_id(self) -> int:
        return self.eos_id if self.pad is None else self.pad

    @property
    def special_ids(self) -> tuple[int, ...]:
        return tuple(sorted({self.eos_id, self.pad_id}))

    def encode(self, text: Column, max_len: int | None = None) -> Column:
        load, slices = self.load, slicer()

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokenize = load()
            for texts in (part for batch in batches for part in slices(batch, pc.binary_length(batch))):
                known = texts.is_valid().to_numpy(zero_copy_only=False)
                made = tokenize(texts.drop_null().to_pylist())
                sizes = np.zeros(len(texts), dtype=np.int64)
                sizes[known] = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                flat = np.fromiter(itertools.chain.from_iterable(made), dtype=np.int32, count=int(ends[-1]))
                bounds = pa.array(ends, pa.int32(), mask=np.append(~known, False))
                yield pa.ListArray.from_arrays(bounds, pa.array(flat))

        # Declared non-deterministic so that the optimizer neither repeats it nor
        # pushes a filter on its result below it.
        tokenized = F.arrow_udf(run, ArrayType(IntegerType())).asNondeterministic()
        return truncate(tokenized(text), max_len)

    def count(self, text: Column, max_len: int | None = None) -> Column:
        return F.size(self.encode(text, max_len))

    def decode(self, ids: Column) -> Column:
        load = self.load_decoder
        if load is None:
            raise ValueError("this codec has no decoder")

        slices = slicer()

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            detokenize = load()
            for lists in (part for batch in batches for part in slices(batch, pc.list_value_length(batch))):
                known = lists.is_valid()
                some = lists.filter(known)
                flat = some.flatten().to_numpy(zero_copy_only=False)
                cuts = some.offsets.to_numpy() - (some.offsets[0].as_py() if len(some) else 0)
                texts = detokenize([flat[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])])
                # Place of each list among those that are not null.
                place = np.cumsum(known.to_numpy(zero_copy_only=False)) - 1
                yield pa.array(texts, pa.string()).take(pa.array(place, mask=~known.to_numpy(zero_copy_only=False)))

        return F.arrow_udf(run, "string")(drop_special(ids, self.special_ids))


def run_predictor(
    df: DataFrame,
    load: Callable[[], Callable[..., Sequence[Any]]],
    inputs: str,
    output: str,
    output_type: str | DataType = "string",
    batch_size: int = 4,
    **options: Any,
) -> DataFrame:
    """Add ``output``, made by the user's model from ``inputs`` (texts, or ids as arrays).

    The model is called as ``model(list_of_inputs, **options)`` on at most
    ``batch_size`` rows and returns one value per input: texts, numbers, or id
    lists as arrays. The other columns ride along untouched, so gold and subject
    need no join afterwards.
    """
    kind = output_type if isinstance(output_type, DataType) else _parse_type(output_type)
    schema = StructType([*df.schema.fields]).add(output, kind)
    item = to_arrow_type(kind.elementType) if isinstance(kind, ArrayType) else to_arrow_type(kind)
    listed = isinstance(kind, ArrayType)

    def unpack(column: pa.Array) -> list[Any]:
        if not isinstance(column, pa.ListArray):
            return column.to_pylist()
        bounds = column.offsets.to_numpy() - column.offsets[0].as_py()
        return np.split(column.flatten().to_numpy(zero_copy_only=False), bounds[1:-1])

    def pack(made: list[Any]) -> pa.Array:
        if not listed:
            return pa.array(made, item)
        bounds = np.cumsum([0, *map(len, made)]).astype(np.int32)
        flat = np.concatenate(made) if made else np.array([], dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat).cast(item))

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for chunk in chunks:
            values = unpack(chunk.column(inputs))
            made: list[Any] = []
            for start in range(0, chunk.num_rows, batch_size):
                made.extend(model(values[start : start + batch_size], **options))
            columns = [*chunk.columns, pack(made)]
            yield pa.RecordBatch.from_arrays(columns, [*chunk.schema.names, output])

    return df.mapInArrow(run, schema)


def _parse_type(text: str) -> DataType:
    return StructType.fromDDL(f"c {text}")["c"].dataType


def first_token_predictor(
    df: DataFrame,
    load: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]],
    pad_id: int,
    batch_size: int = 8,
) -> DataFrame:
    """Add ``pred_token`` to rows with ``input_ids`` and ``pos``; the ids themselves go,
    and so do rows without a position, which the model never sees.

    The model gets right-padded 2-D id and mask arrays of at most ``batch_size``
    rows and returns ids ``[rows, width]`` or scores ``[rows, width, tokens]``.
    Only the position asked for is reduced and leaves the task. The id lists are
    read as one flat array per chunk and laid out by offsets, never row by row.
    """
    kept = [f for f in df.schema.fields if f.name != "input_ids"]
    schema = StructType([*kept]).add("pred_token", IntegerType())
    picked = _picker()

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for chunk in chunks:
            chunk = chunk.filter(chunk.column("pos").is_valid())
            lists = chunk.column("input_ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            pos = chunk.column("pos").to_numpy(zero_copy_only=False)
            made: list[Any] = []
            for start in range(0, len(pos), batch_size):
                stop = min(start + batch_size, len(pos))
                sizes = np.diff(bounds[start : stop + 1])
                mask = np.arange(sizes.max()) < sizes[:, None]
                ids = np.full(mask.shape, pad_id, dtype=np.int64)
                ids[mask] = flat[bounds[start] : bounds[stop]]
                made.extend(picked(model(ids, mask.astype(np.int64)), pos[start:stop]))
            rest = chunk.drop_columns(["input_ids"])
            columns = [*rest.columns, pa.array(made, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*rest.schema.names, "pred_token"])

    return df.mapInArrow(run, schema)


def first_token_batch_predictor(
    batches: DataFrame,
    load: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]],
    carried: Sequence[str] = ("item_id", "pos"),
) -> DataFrame:
    """As ``first_token_predictor`` over collated batches, one row per batch: gives a row
    per item with the ``carried`` columns and ``pred_token``."""
    kept = [f for f in batches.schema.fields if f.name in carried]
    schema = StructType([*kept]).add("pred_token", ArrayType(IntegerType()))
    picked = _picker()

    def grid(rows: pa.ListScalar) -> np.ndarray:
        flat = rows.values.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(rows.values), -1).astype(np.int64)

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for chunk in chunks:
            made = []
            for i in range(chunk.num_rows):
                ids, mask = (grid(chunk.column(c)[i]) for c in ("input_ids", "attention_mask"))
                at = np.array([-1 if p is None else p for p in chunk.column("pos")[i].as_py()])
                made.append(picked(model(ids, mask), at))
            columns = [chunk.column(f.name) for f in kept]
            columns.append(pa.array(made, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "pred_token"])

    needed = batches.select(*(f.name for f in kept), "input_ids", "attention_mask")
    answered = needed.mapInArrow(run, schema)
    items = answered.select(F.explode(F.arrays_zip(*schema.names)).alias("r")).select("r.*")
    return items.where(F.col("pos").isNotNull())


def first_token_ordered_predictor(
    df: DataFrame,
    load: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]],
    pad_id: int,
) -> DataFrame:
    """As ``first_token_predictor`` over rows of exact batches: rows that share a ``batch_id`` and follow each
    other in a partition are given to the model together, those without a position included.
    The rows of a batch that an Arrow chunk cuts wait for the rest of it."""
    kept = [f for f in df.schema.fields if f.name not in ("input_ids", "batch_id")]
    schema = StructType([*kept]).add("pred_token", IntegerType())
    picked = _picker()

    def batches(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same rows, cut where a batch ends."""
        held: list[pa.RecordBatch] = []
        for chunk in chunks:
            ids = chunk.column("batch_id").to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            if held and held[0].column("batch_id")[0].as_py() != ids[0]:
                yield pa.concat_batches(held)
                held = []
            starts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
            for start, stop in zip(starts[:-1], starts[1:]):
                yield pa.concat_batches([*held, chunk.slice(start, stop - start)])
                held = []
            held.append(chunk.slice(starts[-1]))
        if held:
            yield pa.concat_batches(held)

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches(chunks):
            lists = batch.column("input_ids")
            sizes = np.diff(lists.offsets.to_numpy())
            mask = np.arange(sizes.max()) < sizes[:, None]
            ids = np.full(mask.shape, pad_id, dtype=np.int64)
            ids[mask] = lists.flatten().to_numpy(zero_copy_only=False)
            at = batch.column("pos").fill_null(-1).to_numpy(zero_copy_only=False)
            made = pa.array(picked(model(ids, mask.astype(np.int64)), at), pa.int32())
            columns = [*(batch.column(f.name) for f in kept), made]
            out = pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "pred_token"])
            yield out.filter(batch.column("pos").is_valid())

    return df.mapInArrow(run, schema)


def _picker() -> Callable[[np.ndarray, np.ndarray], list[Any]]:
    def picked(out: np.ndarray, pos: np.ndarray) -> list[Any]:
        """Prediction at each row's position; None outside the row."""
        inside = (pos >= 0) & (pos < out.shape[1])
        at = out[np.arange(len(pos)), np.where(inside, pos, 0)]
        ids = at.argmax(axis=-1) if at.ndim == 2 else at
        return [int(i) if ok else None for i, ok in zip(ids, inside)]

    return picked


def numeric_predictor(
    load: Callable[[], Callable[..., np.ndarray]],
    return_type: DataType,
    batch_size: int = 8,
    input_shapes: list[list[int] | None] | None = None,
) -> Callable[..., Column]:
    """A column function around a model of fixed-shape numeric inputs."""
    return predict_batch_udf(
        load, return_type=return_type, batch_size=batch_size, input_tensor_shapes=input_shapes
    )
