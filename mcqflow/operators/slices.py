"""Arrow arrays in slices of bounded size, for functions that run in Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes or ids that become Python objects at a time


def slicer(most: int = SLICE) -> Callable[[pa.Array, pa.Array], Iterator[pa.Array]]:
    """A function that cuts an array into slices of up to ``most``, or one value, by its values' sizes.
    Nested, so that executors don't need this package."""

    def slices(values: pa.Array, sizes: pa.Array) -> Iterator[pa.Array]:
        ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(values):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield values.slice(start, stop - start)
            start = stop

    return slices
