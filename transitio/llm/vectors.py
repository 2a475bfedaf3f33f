"""Vectors as blocks: packing rows into binary matrices, in streams of bounded memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(lists: pa.Array, dtype=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """(rows, dims) of a list array of equal lengths without nulls inside."""
    lists = lists.cast(pa.large_list(pa.float64()))
    n = len(lists)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(dtype, copy=False)


def runs(*columns: pa.Array) -> list[tuple[int, int]]:
    """Bounds of the runs of equal rows in already sorted columns."""
    n = len(columns[0])
    if not n:
        return []
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in columns:
        if n > 1:
            new[1:] |= ~np.asarray(pc.fill_null(pc.equal(c.slice(1), c.slice(0, n - 1)), False).to_numpy(zero_copy_only=False))
    at = np.append(np.flatnonzero(new), n)
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


#: A vector that takes part: no null, no component that is null or not finite.
FINITE = "{0} IS NOT NULL AND size({0}) > 0 AND forall({0}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"
