"""Helpers of the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the places of the lists that are not null and hold finite numbers alone, and these as doubles."""
    there = np.flatnonzero(~vectors.is_null().to_numpy(zero_copy_only=False))
    offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    for n in np.unique(sizes[there]):
        at = there[sizes[there] == n]
        m = flat[offsets[at][:, None] + np.arange(n)]
        fine = np.isfinite(m).all(1)
        yield at[fine], m[fine]


def units(m: np.ndarray) -> np.ndarray:
    """Rows, none of which is zero, at length 1; scaled first, so that no square overflows or vanishes."""
    m = m.astype(np.float64)
    m = m / np.abs(m).max(1, keepdims=True, initial=0)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def stacked(raw: pa.Array | pa.ChunkedArray, dtype: str) -> np.ndarray:
    """The rows of a binary column, each the bytes of equally many numbers."""
    return np.frombuffer(b"".join(raw.to_pylist()), dtype).reshape(len(raw), -1)
