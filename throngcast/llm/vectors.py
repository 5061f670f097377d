"""What the operators on clip features share: usable vectors, their integer form, and hyperplane signatures."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def usable(features: str | Column) -> Column:
    """False for a NULL or empty vector and for one with a NULL, NaN or infinite component."""
    column = F.col(features) if isinstance(features, str) else features
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(column) > 0) & finite, F.lit(False))


def floored(features: str, scale: int) -> Column:
    """Each component x as floor(scale * x), x as double."""
    return F.transform(features, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def matrix(vectors: pa.Array, kind=np.float64) -> np.ndarray:
    """Rows of one length as an array."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1 if n else 0)


def by_length(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, rows) for each length of vector in the array."""
    sizes = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.empty(0, int)
    return [(at := np.flatnonzero(sizes == d), matrix(vectors.take(pa.array(at)))) for d in np.unique(sizes)]


def hyperplanes(dims: int, planes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, planes))


def signature(planes: int, tables: int = 1, seed: int = 0) -> Callable:
    """An Arrow function from vectors to `tables` numbers of `planes` bits: the sides of random hyperplanes they lie on."""
    weights = np.int64(1) << np.arange(planes, dtype=np.int64)

    def run(vectors: pa.Array) -> pa.Array:
        out = np.zeros((len(vectors), tables), np.int64)
        for at, rows in by_length(vectors):
            sides = rows @ hyperplanes(rows.shape[1], planes * tables, seed) > 0
            out[at] = sides.reshape(len(at), tables, planes) @ weights
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * tables), pa.array(out.ravel()))
    return run
