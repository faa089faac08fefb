"""Vectors of whole numbers in tasks: blocks of an Arrow column, products without rounding, the first rows of each group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import c

#: Whole numbers of doubles add without rounding up to here.
EXACT = 2.0**53


def usable(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, lambda x: bad(x.cast("double")))


def scaled(df: DataFrame, vec_id: str, vector: str, scale: int, *more: Column) -> DataFrame:
    """id, v: the usable rows with an id, components floor(scale * x) of x as double."""
    ints = F.transform(c(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    return df.where(usable(c(vector)) & c(vec_id).isNotNull()).select(c(vec_id).cast("long").alias("id"), ints.alias("v"), *more)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; components that a vector lacks are 0, those beyond the width meet none of a query."""
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    col = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    ok = col < width
    out[row[ok], col[ok]] = flat[ok]
    return out


def widest(lists: pa.Array) -> int:
    """Components of the longest vector, 1 at least."""
    return int(np.diff(lists.offsets.to_numpy()).max(initial=1))


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut to so many rows at most."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """q @ m.T of whole numbers, in 64-bit integers and without rounding. Sums that norms keep below 2**53 are doubles', those
    below 2**62 integers'; beyond that Python's integers count, and a score that leaves 64 bits is an error."""
    most = norms(q).max(initial=0) * norms(m).max(initial=0) * (1 + 1e-9)
    if most < EXACT:
        return (q @ m.T).astype(np.int64)
    if most < 2.0**62 and max(np.abs(q).max(initial=0), np.abs(m).max(initial=0)) < 2.0**62:
        return q.astype(np.int64) @ m.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    out = whole(q) @ whole(m).T
    if any(not -(1 << 63) <= x < 1 << 63 for x in out.ravel()):
        raise OverflowError("a score leaves the range of 64-bit integers")
    return out.astype(np.int64)


def firsts(k: int, groups: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Indices of the first k rows of each group by descending score, then ascending id."""
    order = np.lexsort((ids, -scores, groups))
    at = groups[order]
    return order[np.arange(len(at)) - np.searchsorted(at, at, "left") < k]
