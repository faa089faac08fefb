"""Exact top-k by inner product over an impact-ordered index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import c, saved


@dataclass(frozen=True)
class TopK:
    """k: rows of each query. scale: components become floor(scale * x). queries: those broadcast at once at most;
    more are taken in further slices. block: vectors indexed together."""

    k: int = 5
    scale: int = 256
    queries: int = 8192
    block: int = 8192


def usable(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, lambda x: bad(x.cast("double")))


def segments(m: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The index of a block: posting segments by descending impact. Segment j holds the entries with magnitude in
    [4**(top - j), 4**(top - j + 1)), the last one those below 4. With each, per vector, the norm of what follows."""
    size = np.abs(m)
    top, out, done = 1, [], np.zeros(m.shape, bool)
    while top < size.max(initial=1):
        top *= 4
    while True:
        top //= 4
        take = ~done & ((size >= top) if top > 1 else True)
        done |= take
        rest = np.where(done, 0.0, m)
        out.append((np.where(take, m, 0.0), np.sqrt((rest * rest).sum(axis=1))))
        if top <= 1:
            return out


def best(ids: np.ndarray, index: list, m: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> tuple:
    """The k best vectors of the block for each query, own id aside, ties to the smaller id.

    Segments come in descending impact. After each, a vector's score lies within its norm of unprocessed entries times
    the query's norm. Vectors whose upper end is below the k-th best lower end can be no members: once the possible members
    are few, no further segment is read and they alone are scored exactly.
    """
    acc = np.zeros((len(q), len(ids)))
    norms = np.sqrt((q * q).sum(axis=1))
    own = qids[:, None] == ids[None, :]
    kk = min(k, len(ids))
    possible = ~own
    for j, (segment, rest) in enumerate(index):
        acc += q @ segment.T
        if j + 1 == len(index):
            break
        spread = norms[:, None] * rest[None, :] * (1 + 1e-9) + 1e-6
        low = np.where(own, -np.inf, acc - spread)
        floor = np.partition(low, len(ids) - kk, axis=1)[:, len(ids) - kk] if kk else np.full(len(q), -np.inf)
        possible = (acc + spread >= floor[:, None]) & ~own
        if possible.sum() <= 4 * kk * len(q):
            break
    if j + 1 == len(index):
        # All is read, so acc is exact; the floor keeps few.
        low = np.where(own, -np.inf, acc)
        floor = np.partition(low, len(ids) - kk, axis=1)[:, len(ids) - kk] if kk else np.full(len(q), -np.inf)
        possible = (low >= floor[:, None]) & ~own
    qi, vi = np.nonzero(possible)
    scores = np.einsum("ij,ij->i", q[qi], m[vi])
    order = np.lexsort((ids[vi], -scores, qi))
    qi, vi, scores = qi[order], vi[order], scores[order]
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi, "left")
    keep = rank < k
    return qids[qi[keep]], ids[vi[keep]], scores[keep].astype(np.int64)


def _search(shared, k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                ids, m = batch.column(0).to_numpy(), _matrix(batch.column(1), q.shape[1])
                index = segments(m)
                for b in range(0, len(qids), 256):
                    got = best(ids, index, m, qids[b : b + 256], q[b : b + 256], k)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=["query_id", "vec_id", "score"])

    return run


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; components that a vector lacks are 0, those beyond the width meet none of a query."""
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    col = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    ok = col < width
    out[row[ok], col[ok]] = flat[ok]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", rules: TopK = TopK()) -> DataFrame:
    """query_id, rank from 1, vec_id, score: for each row of queries its k best rows of vectors, those of its own id aside.

    Components become floor(scale * x) of x as double; the score is the integer inner product (exact while products sum
    below 2**53). Ties go to the smaller vec_id. Vectors that are null or hold null, NaN or infinite components, and null
    ids, take no part. Of different lengths, the common part counts. Every row of vectors is a candidate of its own, also
    where rows repeat an id; a query whose id is repeated is asked once, with the greatest of its vectors.
    The queries are taken in slices of bounded size, each broadcast over one pass of the vectors; every block of a task gives k rows
    a query.
    """
    spark = vectors.sparkSession

    def whole(df: DataFrame) -> DataFrame:
        ints = F.transform(c(vector), lambda x: F.floor(F.lit(float(rules.scale)) * x.cast("double")).cast("double"))
        return df.where(usable(c(vector)) & c(vec_id).isNotNull()).select(c(vec_id).cast("long").alias("id"), ints.alias("v"))

    asked = saved(whole(queries).groupBy("id").agg(F.max("v").alias("v")), "queries")
    n = asked.count()
    slices = max(1, -(-n // (rules.queries // 2)))
    parts = []
    for i in range(slices):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == i).toArrow()
        q = _matrix(part.column(1).combine_chunks(), max([1, *(len(x) for x in part.column(1))])) if part.num_rows else np.zeros((0, 1))
        shared = spark.sparkContext.broadcast((part.column(0).to_numpy(), q))
        parts.append(whole(vectors).mapInArrow(_search(shared, rules.k, rules.block), "query_id long, vec_id long, score long"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= rules.k).select("query_id", "rank", "vec_id", "score")
