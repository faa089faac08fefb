"""Interaction of filters: what each removes, in every order, as products of histograms with incidence matrices."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import c, saved, words

FILTERS = "ABCDE"

ROWS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def incidence(n: int) -> tuple[list[tuple[int, ...]], np.ndarray, dict[str, np.ndarray]]:
    """All orders of n filters; the filter of each column (order, step); and for each outcome the matrix of 2**n masks of failed
    filters by n! * n columns that says whether a document of the mask meets it at that step."""
    orders = list(itertools.permutations(range(n)))
    mask = np.arange(1 << n)[:, None]
    own = np.array([f for order in orders for f in order])
    before = np.array([sum(1 << f for f in order[:step]) for order in orders for step in range(n)])
    fails, gone = (mask >> own[None, :]) & 1 == 1, mask & before[None, :] != 0
    outcomes = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique": mask == 1 << own[None, :]}
    return orders, own, {k: x.astype(np.int64) for k, x in outcomes.items()}


def _outcomes(names: str):
    """Per part with its counts by mask (of documents, good and toxic ones), a row for each order and step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(names)
        orders, own, by = incidence(n)
        written, steps = ["".join(names[f] for f in order) for order in orders for _ in range(n)], list(range(1, n + 1)) * len(orders)
        filters = (own[:, None] == np.arange(n)[None, :]).astype(np.int64)
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stacked = np.zeros((3, 1 << n), np.int64)
                for x in counts:
                    stacked[:, x["mask"]] = x["n"], x["good"], x["toxic"]
                removed = stacked @ by["removed"]
                shapley = removed[0] @ filters
                columns = [stacked[0] @ by["kept"], removed[0], stacked[0] @ by["redundant"], stacked[0] @ by["unique"], removed[1], removed[2], shapley[own]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(steps)), pa.array(written), pa.array(steps, pa.int32()), *map(pa.array, columns)], names=[x.split()[0] for x in ROWS.split(", ")]
                )

    return run


def interactions(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """ROWS, for each part and order of the filters and each step: documents of masks (part, mask, good, toxic) that are kept after
    the step, removed at it, redundant (they fail its filter, but an earlier one took them), fail its filter only, good and toxic
    ones removed at it, and what its filter removes over all orders. Bit i of a mask says that a document fails names[i]; a null
    part is the empty one, null flags are false. Parts without documents have no rows. At most eight filters.

    Documents are counted by part and mask where they are read; only these counts move, and one part's meet in one row.
    """
    if not 0 < len(names) <= 8 or len(set(names)) < len(names):
        raise ValueError("one to eight filters of different names")
    flag = lambda x: F.sum(F.when(F.col(x), 1).otherwise(0)).cast("long").alias(x)
    counts = masks.groupBy(F.coalesce("part", F.lit("")).alias("part"), "mask").agg(F.count(F.lit(1)).alias("n"), flag("good"), flag("toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    return parts.mapInArrow(_outcomes(names), ROWS)


def failed(text: Column) -> Column:
    """Bits 0 to 3 of the filters that look at a text alone; a null text is empty.

    A: under 200 words; B: under half of its words are distinct; C: over 3 in 100 code points are A-Z; D: a character of #$%&*|.
    """
    n_words = F.size(words(text)).cast("long")
    distinct = F.size(F.array_distinct(words(text))).cast("long")
    upper = (F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long")
    conditions = [n_words < 200, distinct * 100 < n_words * 50, upper * 100 > F.char_length(text).cast("long") * 3, text.rlike(r"[#$%&*|]")]
    return sum((x.cast("int") * (1 << i) for i, x in enumerate(conditions)), F.lit(0))


def filter_masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask, good, toxic: a row for each row of docs, by the filters A to E.

    E: the text is that of a row of a smaller id, anywhere in docs, by its SHA-256. Null texts are empty ones. A row without id has
    no copy before it and is none's; of rows that share the smallest id of a text none fails. labels (doc_id, quality, toxic) may have
    no row or several for a document: it is good if one says quality = 1, and toxic if one says toxic = 1. Other columns
    don't matter.

    Which rows don't fail E is looked up by id and text, so a text with many copies is no hot key.
    """
    whole = F.coalesce(c(text), F.lit(""))
    base = docs.select(c(doc_id).cast("long").alias("id"), c(part).cast("string").alias("part"), F.unhex(F.sha2(whole, 256)).alias("same"), failed(whole).alias("mask"))
    base = saved(base, "masks")
    first = base.where("id is not null").groupBy("same").agg(F.min("id").alias("f_id")).select(F.col("same").alias("f_same"), "f_id", F.lit(True).alias("is_first"))
    judged = base.join(first, (F.col("id") == F.col("f_id")) & (F.col("same") == F.col("f_same")), "left")
    said = labels.where(c("doc_id").isNotNull()).groupBy(c("doc_id").cast("long").alias("l_id"))
    said = said.agg(*[F.max(F.coalesce(c(x) == 1, F.lit(False))).alias(y) for x, y in (("quality", "good"), ("toxic", "toxic"))])
    judged = judged.join(said, F.col("id") == F.col("l_id"), "left")
    copy = F.col("id").isNotNull() & F.col("is_first").isNull()
    return judged.select("part", (F.col("mask") + copy.cast("int") * 16).alias("mask"), "good", "toxic")
