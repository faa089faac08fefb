"""SimHash near-duplicates: fingerprints of shingles, and their links by anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import c, saved, scratch, settings
from trackweave.llm.components import components
from trackweave.llm.neardup import BATCHES

#: Bits of the three blocks of a fingerprint. Fingerprints that differ in 4 bits differ in 1 or none in a block.
BLOCKS = (22, 21, 21)
#: Differing bits of linked fingerprints at most, and of their closest block.
THRESHOLD = 4
NEAR = THRESHOLD // len(BLOCKS)
#: The binary Golay code: words of 23 bits, multiples of this polynomial. All words lie within 3 bits of exactly one of the 4096.
LENGTH, GENERATOR, RADIUS = 23, 0b101011100011, 3
ANCHORS = 1 << 12


@dataclass(frozen=True)
class SimHash:
    """shingle: words of one. homes, copies: fingerprints of an anchor compared in one block at most; an anchor with more
    has several. bundle: anchors dealt out together."""

    shingle: int = 4
    homes: int = 4096
    copies: int = 16384
    bundle: int = 24


def fingerprint(text: str | None, size: int) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 (seed 42); 0 without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    whole = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(size, len(found)) - 1
    starts, ends = starts[: len(found) - last].tolist(), ends[last:].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), 65536):
        pairs = zip(starts[at : at + 65536], ends[at : at + 65536], strict=True)
        h = np.array([xxhash.xxh64_intdigest(whole[a:b], 42) for a, b in pairs], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py(), size) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(prints)], names=["id", "print"])

    return run


def _remainders(words: np.ndarray) -> np.ndarray:
    """Of words as polynomials divided by the generator: equal for words that differ by an anchor."""
    out = words.copy()
    for bit in range(LENGTH - 1, 10, -1):
        out ^= np.where(out >> bit & 1, GENERATOR << (bit - 11), 0)
    return out


@lru_cache(maxsize=1)
def around() -> np.ndarray:
    """By remainder, the differences of a word to all anchors within RADIUS + NEAR, the nearest first (as many as any word has, -1
    after the last)."""
    one = np.array([1 << i for i in range(LENGTH)])
    levels = [np.array([0])]
    for _ in range(RADIUS + NEAR):
        more = (levels[-1][:, None] | one[None, :])[levels[-1][:, None] < one[None, :]]
        levels.append(more)
    found = np.concatenate(levels)  # by ascending weight
    at = _remainders(found)
    order = np.argsort(at, kind="stable")
    at, found = at[order], found[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at, "left")
    table = np.full((1 << 11, rank.max() + 1), -1)
    table[at, rank] = found
    return table


def anchors_of(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block: rows, anchors (numbered through all blocks), and whether the anchor is the row's nearest one."""
    table = around()
    out, at = [], 0
    for block, bits in enumerate(BLOCKS):
        words = (prints.astype(np.uint64) >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64)
        rest = _remainders(words)
        row, place = np.nonzero(table[rest] >= 0)
        anchor = (words[row] ^ table[rest[row], place]) >> 11  # a word of the code is told by its upper 12 bits
        out.append((row, anchor + block * ANCHORS, place == 0))
        at += bits
    return out


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """print, comp, anchor, home of (print, comp)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 20000):
            batch = whole.slice(at, 20000)
            prints, comp = (batch.column(i).to_numpy() for i in (0, 1))
            for row, anchor, home in anchors_of(prints.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(prints[row]), pa.array(comp[row]), pa.array(anchor.astype(np.int32)), pa.array(home)], names=["print", "comp", "anchor", "home"])


def spanning(homes: np.ndarray, home_labels: np.ndarray, copies: np.ndarray, copy_labels: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of labels that links between homes and copies connect, as few as reach all: once two labels are connected, no other
    link between them is looked for."""
    labels, at = np.unique(np.concatenate((home_labels, copy_labels)), return_inverse=True)
    mine, theirs = at[: len(homes)], at[len(homes) :]
    links = []
    main, rare = -1, np.arange(len(copies))
    for i in np.argsort(mine, kind="stable"):
        some = rare if mine[i] == main else slice(None)
        near = np.bitwise_count(copies[some] ^ homes[i]) <= THRESHOLD
        met = np.unique(theirs[some][near])
        met = met[met != mine[i]]
        if len(met):
            links += [(int(labels[mine[i]]), int(labels[x])) for x in met]
            joined = np.zeros(len(labels), bool)
            joined[met] = True
            to = mine[i]
            mine[joined[mine]], theirs[joined[theirs]] = to, to
        if len(met) or main < 0:
            main = np.bincount(theirs, minlength=1).argmax() if len(theirs) else 0
            rare = np.flatnonzero(theirs != main)
    return links


def _scan(key: tuple, table: pa.Table) -> pa.Table:
    """Links between homes and copies of the anchors of a group."""
    table = table.sort_by("anchor")
    anchor, home = table.column("anchor").to_numpy(), table.column("home").to_numpy()
    prints, comp = table.column("print").to_numpy().view(np.uint64), table.column("comp").to_numpy()
    ends = np.flatnonzero(np.diff(anchor)) + 1
    links = []
    for a, b in zip([0, *ends], [*ends, len(anchor)], strict=True):
        own = np.flatnonzero(home[a:b]) + a
        other = np.flatnonzero(~home[a:b]) + a
        if len(own) and len(other):
            links += spanning(prints[own], comp[own], prints[other], comp[other])
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})


def linked(prints: DataFrame, rules: SimHash = SimHash()) -> DataFrame:
    """print, comp for each of prints (print long, each once): those that links connect have the same comp, one of them.

    Each block of a fingerprint has one nearest anchor, its home, and goes to every anchor within the covering radius plus the bits by
    which close blocks differ. Two that differ in 4 bits differ by 1 or none in a block; so the home of each is among the anchors of the other, and they meet there.

    First every anchor's smallest fingerprint is compared with all others there. Only what is still in different components
    follows: rows outside an anchor's main component against all, those in it against the rest. Anchors with many rows
    have several blocks of homes and copies. A group gives as many links as it has components at most, so nothing
    grows with the square of a cluster.
    """
    schema = "print long, comp long, anchor int, home boolean"
    alone = prints.select("print", F.col("print").alias("comp"))
    placed = alone.mapInArrow(_placed, schema)
    # BLOCKS times ANCHORS rows, whatever the table's size.
    centers = saved(placed.where("home").groupBy("anchor").agg(F.min("print").alias("center")), "centers")
    star = placed.join(F.broadcast(centers), "anchor").where((F.col("print") != F.col("center")) & (F.bit_count(F.expr("print ^ center")) <= THRESHOLD))
    star = saved(star.select(F.col("center").alias("a"), F.col("print").alias("b")).distinct(), "star")
    first = saved(components(star).select(F.col("id").alias("c_print"), "component"), "first")
    known = prints.join(first, F.col("print") == F.col("c_print"), "left").select("print", F.coalesce("component", "print").alias("comp"))
    known = saved(known, "known")
    placed = saved(known.mapInArrow(_placed, schema), "placed")
    main = placed.where("comp <> print").groupBy("anchor", "comp").agg(F.count(F.lit(1)).alias("size"))
    main = main.groupBy("anchor").agg(F.max(F.struct("size", "comp")).alias("x")).select("anchor", F.col("x.comp").alias("main"))
    main = saved(main, "mains")
    placed = placed.join(F.broadcast(main), "anchor", "left").withColumn("rare", ~F.coalesce(F.col("comp") == F.col("main"), F.lit(False)))
    n = lambda x: F.count(F.when(F.expr(x), 1))
    counts = placed.groupBy("anchor").agg(n("home and rare").alias("h_rare"), n("home and not rare").alias("h_main"), n("true").alias("n_all"), n("rare").alias("n_rare"))
    pieces = lambda x, most: F.greatest(F.ceil(F.col(x) / most), F.lit(1)).cast("int")
    kinds = F.explode(
        F.array(
            F.struct(F.lit(False).alias("main_homes"), pieces("h_rare", rules.homes).alias("h"), pieces("n_all", rules.copies).alias("n")),
            F.struct(F.lit(True).alias("main_homes"), pieces("h_main", rules.homes).alias("h"), pieces("n_rare", rules.copies).alias("n")),
        )
    )
    # Two rows for each anchor at most; none where one side is missing.
    needed = F.expr("if(kind.main_homes, h_main > 0 and n_rare > 0, h_rare > 0 and n_all > 1)")
    plan = saved(counts.select("*", kinds.alias("kind")).where(needed).select("anchor", "kind.*"), "scans")
    dealt = placed.join(F.broadcast(plan), "anchor")
    side = lambda k: F.pmod(F.xxhash64("print", F.lit(k)), F.col("h" if k else "n")).cast("int")
    every = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1))
    of = ("anchor", "main_homes", "print", "comp")
    homes = dealt.where("home and rare <> main_homes").select(*of, F.lit(True).alias("home"), side(1).alias("i"), every("n").alias("j"))
    copies = dealt.where("rare or not main_homes").select(*of, F.lit(False).alias("home"), every("h").alias("i"), side(0).alias("j"))
    rows = homes.unionByName(copies).withColumn("bundle", (F.col("anchor") / rules.bundle).cast("int"))
    rest = rows.groupBy("bundle", "main_homes", "i", "j").applyInArrow(_scan, "a long, b long")
    rest = saved(rest.distinct(), "rest")
    joined = components(rest).withColumnRenamed("id", "j_comp").withColumnRenamed("component", "j_to")
    return known.join(joined, F.col("comp") == F.col("j_comp"), "left").select("print", F.coalesce("j_to", "comp").alias("comp"))


def simhash_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: SimHash = SimHash()) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest id that links reach) and kept
    (its own id is that).

    A-Z count as a-z; words are [^\\x20\\x09-\\x0D]+. Bits of the fingerprint go by the majority of the shingles' hashes, repeats
    included; fewer words than a shingle's are one shingle, without words (null and empty texts) the fingerprint is 0.
    Documents whose fingerprints differ in 4 bits or fewer are linked. Rows that repeat an id each count with their own text. A row
    without id links nothing: its component_id is that of rows with ids and its very fingerprint, else null; kept is
    false if there are any, else true. Other columns don't matter; an empty table gives no rows.

    Only distinct fingerprints are compared, so copies cost nothing (linked()).
    """
    with scratch(docs.sparkSession) as kept:
        found = docs.select(c(doc_id).alias("id"), c(text).alias("text")).mapInArrow(_fingerprints(rules.shingle), "id long, print long")
        with settings(docs.sparkSession, BATCHES):
            found = saved(found, "prints")
        classes = saved(found.where("id is not null").groupBy("print").agg(F.min("id").alias("rep")), "classes")
        named = saved(classes.join(linked(classes.select("print"), rules).withColumnRenamed("print", "n_print"), F.col("print") == F.col("n_print")), "named")
        least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
        named = saved(named.select("n_print", "comp").join(least, "comp").select("n_print", "component_id"), "labels")
        kept += [found, named]
    out = found.join(named, F.col("print") == F.col("n_print"), "left")
    digits = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    own = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept")
    return out.select(F.col("id").alias("doc_id"), digits, "component_id", own)
