"""Near-duplicate documents: fast similarity sketches, banding, and links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import c, lookup, saved, scratch, settings, small
from trackweave.llm.components import components

U = np.uint64
EMPTY = U(0xFFFFFFFFFFFFFFFF)


#: Bytes of texts that a worker gets at once, about; a longer row comes alone.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 22)}


@dataclass(frozen=True)
class NearDup:
    """shingle: words of one. percent: similarity that links, in hundredths. rows, bands: of the sketch; a pair at
    0.8 shares no band with probability (1 - 0.8**rows)**bands, 5e-7 here. partners: pairs that a member of a bucket
    may bring outright; buckets with more are scanned in blocks. block: members of such a block.
    hopeless: pairs beyond the first
    comparison whose sketches agree in a smaller share are dropped; one at 0.8 does so with probability 3e-7.
    broadcast_ids: candidate ids, and bucket keys, broadcast at most. memo: words remembered by a worker at most."""

    shingle: int = 5
    percent: int = 80
    rows: int = 6
    bands: int = 48
    partners: int = 16
    block: int = 1024
    hopeless: float = 0.68
    broadcast_ids: int = 1_000_000
    memo: int = 300_000


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def shingle_hashes(text: str | None, size: int, memo: dict) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: `size` words each, or all words where there are fewer."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, U)
    h = np.fromiter(map(memo.__getitem__, found), U, len(found))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), U)
    with np.errstate(over="ignore"):
        for k in range(min(len(h), size)):
            out = mixed((out * U(0x9E3779B97F4A7C15)) ^ h[k : k + n])
    return np.unique(out)


def sketch(h: np.ndarray, size: int, keys: np.ndarray) -> np.ndarray:
    """The fast similarity sketch of a set: round i < size throws every element into a bin, round i >= size puts all
    into bin i - size; a bin keeps its smallest element of the first round that reaches it. So all bins fill, after
    few rounds if the set is not tiny, and two sets agree in a bin with the probability of their similarity."""
    out = np.full(size, EMPTY)
    at, each = 0, max(1, 1500 // len(h))
    while at < 2 * size:
        end = min(at + each, size if at < size else 2 * size)
        x = mixed(h[None, :] ^ keys[at:end, None])
        rounds = np.arange(at, end, dtype=U)[:, None]
        values = (rounds << U(53)) | (x >> U(11))
        if at < size:
            bins = ((x & U(0xFFFFFFFF)) * U(size)) >> U(32)
            np.minimum.at(out, bins.ravel().astype(np.int64), values.ravel())
        else:
            np.minimum(out[at - size : end - size], values.min(axis=1), out=out[at - size : end - size])
        if not (out == EMPTY).any():
            break
        at = end
    return out


def _sketched(size: int, rows: int, bands: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        keys = mixed(np.arange(1, 2 * rows * bands + 1, dtype=U))
        tags = mixed(np.arange(1, bands + 1, dtype=U) << U(32))
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n, digests, rowsets = [], [], []
                for text in batch.column(1):
                    h = shingle_hashes(text.as_py(), size, memo)
                    n.append(len(h))
                    digests.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                    if len(h):
                        rowsets.append(sketch(h, rows * bands, keys))
                    if len(memo) > most:
                        memo.clear()
                sets = np.array(rowsets, U).reshape(-1, bands, rows)
                k = np.broadcast_to(tags, (len(sets), bands))
                with np.errstate(over="ignore"):
                    for j in range(rows):
                        k = mixed((k * U(0x9E3779B97F4A7C15)) ^ sets[:, :, j])
                offsets = np.concatenate(([0], np.cumsum(np.array(n) > 0) * bands)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(k).ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), lists],
                    names=["id", "n", "digest", "keys"],
                )

    return run


def _sets(size: int, coords: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        keys = mixed(np.arange(1, 2 * coords + 1, dtype=U))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [shingle_hashes(text.as_py(), size, memo) for text in batch.column(1)]
                short = [mixed(sketch(h, coords, keys)).astype(np.uint8).tobytes() if len(h) else b"" for h in found]
                found = [h.view(np.int64) for h in found]
                if len(memo) > most:
                    memo.clear()
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lists, pa.array(short, pa.binary())], names=["id", "shingles", "short"])

    return run


def _hopeful(least: float):
    """Of pairs with a byte of each coordinate of both sketches, those that agree in the share at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                keep = pa.array((x == y).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _scan(percent: int):
    """Links between the members of two blocks, a's of the first one and other components of the second, by counting
    in the postings of the second block how many shingles each of its members shares with a."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, comp = table.column("rep").to_numpy(), table.column("comp").to_numpy()
        rare, first = table.column("rare").to_numpy(), table.column("side").to_numpy()
        sets = table.column("shingles").combine_chunks()
        flat, offsets = sets.flatten().to_numpy(), sets.offsets.to_numpy()
        offsets = offsets - offsets[0]
        sizes = np.diff(offsets)
        one = np.flatnonzero((first == 0) & rare)
        two = np.flatnonzero(first == 1)
        links: tuple[list, list] = ([], [])
        if len(one) and len(two):
            owner = np.repeat(np.arange(len(two)), sizes[two])
            values = np.concatenate([flat[offsets[i] : offsets[i + 1]] for i in two])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            for i in one:
                own = flat[offsets[i] : offsets[i + 1]]
                lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                counts = hi - lo
                total = int(counts.sum())
                if not total:
                    continue
                at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
                common = np.bincount(owner[at], minlength=len(two))
                ok = (100 * common >= percent * (sizes[i] + sizes[two] - common)) & (comp[two] != comp[i])
                links[0].extend([ids[i]] * int(ok.sum()))
                links[1].extend(ids[two[ok]])
        return pa.table({"a": pa.array(links[0], pa.int64()), "b": pa.array(links[1], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: NearDup = NearDup()) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id that links reach) and kept (its own id is that).

    A-Z count as a-z; words are [^\\x20\\x09-\\x0D]+. Documents whose sets have 100 * intersection >= percent * union are
    linked. Without words (null and empty texts) a document has an empty set and is linked with nothing. Rows that repeat an
    id with its text are alike; with another text each row's component is that of its text. A row without id is linked with
    rows of its set only: if one of them has an id, component_id is theirs and kept is false, else null and true. Documents of one set form a class at once; only classes are compared. Each bucket of equal
    band keys is compared with its smallest member first; only pairs that are then still in different components follow,
    outright where each member meets few, else by scanning blocks of members, so that no bucket needs all its pairs.
    """
    with scratch(docs.sparkSession) as kept:
        source = docs.select(c(doc_id).alias("id"), c(text).alias("text"))
        found = source.mapInArrow(_sketched(rules.shingle, rules.rows, rules.bands, rules.memo), "id long, n long, digest binary, keys array<long>")
        with settings(docs.sparkSession, BATCHES):
            found = saved(found, "sketches")
        classes = found.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"))
        classes = saved(classes, "classes")
        few = small(classes, rules.broadcast_ids)
        reps = found.join(F.broadcast(classes) if few else classes, (found["digest"] == classes["digest"]) & (found["id"] == classes["rep"]), "left_semi")
        members = reps.select(F.col("id").alias("rep"), "n", F.explode(F.array_distinct("keys")).alias("key"))
        buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("center")).where("m > 1").select("key", "center")
        buckets = saved(buckets, "buckets")
        held = saved(lookup(members, buckets, "key", "inner", rules.broadcast_ids), "held")
        sizes = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * rules.percent

        candidates = saved(held.select(F.col("rep").alias("id")).distinct(), "candidates")
        near = source.join(F.broadcast(candidates) if small(candidates, rules.broadcast_ids) else candidates, "id", "left_semi")
        with settings(docs.sparkSession, BATCHES):
            sets = saved(near.mapInArrow(_sets(rules.shingle, rules.rows * rules.bands, rules.memo), "id long, shingles array<long>, short binary"), "sets")

        def confirmed(pairs: DataFrame) -> DataFrame:
            x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
            y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
            both = pairs.join(x, "a").where(F.size("sa") > 0).join(y, "b")
            common = F.size(F.array_intersect("sa", "sb"))
            both = both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("total"))
            return both.where(F.col("common") * 100 >= (F.col("total") - F.col("common")) * rules.percent).select("a", "b")

        n_of = held.where("rep = center").select(F.col("rep").alias("center"), F.col("n").alias("cn")).distinct()
        star = held.where("rep <> center").select(F.col("center"), F.col("rep"), "n").distinct().join(n_of, "center")
        star = saved(star.where(sizes(F.col("n"), F.col("cn"))).select(F.col("center").alias("a"), F.col("rep").alias("b")), "star")
        links = saved(confirmed(star), "links")
        joined = components(links)

        def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
            return rows.join(labels, rows["rep"] == labels["id"], "left").select(rows["*"], F.coalesce("component", "rep").alias("comp"))

        parts = labelled(held.select("key", "rep", "n"), joined)
        split = parts.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
        split = split.groupBy("key").agg(
            F.sum("m").alias("m"), F.max(F.struct("m", "comp")).alias("most"), F.count(F.lit(1)).alias("parts")
        ).where("parts > 1")
        split = saved(split.select("key", "m", F.col("most.comp").alias("main"), (F.col("m") - F.col("most.m")).alias("rest")), "split")
        parts = saved(parts.join(split, "key"), "parts").withColumn("rare", F.col("comp") != F.col("main"))
        few = parts.where(F.col("rest") <= rules.partners)
        x = few.where("rare").select("key", F.col("rep").alias("x"), F.col("n").alias("xn"), F.col("comp").alias("xc"))
        y = few.select("key", F.col("rep").alias("y"), F.col("n").alias("yn"), F.col("comp").alias("yc"))
        pairs = x.join(y, "key").where((F.col("xc") != F.col("yc")) & sizes(F.col("xn"), F.col("yn")))
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = saved(pairs.join(star, ["a", "b"], "left_anti"), "pairs")
        drawn = pairs.join(sets.select(F.col("id").alias("a"), F.col("short").alias("short_a")), "a")
        drawn = drawn.join(sets.select(F.col("id").alias("b"), F.col("short").alias("short_b")), "b").select("a", "b", "short_a", "short_b")
        pairs = saved(drawn.mapInArrow(_hopeful(rules.hopeless), "a long, b long"), "hopeful")
        more = [confirmed(pairs)]
        many = parts.where(F.col("rest") > rules.partners)
        if not many.isEmpty():
            blocks = F.ceil(F.col("m") / rules.block).cast("int")
            many = many.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
            all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
            sides = [
                many.where("rare").select("key", "rep", "comp", "rare", F.lit(0).alias("side"), F.col("own").alias("i"), F.explode(all_blocks).alias("j")),
                many.select("key", "rep", "comp", "rare", F.lit(1).alias("side"), F.explode(all_blocks).alias("i"), F.col("own").alias("j")),
            ]
            rows = sides[0].unionByName(sides[1]).join(sets, F.col("rep") == F.col("id"))
            more.append(rows.groupBy("key", "i", "j").applyInArrow(_scan(rules.percent), "a long, b long"))
        rest = saved(more[0] if len(more) == 1 else more[0].union(more[1]), "more-links")
        if not rest.isEmpty():
            final = components(links.union(rest))
        else:
            final = joined
        named = saved(labelled(classes, final).select("digest", "comp"), "named")
        kept += [found, named]
    out = found.select("id", "n", "digest").join(named, "digest", "left")
    label = F.coalesce("comp", "id")
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), label.alias("component_id"), F.coalesce(F.col("id") == label, label.isNull()).alias("kept")
    )
