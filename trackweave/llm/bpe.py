"""Byte-level BPE: ranked merges folded over the bytes of distinct words by higher-order functions."""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import c, let, new_folder, saved, scratch, settings

#: An element of the fold's state: 1 + id in the lowest bits, then where in the word it starts, then its rank with its right neighbour.
ID_BITS, AT_BITS = 17, 10
RANK_AT = ID_BITS + AT_BITS


@dataclass(frozen=True)
class Encoding:
    """long_word: words of more bytes are merged by a heap in Python, since a fold's cost grows with the square of the length.
    shards: files of the dictionary; None: one for every 2**18 words. batch, batch_bytes: texts that a worker gets at once, at most
    so many and of about so many bytes (a longer one comes alone)."""

    long_word: int = 64
    shards: int | None = None
    batch: int = 500
    batch_bytes: int = 1 << 22

    def __post_init__(self) -> None:
        if not 0 <= self.long_word <= 1 << AT_BITS:
            raise ValueError("long_word must be at most 1024")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token to rank of a rank file: base64 and number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def java_pattern(pattern: str) -> str:
    r"""The splitting pattern for Java, whose \s and \S know ASCII only."""
    return pattern.replace(r"[^\s", r"[^\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}").replace(r"\s", r"\p{IsWhite_Space}")


def pairs_of(ranks: dict[bytes, int]) -> dict[int, int]:
    """left * 65536 + right of every pair of tokens that merge, with the rank of the result."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                out[a << 16 | b] = rank
    return out


def rank_rows(pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """Starts and slots: the pair of left and right, if it merges, lies in slot starts[left + 1] + right + 1, as left + 1 in the bits
    from ID_BITS on and the rank + 1 below; unused slots are 0. Rows of pairs with one left are laid over each other so that no two
    pairs share a slot, longest rows first."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for pair, rank in pairs.items():
        rows.setdefault((pair >> 16) + 1, []).append(((pair & 65535) + 1, rank + 1))
    starts, slots, step = [0] * (1 + max(rows, default=0)), np.zeros(1 << 19, np.int64), 64
    used = slots.astype(bool)
    for left, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        rights, codes = np.array(sorted(row), np.int64).T
        at = left * 40503 % (1 << 18)  # rows are spread, so that the first places tried are mostly free
        while True:
            while at + step + int(rights[-1]) > len(slots):
                slots, used = (np.concatenate((x, np.zeros_like(x))) for x in (slots, used))
            tried = np.arange(at, at + step)
            for i in range(0, len(rights), 8):
                tried = tried[~used[tried[:, None] + rights[i : i + 8]].any(1)]
                if not len(tried):
                    break
            else:
                at = int(tried[0])
                break
            at += step
        starts[left] = at
        slots[at + rights], used[at + rights] = left << ID_BITS | codes, True
    return starts, slots[: np.flatnonzero(slots).max(initial=0) + 1].tolist()


@lru_cache(maxsize=4)
def tables(path: str) -> tuple[str, str, str]:
    """Of a rank file, as text: the starts and slots of rank_rows() and 1 + the ids of the 256 bytes."""
    ranks = read_ranks(path)
    if max(ranks.values()) >= 1 << 16 or any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("needs ranks below 65536 and one for every byte")
    starts, slots = rank_rows(pairs_of(ranks))
    return ",".join(map(str, starts)), ",".join(map(str, slots)), ",".join(str(1 + ranks[bytes([i])]) for i in range(256))


def literal(text: str) -> Column:
    """An array of comma-separated numbers, which the optimizer turns into one literal."""
    return F.split(F.lit(text), ",").cast("array<bigint>")


def merged(word: Column, path: str) -> Column:
    """The ids of a word of at most 2**AT_BITS bytes. The fold's state is one array of numbers, so that its minimum is the leftmost pair of
    the lowest rank; each step merges that. A rank is 1 more than the file's; what has no rank has a number above all ranks."""
    starts_text, slots_text, byte_codes = tables(path)
    bits = lambda x, mask: x.bitwiseAND(F.lit(mask).cast("long"))
    code = lambda x: bits(x, (1 << ID_BITS) - 1)
    none = 1 << ID_BITS

    def fold(starts: Column, slots: Column, codes: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            """Of a pair, shifted to its place. Slots of other pairs leave bits of the left ones behind, and so have numbers above all ranks."""
            found = F.get(slots, F.get(starts, a) + b).bitwiseXOR(F.shiftleft(a, ID_BITS))
            return F.shiftleft(F.coalesce(found, F.lit(none).cast("long")), RANK_AT)

        def step(state: Column, _: Column) -> Column:
            def merge(low: Column, p: Column, new: Column) -> Column:
                before, rest = F.get(state, p - 2), F.slice(state, p + 2, F.lit(1 << AT_BITS))
                left = rank(code(before), new).bitwiseOR(bits(before, (1 << RANK_AT) - 1))
                own = rank(new, code(F.get(state, p + 1))).bitwiseOR(bits(low, (1 << RANK_AT) - (1 << ID_BITS))).bitwiseOR(new)
                first = F.flatten(F.array(F.array(own), rest))
                return F.when(p == 1, first).otherwise(F.flatten(F.array(F.slice(state, 1, p - 2), F.array(left, own), rest)))

            def lowest(low: Column) -> Column:
                at = F.array_position(state, low).cast("int")
                return let(at, lambda p: let(F.shiftright(low, RANK_AT), lambda new: merge(low, p, new)))

            return let(F.array_min(state), lambda low: F.when(low >= F.lit(none << RANK_AT), state).otherwise(lowest(low)))

        first = F.transform(codes, lambda a, i: rank(a, F.get(codes, i + 1)).bitwiseOR(F.shiftleft(i.cast("long"), ID_BITS)).bitwiseOR(a))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), first, step, lambda s: F.transform(s, lambda x: (code(x) - 1).cast("int")))

    start = F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda x: F.get(literal(byte_codes), F.ascii(x)))
    return let(literal(starts_text), lambda starts: let(literal(slots_text), lambda slots: let(start, lambda codes: fold(starts, slots, codes))))


def merged_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids as merged(), for long words."""
    n = len(word)
    end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != e:
            continue
        alive[j], end[i], nxt[i] = False, end[j], nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def _long(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [merged_by_heap(w.encode(), shared.value) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def word_codes(words: DataFrame, path: str, shared, rules: Encoding = Encoding()) -> DataFrame:
    """word and ids of distinct words. shared: the broadcast ranks."""
    size = F.octet_length("word")
    short = words.where(size <= rules.long_word).select("word", merged(F.col("word"), path).alias("ids"))
    long = words.where(size > rules.long_word).select("word").mapInArrow(_long(shared), "word string, ids array<int>")
    return short.unionByName(long)


#: Spark writes plans down as text for its logs, several times a query, and would each time write out the rank table, which is
#: megabytes; so texts are cut meanwhile.
SHORT_PLANS = {"spark.sql.maxPlanStringLength": "20000"}


def _shard(folder: str):
    """Writes the shards of the dictionary, whose words come by shard and in the order of their hash, in a format that can be mapped into memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        pieces = (batch.filter(pc.equal(batch.column(0), int(k))) for batch in batches for k in np.unique(batch.column(0).to_numpy()))
        for k, own in itertools.groupby(pieces, lambda x: x.column(0)[0].as_py()):
            table = pa.Table.from_batches(list(own)).drop_columns("shard").combine_chunks()
            store.create_dir(root, recursive=True)
            file = f"{root}/{k:05d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.arrow"
            with store.open_output_stream(file) as out, pa.ipc.new_file(out, table.schema) as writer:
                writer.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([file])], names=["shard", "file"])

    return run


class Dictionary:
    """The shards, mapped into memory; a store that cannot be mapped is copied to the worker's temporary folder first."""

    def __init__(self, folder: str, files: list[str | None]) -> None:
        self.store, _ = fs.FileSystem.from_uri(folder)
        self.files, self.open = files, {}

    def shard(self, k: int) -> dict:
        if k not in self.open:
            path = self.files[k]
            if not isinstance(self.store, fs.LocalFileSystem):
                local = os.path.join(tempfile.mkdtemp(), f"{k}.arrow")
                fs.copy_files(path, local, source_filesystem=self.store)
                path = local
            table = pa.ipc.open_file(pa.memory_map(path)).read_all()
            self.open[k] = {x: table.column(x).chunk(0) for x in table.column_names}
        return self.open[k]

    def codes(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """Ids as text, how many, and bytes of the words, all of which the dictionary has."""
        plain = [x.encode() for x in words.to_pylist()]
        hashes = _hashes(plain)
        shard = _shards(hashes, len(self.files))
        order = np.argsort(shard, kind="stable")
        parts, counts = [], []
        for k in np.unique(shard):
            own = order[np.searchsorted(shard[order], k, "left") : np.searchsorted(shard[order], k, "right")]
            s = self.shard(int(k))
            at = pa.array(np.searchsorted(s["hash"].to_numpy(), hashes[own]))
            while not pc.all(same := pc.equal(s["word"].take(at), words.take(pa.array(own)))).as_py():  # equal hashes lie side by side
                at = pa.array(at.to_numpy() + ~same.to_numpy(zero_copy_only=False))
            parts.append((s["ids"].take(at), s["bytes"].take(at)))
            counts.append(s["n"].take(at).to_numpy())
        back = pa.array(np.argsort(order, kind="stable"))
        join = lambda i: pa.concat_arrays([p[i] for p in parts]).take(back)
        return join(0), np.concatenate(counts)[back.to_numpy()], join(1)


def _texts(folder: str, files: list[str | None], keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Dictionary(folder, files)
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten().dictionary_encode()
            if len(flat):
                ids, n, plain = book.codes(flat.dictionary)
                where = flat.indices.to_numpy()
                total = np.concatenate(([0], np.cumsum(n[where])))
                counts = total[offsets[1:]] - total[offsets[:-1]]
                spans = pa.array(offsets.astype(np.int32))
                texts = pc.binary_join(pa.ListArray.from_arrays(spans, ids.take(flat.indices)), ",")
                data = pc.binary_join(pa.ListArray.from_arrays(spans, plain.take(flat.indices)), b"")
            else:
                counts = np.zeros(len(lists), np.int64)
                texts, data = pa.array([""] * len(lists)), pa.array([b""] * len(lists))
            sha = lambda rows: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in rows])
            out = [batch.column(0), pa.array(counts, pa.int64()), sha(texts), sha(data)]
            yield pa.RecordBatch.from_arrays(out + ([texts] if keep_ids else []), names=["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    return run


def encode_texts(
    docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False, rules: Encoding = Encoding()
) -> DataFrame:
    """id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes decoded from them), and ids (that
    text) if keep_ids, per row of docs.

    Words are the matches of pattern. Every distinct word is merged once, by higher-order functions over the rank table as a literal, and
    its ids are decoded once; the codes lie in a dictionary in the shared folder, sharded by hash, which the workers map into memory, so that
    memory depends on a batch of texts only, of stated bytes. Null and empty texts have no ids. Repeated rows are encoded alike; no rows, no rows.
    """
    spark = docs.sparkSession
    pieces = F.regexp_extract_all(F.coalesce(c(text), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))
    batches = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rules.batch), "spark.sql.execution.arrow.maxBytesPerBatch": str(rules.batch_bytes)}
    with scratch(spark) as kept:
        words = saved(docs.select(F.explode(pieces).alias("word")).distinct(), "words")
        n = rules.shards or max(1, -(-words.count() >> 18))
        shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
        with settings(spark, SHORT_PLANS):
            codes = saved(word_codes(words, ranks_path, shared, rules), "codes")
        folder = new_folder(spark, "dictionary")
        entries = codes.select("word", "ids").mapInArrow(_entries(n, shared), "shard long, hash long, word string, ids string, n long, bytes binary")
        entries = entries.repartition(n, "shard").sortWithinPartitions("shard", "hash")
        files: list[str | None] = [None] * n
        for row in entries.mapInArrow(_shard(folder), "shard long, file string").collect():  # one row a shard
            files[row["shard"]] = row["file"]
        given = docs.select(c(doc_id).cast("long").alias("id"), pieces.alias("pieces"))
        kinds = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string" * keep_ids
        with settings(spark, batches):
            out = saved(given.mapInArrow(_texts(folder, files, keep_ids), kinds), "encoded")
        kept.append(out)
    return out


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _shards(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes.view(np.uint64) % np.uint64(n)).astype(np.int64)


def _entries(n: int, shared):
    """Entries of the dictionary: shard, hash, word, ids as text, how many, and the bytes decoded from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [b""] * (max(shared.value.values()) + 1)
        for token, rank in shared.value.items():
            tokens[rank] = token
        bytes_of = pa.array(tokens, pa.binary())
        for batch in batches:
            words, lists = batch.columns
            hashes = _hashes([w.encode() for w in words.to_pylist()])
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat, spans = lists.flatten(), pa.array(offsets.astype(np.int32))
            ids = pc.binary_join(pa.ListArray.from_arrays(spans, flat.cast(pa.string())), ",")
            plain = pc.binary_join(pa.ListArray.from_arrays(spans, bytes_of.take(flat)), b"")
            out = [pa.array(_shards(hashes, n)), pa.array(hashes), words, ids, pa.array(np.diff(offsets).astype(np.int64)), plain]
            yield pa.RecordBatch.from_arrays(out, names=["shard", "hash", "word", "ids", "n", "bytes"])

    return run
