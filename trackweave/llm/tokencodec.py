"""Token ids in compressed binary files: an adaptive context-mixing range coder over independent blocks.

The coder itself is IdCoder.java beside this file, which the compiler that Spark ships turns into two UDFs when a session first
asks for them: a range coder is a loop over single ids, for which neither Columns nor arrays of numpy have a fast form.
"""

from __future__ import annotations

import codecs
import io
import itertools
import json
import os
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.llm.common import c, new_folder, saved, settings

# Fixed values of the format: magic, and the head of a block.
MAGIC = b"TWTOK2\n\0"
BLOCK, HEAD = "<IIII", 16  # ids, bytes, crc32 of the ids, crc32 of the bytes

#: Names of the UDFs.
ENCODE, DECODE = "trackweave_encode_ids", "trackweave_decode_ids"

# White space as the splitting pattern of byte-level BPE knows it (Unicode), for RE2.
WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts that are not cut at their blanks: white space that is not one blank or one line feed between two words, or a mark below.
ODD = rf"[{WHITE}][{WHITE}]|^[{WHITE}]|[{WHITE}]$|[\t\x0b-\r\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x00-\x02]"
#: A letter and a sign of these behind it, between which a piece always ends.
SIGNS = r"(\pL)([.,%*#$&:;!?])"
#: Words that are one piece wherever they stand: a blank and letters that are letters in every version of Unicode.
PIECE = re.compile(" [A-Za-zÀ-ÖØ-öø-ɏ]+")
#: Marks: before what follows no blank, after a text's last word, and a text by its number.
FIRST, LAST, WHOLE = "\x00", "\x01", "\x02"


@dataclass(frozen=True)
class TokenFiles:
    """block: ids that are coded together, from fresh statistics. end_id: put after each document. slice_bytes: texts that are put
    through the tokenizer together, about. memo: words learnt last whose ids a worker remembers; up to as many older ones stay.
    batch_bytes: texts or blocks that a worker gets at once, about; a longer row comes alone."""

    block: int = 16384
    end_id: int = 2
    slice_bytes: int = 8 << 20
    memo: int = 300_000
    batch_bytes: int = 1 << 22

    def __post_init__(self) -> None:
        if not 0 <= self.end_id < 1 << 16 or not 0 < self.block <= 1 << 20:
            raise ValueError("end_id must be below 65536 and block at most 2**20")

    def batches(self) -> dict[str, str]:
        """Spark's settings for batch_bytes."""
        return {"spark.sql.execution.arrow.maxBytesPerBatch": str(self.batch_bytes)}


def register_coder(spark: SparkSession) -> None:
    """Defines ENCODE (ids as unsigned 16 bits, lowest byte first, to a block) and DECODE (back) in the session.

    The classes go into a jar in the shared folder, which Spark hands to the executors that are there or come later.
    """
    if spark.catalog.functionExists(ENCODE):
        return
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook((Path(__file__).parent / "IdCoder.java").read_text())
    jar = io.BytesIO()
    with zipfile.ZipFile(jar, "w") as z:
        for name, code in compiler.getBytecodes().items():
            z.writestr(name.replace(".", "/") + ".class", bytes(code))
    folder = new_folder(spark, "coder", keep=True)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/coder.jar") as out:
        out.write(jar.getvalue())
    spark.sql(f"ADD JAR '{folder}/coder.jar'")
    loader = spark._jsparkSession.sharedState().jarClassLoader()
    none = gateway.new_array(jvm.java.lang.Class, 0), gateway.new_array(jvm.java.lang.Object, 0)
    for name, kind in ((ENCODE, "IdEncoder"), (DECODE, "IdDecoder")):
        made = loader.loadClass(f"trackweave.llm.{kind}").getDeclaredConstructor(none[0]).newInstance(none[1])
        spark._jsparkSession.udf().register(name, made, spark._jsparkSession.parseDataType('"binary"'))


def byte_signs() -> list[str]:
    """The characters that byte-level BPE writes for the bytes 0 to 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = itertools.count(256)
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Words:
    """The ids of texts by the tokenizers library, each word once.

    With byte-level BPE, white space that follows a word always starts a new piece, as a sign behind a letter does, and no merge
    crosses the ends of a piece. So a text may be cut before each blank and line feed between words and between letters and
    signs, and the ids of the cuts concatenate to those of the text. Words that are one piece go to the library's model without its
    search for pieces, which takes as long as the merges.
    Every other text, and all texts of any other kind of tokenizer, go to the library whole.
    """

    def __init__(self, path: str, end_id: int, most: int) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.most, self.end = Tokenizer.from_file(path), most, np.array([end_id], "<u2").tobytes()
        if self.library.get_vocab_size(True) > 1 << 16:
            raise ValueError("needs ids below 65536")
        made = json.loads(self.library.to_str())
        split = made.get("pre_tokenizer") or {}
        level = (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True)
        post = (made.get("post_processor") or {"type": "ByteLevel"})["type"] == "ByteLevel"
        self.cuts = level and post and not made.get("normalizer") and made["model"]["type"] == "BPE" and not made["model"].get("dropout")
        added = [t["content"] for t in made.get("added_tokens", [])]
        self.odd = "|".join([ODD, *[r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E" for t in added]])
        feed = self.library.encode("\n", add_special_tokens=False).ids
        self.cuts = self.cuts and len(feed) == 1
        self.feed = feed[0] if self.cuts else -1
        vocab, signs = made["model"]["vocab"] if self.cuts else {}, byte_signs()
        self.signs = "".join(signs[:10] + ["\n"] + signs[11:])
        self.blank = np.zeros(1 << 16, bool)
        self.blank[[i for token, i in vocab.items() if token.startswith(signs[32])]] = True
        self.single = self.cuts and all(sign in vocab for sign in signs)
        self.pieces = Tokenizer(self.library.model)
        self.pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 200):
            out += [np.array(e.ids, "<u2").tobytes() for e in self.library.encode_batch_fast(texts[i : i + 200], add_special_tokens=False)]
        return out

    def _known(self, words: list[str]) -> list[bytes | None]:
        """What the memo has of words; what was older is young again."""
        out = list(map(self.memo.get, words))
        if self.older:
            for i, x in enumerate(out):
                if x is None and (x := self.older.get(words[i])) is not None:
                    out[i] = self.memo[words[i]] = x
        return out

    def _flat(self, library, words: list[str], after: list[int]) -> np.ndarray:
        """Ids of lines of words, after every line those given."""
        more, out = np.array(after, "<u2"), [np.empty(0, "<u2")]
        lines = ["\n".join(words[i : i + 50]) for i in range(0, len(words), 50)]
        for i in range(0, len(lines), 200):
            for e in library.encode_batch_fast(lines[i : i + 200], add_special_tokens=False):
                out += [np.array(e.ids, "<u2"), more]
        return np.concatenate(out)

    def _single(self, words: list[str]) -> list[bytes]:
        """Ids of words that are one piece each: the id that stands for their blank begins them, and no other does."""
        signs, _ = codecs.charmap_decode("\n".join(words).encode(), "strict", self.signs)
        flat = self._flat(self.pieces, signs.split("\n"), [])
        at = [*(np.flatnonzero(self.blank[flat]) * 2).tolist(), len(flat) * 2]
        if len(at) != len(words) + 1:
            raise AssertionError("the library parted words elsewhere than at their blanks")
        data = flat.tobytes()
        return [data[i:j] for i, j in itertools.pairwise(at)]

    def _several(self, words: list[str]) -> list[bytes]:
        """Ids of words of any pieces: line feeds part them."""
        flat = self._flat(self.library, words, [self.feed])
        ends = (np.flatnonzero(flat == self.feed) * 2).tolist()
        if len(ends) != len(words):
            raise AssertionError("the library joined words across a line feed")
        data = flat.tobytes()
        return [data[i:j] for i, j in zip([0, *(end + 2 for end in ends)], ends)]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, also into the memo."""
        plain = [w[1:] if w[0] in (FIRST, "\n") else " " + w for w in words]
        single: list[int] = []
        several: list[int] = []
        for i, x in enumerate(map(PIECE.fullmatch, plain)):
            (single if x and self.single else several).append(i)
        found = self._single([plain[i] for i in single]) + self._several([plain[i] for i in several])
        before = np.array([self.feed], "<u2").tobytes()
        out = {}
        for i, x in zip(single + several, found, strict=True):
            out[words[i]] = before + x if words[i][0] == "\n" else x
        if len(self.memo) + len(words) > self.most:
            self.memo, self.older = {}, self.memo
        if len(words) <= self.most:
            self.memo.update(out)
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, end ids included, one text after the other, and how many are of each."""
        if not self.cuts:
            found = [x + self.end for x in self._whole([t or "" for t in texts.to_pylist()])]
            return np.frombuffer(b"".join(found), "<u2"), np.array([len(x) // 2 for x in found], np.int64)
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd)
        whole = dict(zip(map(str, np.flatnonzero(odd.to_numpy(zero_copy_only=False))), self._whole(texts.filter(odd).to_pylist()), strict=True))
        if whole:
            texts = pc.replace_with_mask(texts, odd, pa.array([WHOLE + k for k in whole]))
        texts = pc.replace_substring_regex(texts, SIGNS, rf"\1 {FIRST}\2")
        marked = pc.binary_join_element_wise(FIRST, pc.replace_substring(texts, "\n", " \n"), " " + LAST, "")
        lists = pc.split_pattern(marked, " ")
        cuts = lists.flatten().dictionary_encode()
        words = cuts.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self._known(words)
        fixed = {FIRST: b"", LAST: self.end} | {FIRST + WHOLE + k: x for k, x in whole.items()}
        new = []
        for i, x in enumerate(found):
            if x is None and (x := fixed.get(words[i])) is not None:
                found[i] = x
            elif x is None:
                new.append(i)
        if new:
            learnt = self._learn([words[i] for i in new])
            for i in new:
                found[i] = learnt[words[i]]
        coded = pa.array(found, pa.large_binary())
        out = coded.take(cuts.indices)
        ends = np.frombuffer(out.buffers()[1], np.int64, len(out) + 1, out.offset * 8)
        at = ends[lists.offsets.to_numpy()]
        data = np.frombuffer(out.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        return data.view("<u2"), np.diff(at) // 2


@lru_cache(maxsize=2)
def _words(path: str, end_id: int, most: int) -> Words:
    """One for all tasks of a worker. The library would start a thread for each core of the machine, of which a task has one."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Words(path, end_id, most)


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with texts (column 1) of about so many bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _tokens(tokenizer: str, rules: TokenFiles):
    """The ids of a partition's documents in blocks, and at its end one row with the index: documents' ids and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer, rules.end_id, rules.memo)
        docs, lengths, left = [], [], np.empty(0, "<u2")
        row = lambda ids, index: pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(index, pa.binary())], names=["ids", "index"])
        for whole in batches:
            for batch in _slices(whole, rules.slice_bytes):
                ids, n = words.ids(batch.column(1))
                docs.append(pa.array(batch.column(0).to_pylist(), pa.int64()))  # a slice would hold on to all texts of its batch
                lengths.append(n)
                left = np.concatenate((left, ids))
                full = len(left) // rules.block
                cut = left[: full * rules.block].reshape(full, rules.block)
                if full:
                    yield row([x.tobytes() for x in cut], [None] * full)
                left = left[full * rules.block :]
            pa.default_memory_pool().release_unused()
        if docs:
            index = pa.table({"doc": pa.chunked_array(docs), "n": pa.array(np.concatenate(lengths))})
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, index.schema) as out:
                out.write_table(index)
            yield row([left.tobytes()] if len(left) else [], [None] * bool(len(left)))
            yield row([None], [zlib.compress(sink.getvalue(), 1)])

    return run


def _write(folder: str):
    """Blocks (and the index at last) of a partition into one file, and its row of the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        path, out, tokens = f"{root}/{part:06d}-{uuid.uuid4().hex[:8]}.tok", None, 0
        for batch in batches:
            for block, index in zip(batch.column(0), batch.column(1), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(path)
                    out.write(MAGIC)
                if block.is_valid:
                    data = block.as_buffer()
                    tokens += struct.unpack_from("<I", data)[0]
                    out.write(data)
                else:
                    out.write(bytes(HEAD) + index.as_py() + struct.pack("<I", len(index.as_py())))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([path]), pa.array([tokens], pa.int64())], names=["part", "path", "tokens"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", rules: TokenFiles = TokenFiles()) -> DataFrame:
    """Writes the ids of all documents in ascending order of doc_id and returns the manifest (part, path, tokens).

    Each task holds a range of ids; its file's number is the range's. The texts' ids are those of the library with
    add_special_tokens=False. Null texts are empty; null ids come first; rows that repeat an id follow each other in the order
    in which the table is read, and many of them are split between files. No rows, no files. Files of lost tasks are in no
    manifest. Other columns play no part. Ids of 65536 and more are refused (ValueError) before anything is written.
    """
    register_coder(docs.sparkSession)
    rows = docs.select(c(doc_id).cast("long").alias("id"), c(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    n = max(rows.rdd.getNumPartitions(), 1)
    dealt = rows.repartitionByRange(n, "id", "row").sortWithinPartitions("id", "row").select("id", "text")
    blocks = dealt.mapInArrow(_tokens(tokenizer, rules), "ids binary, index binary").select(F.expr(f"{ENCODE}(ids)").alias("block"), "index")
    files = blocks.mapInArrow(_write(folder), "part long, path string, tokens long")
    with settings(docs.sparkSession, rules.batches()):
        return saved(files.repartition(1), "manifest")  # one row a file: a table of one part, so the tasks that code open none


def _blocks(folder: str, together: int):
    """The blocks of each file, after a row with its index and where its ids start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.binary(), pa.binary()]
        out = lambda *rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["start", "index", "block"])
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = store.get_file_info(path).size
                with store.open_input_file(path) as file:
                    if file.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{path} is no token file")
                    file.seek(size - 4)
                    (n,) = struct.unpack("<I", file.read(4))
                    file.seek(size - 4 - n)
                    yield out((start, file.read(n), None))
                    file.seek(len(MAGIC))
                    found: list = []
                    while (head := file.read(HEAD)) != bytes(HEAD):
                        found.append((None, None, head + file.read(struct.unpack(BLOCK, head)[1])))
                        if len(found) == together:
                            yield out(*found)
                            found = []
                    if found:
                        yield out(*found)

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, start, n_tokens, ids_crc32 of each document, once its last id is there."""
    docs, n, ends, start, seen, done, crc = pa.array([], pa.int64()), np.empty(0, np.int64), np.empty(0, np.int64), 0, 0, 0, 0
    for batch in batches:
        for k in range(batch.num_rows):
            if batch.column(1)[k].is_valid:
                if done != len(ends):
                    raise ValueError("a file ends before its last document")
                start, table = batch.column(0)[k].as_py(), pa.ipc.open_stream(zlib.decompress(batch.column(1)[k].as_py())).read_all()
                docs, n = table.column("doc").combine_chunks(), table.column("n").to_numpy()
                ends, seen, done, crc = np.cumsum(n), 0, 0, 0
                continue
            data = memoryview(np.frombuffer(batch.column(2)[k].as_buffer(), "<u2").astype("<u4")).cast("B")
            size, first, at, crcs = len(data) // 4, done, 0, []
            upto = int(np.searchsorted(ends, seen + size, "right"))
            for end in ((ends[done:upto] - seen) * 4).tolist():
                crcs.append(zlib.crc32(data[at:end], crc))
                at, crc = end, 0
            crc, seen, done = zlib.crc32(data[at:], crc), seen + size, upto
            if crcs:
                own = slice(first, done)
                arrays = [docs[own], pa.array(start + ends[own] - n[own]), pa.array(n[own]), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32"])
    if done != len(ends):
        raise ValueError("a file ends before its last document")


def read_tokens(manifest: DataFrame, folder: str, rules: TokenFiles = TokenFiles()) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document, decoded from the files.

    Damaged blocks, by either checksum, and files that end early raise an error. The rows are saved here, as Spark deals out
    batches by the settings that hold when a query is run, not when it is made.
    """
    register_coder(manifest.sparkSession)
    # One row a file: a file's start is the sum of the tokens of the files before it.
    upto = F.sum("tokens").over(Window.orderBy("part"))
    n = max(1, manifest.count())
    files = manifest.select("path", (upto - F.col("tokens")).alias("start"), "part")
    files = files.repartitionByRange(n, "part").select("path", "start")
    blocks = files.mapInArrow(_blocks(folder, 64), "start long, index binary, block binary")
    ids = blocks.select("start", "index", F.expr(f"{DECODE}(block)").alias("ids"))
    found = ids.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
    with settings(manifest.sparkSession, rules.batches()):
        return saved(found.repartition(-(-n // 8) + 1), "documents")  # rows of 32 bytes: not a part for each file


def token_folder(spark) -> str:
    return new_folder(spark, "tokens")
