"""WARC archives: writing with revisit records, and reading that trusts only records on the chain from a file's start."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import c, forget, lookup, new_folder, saved

MAGIC, END = b"WARC/1.1\r\n", b"\r\n\r\n"
FOUND = "path string, split long, at long, next long, leaves long, page_id long, type string, digest string, refers_to long, body long, length long, payload_bytes long, steps long"


@dataclass(frozen=True)
class Archives:
    """file_bytes: a file takes no further record beyond it. split_bytes: bytes of a range. ranges: those that a task reads, about, where there are many. header_bytes: what it reads beyond
    at first; longer headers are read on.
    revisit_bytes: least payload that is worth a revisit. broadcast_groups: groups of copies broadcast at most."""

    file_bytes: int = 16 << 20
    split_bytes: int = 4 << 20
    ranges: int = 16
    header_bytes: int = 64 << 10
    revisit_bytes: int = 0
    broadcast_groups: int = 100_000


def _header(kind: str, page: int | None, url: str, digest: str, first: int | None, payload: int, length: int) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    lines += [f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {payload}"]
    if first is not None:
        lines += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response" if first is None else "Content-Type: application/octet-stream", f"Content-Length: {length}"]
    return MAGIC + "\r\n".join(lines).encode() + END


def _writer(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        stem = f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        out, path, size, records, files = None, "", 0, 0, []
        store.create_dir(root, recursive=True)
        for batch in batches:
            for page, url, payload, sha1, first in zip(*[batch.column(i) for i in range(5)], strict=True):
                if out is None:
                    path = f"{stem}-{len(files):05d}.warc"
                    out, size, records = store.open_output_stream(path), 0, 0
                first = first.as_py()
                data = payload.as_buffer() if payload.is_valid else b""
                n = len(data)
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                head = _header("response" if first is None else "revisit", page.as_py(), url.as_py() or "", digest, first, n, n if first is None else 0)
                size += out.write(head)
                if first is None:
                    size += out.write(data)
                size += out.write(END)
                records += 1
                if size >= most:
                    out.close()
                    files.append((path, size, records))
                    out = None
        if out is not None:
            out.close()
            files.append((path, size, records))
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*files, strict=True)], names=["path", "size", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", rules: Archives = Archives()) -> DataFrame:
    """Writes a record per row of pages below folder and returns the manifest (path, size, records) of the files that count.

    Of records with equal payloads (the html in UTF-8; null: empty) of revisit_bytes at least, that with the smallest page_id
    is a response, the others revisit it. Rows without a page_id are responses, as are rows that repeat the smallest one with its
    payload. A null url is empty; other columns play no part. No rows, no files. A task writes files of its own names, so
    that what a lost one leaves behind is in no manifest.
    """
    payload = F.coalesce(c(html), F.lit("")).cast("binary")
    base = pages.select(c(page_id).cast("long").alias("page"), c(url).alias("url"), payload.alias("payload"))
    base = base.withColumn("sha1", F.sha1("payload"))
    groups = base.where(F.octet_length("payload") >= rules.revisit_bytes).groupBy("sha1").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = saved(groups.where("n > 1").select("sha1", "first"), "groups")
    marked = lookup(base, groups, "sha1", "left", rules.broadcast_groups)
    marked = marked.select("page", "url", "payload", "sha1", F.when(F.col("page") > F.col("first"), F.col("first")).alias("first"))
    return saved(marked.mapInArrow(_writer(folder, rules.file_bytes), "path string, size long, records long"), "manifest")


def parse_header(data: bytes, at: int) -> dict | None:
    """The fields of the record that seems to start at data[at:], with `body`, its offset; None if it can be none."""
    end = data.find(END, at)
    if end < 0 or not data.startswith(MAGIC, at):
        return None
    out: dict = {}
    for line in data[at + len(MAGIC) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        out[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", out.get("content-length", "")):
        return None
    return out | {"body": end + len(END)}


def _number(s: str | None) -> int | None:
    return int(m[1]) if (m := re.search(r"(-?\d+)>?$", s or "")) else None


def candidates(data: bytes, start: int, end: int, path: str = "", more: Callable[[int], bytes] = lambda at: b"") -> list[tuple]:
    """A row of FOUND for whatever looks like a record and starts in the first end - start bytes of data, which lies at offset
    start of its file. `leaves` is where the chain from a candidate first lands outside of this range, after `steps` records.
    more(at) gives further bytes of the file from offset at on, none at its end; it is asked where data ends within a header."""
    rows, at = [], data.find(MAGIC)
    while 0 <= at < end - start:
        while data.find(END, at) < 0 and (further := more(start + len(data))):
            data += further
        if x := parse_header(data, at):
            length = int(x["content-length"])
            then = start + x["body"] + length + len(END)
            digest = x.get("warc-payload-digest", "").removeprefix("sha1:")
            rows.append([path, start, start + at, then, then, _number(x.get("warc-record-id")), x.get("warc-type"), digest])
            rows[-1] += [_number(x.get("warc-refers-to")), start + x["body"], length, _number(x.get("x-payload-length")), 1]
        at = data.find(MAGIC, at + 1)
    leaves: dict[int, int] = {}
    steps: dict[int, int] = {}
    for row in reversed(rows):
        row[4] = leaves[row[2]] = leaves.get(row[3], row[3])
        row[-1] = steps[row[2]] = 1 + steps.get(row[3], 0)
    return [tuple(row) for row in rows]


def _candidates(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in FOUND.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in FOUND.split(", ")]
        for batch in batches:
            for path, start, end, size in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                with store.open_input_file(path) as file:
                    file.seek(start)
                    data = file.read(min(size, end + max(most, len(MAGIC))) - start)

                    def more(at: int, file=file, start=start, size=size) -> bytes:
                        file.seek(at)
                        return file.read(min(size - at, max(most, at - start)))

                    rows = candidates(data, start, end, path, more)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def entries(found: DataFrame) -> DataFrame:
    """(path, split, at): the record by which the chain that starts at offset 0 of a file enters each range that it touches.

    Pointer jumping over the candidates' `leaves`: each round adds what the known entries point to and then lets every pointer
    skip twice as far, so the rounds grow with the logarithm of a file's ranges.
    """
    places = found.select("path", "split", "at")
    jump = saved(found.select("path", "at", F.col("leaves").alias("next")), "jump")
    known = saved(places.where("at = 0"), "known")
    while True:
        new = known.join(jump, ["path", "at"]).select("path", F.col("next").alias("at"))
        more = saved(known.union(new.join(places, ["path", "at"]).select(*known.columns)).distinct(), "known")
        grown = more.count() > known.count()
        forget(known)
        known = more
        if not grown:
            forget(jump)
            return known
        then = jump.select("path", F.col("at").alias("next"), F.col("next").alias("then"))
        further = saved(jump.join(then, ["path", "next"]).select("path", "at", F.col("then").alias("next")), "jump")
        forget(jump)
        jump = further


def _records(folder: str):
    """The records of a range on the chain from its entry, with sizes and digests of the payloads as read."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = {row["at"]: row for row in table.to_pylist()}
        at = table.column("entry")[0].as_py()
        store, _ = fs.FileSystem.from_uri(folder)
        out = []
        with store.open_input_file(key[0].as_py()) as file:
            while row := rows.get(at):
                n, digest = row["payload_bytes"], row["digest"]
                if row["type"] == "response":
                    file.seek(row["body"])
                    data = file.read(row["length"])
                    n, digest = len(data), base64.b32encode(hashlib.sha1(data).digest()).decode()
                out.append((row["page_id"], n, digest, row["type"], row["refers_to"]))
                at = row["next"]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.table([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    return run


def read_archives(spark, manifest: DataFrame, folder: str, rules: Archives = Archives()) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the files of the manifest.

    Tasks read ranges of files and emit whatever looks like a record and where the next one would be; only what lies on the
    chain from a file's start counts, so that a record's magic within a payload is none. Ranges bound what a task holds.
    Sizes and digests of responses are worked out anew from the payload, those of revisits are those of their header.
    Raises ValueError if the chain of a file has another number of records than its row of the manifest says.
    """
    ranges = manifest.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(rules.split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + rules.split_bytes, "size").alias("end"), "size")
    # Stated, since ranges take few bytes as rows, whatever they hold.
    n = manifest.agg(F.sum(F.ceil(F.col("size") / rules.split_bytes))).first()[0] or 1
    tasks = int(max(-(-n // rules.ranges), min(n, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    ranges = ranges.repartition(tasks, "path", "start")
    found = saved(ranges.mapInArrow(_candidates(folder, rules.header_bytes), FOUND), "candidates")
    start = entries(found).select("path", "split", F.col("at").alias("entry"))
    steps = found.select("path", F.col("at").alias("entry"), "steps").join(start, ["path", "entry"]).groupBy("path").agg(F.sum("steps").alias("read"))
    other = manifest.join(steps, "path", "left").where(F.coalesce("read", F.lit(0)) != F.col("records")).first()
    if other:
        raise ValueError(f"{other.path}: {other.read or 0} records on the chain from its start, {other.records} in the manifest")
    whole = found.join(start, ["path", "split"]).repartition(tasks, "path", "split")
    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return whole.groupBy("path", "split").applyInArrow(_records(folder), out)


def archive_folder(spark) -> str:
    return new_folder(spark, "warc")
