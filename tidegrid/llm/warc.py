"""WARC files, read in parallel by boundary-chain verification.

A file is cut into chunks that tasks read on their own. A task can't know whether a record magic that it sees begins a record or
stands in some payload, so for every candidate it emits the offset of the record's successor, which its Content-Length gives (in a compressed file, the end of its
gzip member). Records are exactly the candidates on the chain from offset 0. Within a chunk chains are contracted at once, each candidate pointing to the first offset on its chain that lies beyond the
chunk. Of these pointers only those count whose candidate another chunk points to: about one for each chunk, however many records it has. Pointer jumping from the file's start then doubles
the reach of these in each round. What remains is one entry for each chunk, from which
a second pass reads the chunk's records. Magic inside payloads is reached by no chain and is never a record.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.shared import in_arrow, stored

MAGIC, ZIPPED = b"WARC/1.", b"\x1f\x8b\x08"
END = b"\r\n\r\n"
#: Bytes of a file that a task reads at once; a record that begins in a chunk is read by it whole.
CHUNK = 8 << 20
#: Bytes that are read further where a header goes on behind a chunk.
MORE = 64 << 10


def write(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Response records of columns id, url and body (string) as WARC files, one for each partition.

    A null url is written as no target, a null body as an empty one. Records end in the line separator that
    Spark's text writer puts after each row, which also makes the files appear only once they are complete.
    """
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    body = F.concat(http, F.coalesce(F.col("body"), F.lit("")))
    target: Column = F.coalesce(F.concat(F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace("url", "[\\r\\n]", "")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:tidegrid:"), F.coalesce(F.col("id").cast("string"), F.lit("")), target,
        F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
    )
    records.select(header).write.option("lineSep", "\r\n\r\n").text(path)


def opened(path: str) -> pa.NativeFile:
    system, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return system.open_input_file(name)


class Span:
    """The bytes of a file from start to length, of which those seen so far are in data."""

    def __init__(self, file: pa.NativeFile, start: int, size: int, length: int) -> None:
        self.file, self.start, self.length = file, start, length
        file.seek(start)
        self.data = file.read(min(size, length - start))

    def more(self) -> bool:
        """Reads on, by as much again as there is at most; whether there was more."""
        at = self.start + len(self.data)
        if at >= self.length:
            return False
        self.file.seek(at)
        self.data += self.file.read(min(max(MORE, len(self.data)), self.length - at))
        return True

    def find_end(self, at: int) -> int:
        """Where the header that begins at a place ends; -1 if some line of it can't be a header's. Reads on as long as lines look like one."""
        line = at
        while True:
            stop = self.data.find(END[:2], line)
            if stop < 0:
                if not self.more():
                    return -1
                continue
            if stop == line:
                return stop - 2 if line > at else -1
            if line > at and self.data.find(b":", line, stop) < 0:
                return -1
            line = stop + 2


def fields_of(header: bytes) -> dict[str, str] | None:
    fields: dict[str, str] = {}
    for line in header.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    return fields if length.isascii() and length.isdigit() else None


def header_at(span: Span, at: int) -> tuple[dict[str, str], int, int] | None:
    """The fields of the record header at a place of the span, where its payload begins and how long that is; None if it is no header."""
    if not span.data.startswith(MAGIC, at):
        return None
    stop = span.find_end(at)
    fields = fields_of(span.data[at:stop]) if stop >= 0 else None
    return (fields, stop + len(END), int(fields["content-length"])) if fields else None


def member_at(span: Span, at: int, keep: bool) -> tuple[bytes, int] | None:
    """The content of the gzip member at a place of the span (its first bytes only, unless keep), and where it ends; None if it is none, or holds no record."""
    if not span.data.startswith(ZIPPED, at):
        return None
    machine, out, here = zlib.decompressobj(31), [], at
    while not machine.eof:
        if here >= len(span.data) and not span.more():
            return None
        part = span.data[here : here + MORE]
        here += len(part)
        try:
            got = machine.decompress(part)
        except zlib.error:
            return None
        if keep or sum(map(len, out)) < len(MAGIC):
            out.append(got)
            if sum(map(len, out)) >= len(MAGIC) and not b"".join(out).startswith(MAGIC):
                return None
    content = b"".join(out)
    return (content, here - len(machine.unused_data)) if content.startswith(MAGIC) else None


def contracted(span: Span, size: int) -> list[tuple[int, int]]:
    """Candidates that begin in the first size bytes of a span, and where each one's chain leaves those bytes; -1 if it breaks off."""
    found: list[tuple[int, int]] = []
    for magic in (MAGIC, ZIPPED):
        ahead = size + len(magic) - 1
        while len(span.data) < ahead and span.more():
            pass
        at = span.data.find(magic, 0, ahead)
        while 0 <= at < size:
            if magic == MAGIC:
                header = header_at(span, at)
                end = header[1] + header[2] + len(END) if header else None
            else:
                member = member_at(span, at, False)
                end = member[1] if member else None
            if end is not None:
                found.append((span.start + at, span.start + end))
            at = span.data.find(magic, at + 1, ahead)
    leaves: dict[int, int] = {}
    found.sort()
    for at, successor in reversed(found):
        leaves[at] = successor if successor >= span.start + size else leaves.get(successor, -1)
    return [(at, leaves[at]) for at, _ in found]


def chunks(spark: SparkSession, path: str, chunk: int) -> DataFrame:
    """file, start, size of each chunk of the WARC files below path, and the file's length."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*[!_]*").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    cut = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(chunk).cast("bigint"))).alias("start"))
    return cut.select("file", "start", F.least(F.lit(chunk).cast("bigint"), F.col("length") - F.col("start")).alias("size"), "length")


def entries(spark: SparkSession, cut: DataFrame, chunk: int) -> DataFrame:
    """file, start and entry: the offset at which the chain from the file's begin enters each chunk that it reaches."""

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, size, length in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(file) as f:
                    found = contracted(Span(f, start, size + MORE, length), size)
                if found:
                    at, to = (np.array(x, dtype=np.int64) for x in zip(*found))
                    # A chain that ends at the end of the file has come home; one that leads beyond it has broken off.
                    to = np.where(to < length, to, -1)
                    out = np.unique(to[to >= 0])
                    yield pa.record_batch([pa.array([file]), pa.array([start]), pa.array([at.tobytes()]), pa.array([to.tobytes()]), pa.array([out.tolist()], pa.list_(pa.int64()))], names=["file", "start", "at", "to", "out"])

    def followed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at, to, wanted in zip(batch.column(0).to_pylist(), *(batch.column(k).to_pylist() for k in (1, 2, 3))):
                at, to, wanted = np.frombuffer(at, dtype=np.int64), np.frombuffer(to, dtype=np.int64), np.unique(wanted)
                here = np.isin(at, wanted)
                if here.any():
                    yield pa.record_batch([pa.array([file] * int(here.sum())), pa.array(at[here]), pa.array(to[here])], names=["file", "at", "to"])

    links = stored(spark, in_arrow(cut, candidates, "file string, start bigint, at binary, to binary, out array<bigint>"))
    targets = links.select("file", F.explode("out").alias("at")).union(links.where("start = 0").select("file", F.lit(0).cast("bigint"))).distinct()
    wanted = targets.groupBy("file", (F.col("at") - F.col("at") % chunk).alias("start")).agg(F.collect_list("at").alias("wanted"))
    pointers = stored(spark, in_arrow(links.join(wanted, ["file", "start"]).select("file", "at", "to", "wanted"), followed, "file string, at bigint, to bigint"))
    reached = pointers.where("at = 0").select("file", "at")
    jumps = pointers.where("to >= 0")
    count = reached.count()
    while True:
        # Those reached so far jump; then each pointer is followed by the pointer at its target, which doubles its reach.
        ahead = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        both = stored(spark, reached.union(ahead.join(pointers, ["file", "at"], "left_semi")).distinct())
        total = both.count()
        if total == count:
            break
        reached, count = both, total
        jumps = stored(spark, jumps.join(jumps.select("file", F.col("at").alias("to"), F.col("to").alias("next")), ["file", "to"]).select("file", "at", F.col("next").alias("to")))
    return reached.select("file", (F.col("at") - F.col("at") % chunk).alias("start"), F.col("at").alias("entry"))


def read(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """The records of all WARC files below path: file, at (offset), type, record_id, url, date, body (payload after the HTTP header, if it has one, as binary) and whole.

    Files may be plain or compressed record by record (gzip); which, their bytes tell. Headers may have any length. A chain ends at the end of its file. Where it ends before, as no record
    stands there (the file is damaged), a row with that offset in at, whole false and nulls says so, and what lies behind isn't read: no chain tells what of it is payload. whole
    is false too for a last record that the file cuts off. Fields that a record lacks are null. A file that begins with no record, as one compressed as a whole may, has such a row alone if it has bytes;
    a folder without files gives no rows.
    """
    cut = chunks(spark, path, chunk)

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, size, length, entry in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(file) as f:
                    rows, held = [], 0
                    if entry is None:  # nothing leads here; a file's first chunk without a record is damaged from its begin
                        rows.append((file, 0, *[None] * 5, False))
                        entry = length
                    span = Span(f, entry, start + size - entry + MORE, length) if entry < length else None
                    at = 0
                    while span and entry + at < start + size:
                        packed = member_at(span, at, True)
                        inner = Span(pa.BufferReader(packed[0]), 0, len(packed[0]), len(packed[0])) if packed else span
                        header = header_at(inner, 0 if packed else at)
                        if not header:
                            rows.append((file, entry + at, *[None] * 5, False))
                            break
                        fields, begin, n = header
                        while len(inner.data) < begin + n and inner.more():
                            pass
                        body = inner.data[begin : begin + n]
                        whole = len(body) == n
                        if body.startswith(b"HTTP/") and (stop := body.find(END)) >= 0:
                            body = body[stop + len(END) :]
                        rows.append((file, entry + at, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), body, whole))
                        held += len(body)
                        at = packed[1] if packed else begin + n + len(END)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                        if whole and entry + at >= start + size and entry + at < length:
                            # The next record is another chunk's, unless none begins there.
                            ahead = Span(f, entry + at, MORE, length)
                            if not (member_at(ahead, 0, False) or header_at(ahead, 0)):
                                rows.append((file, entry + at, *[None] * 5, False))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    names = ["file", "at", "type", "record_id", "url", "date", "body", "whole"]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.bool_()]
    entered = entries(spark, cut, chunk)
    # A chain may enter a chunk only once, so the join has one row for each chunk.
    here = cut.join(entered, ["file", "start"], "left").where("entry IS NOT NULL OR start = 0").select("file", "start", "size", "length", "entry")
    return in_arrow(here, records, "file string, at bigint, type string, record_id string, url string, date string, body binary, whole boolean")


def pages_round_trip(spark: SparkSession, pages: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """page_id, url and html of pages, written as WARC files below path and read again."""
    write(pages.select(F.col("page_id").alias("id"), "url", F.col("html").alias("body")), path)
    got = read(spark, path, chunk)
    return got.where("whole").select(F.expr("try_cast(regexp_extract(record_id, '^<urn:tidegrid:(-?[0-9]+)>$', 1) AS BIGINT)").alias("page_id"), "url", F.decode("body", "utf-8").alias("html"))


ORACLE = "SELECT page_id, url, html FROM pages"
