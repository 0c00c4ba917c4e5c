"""Operator 7, WARC archives read by boundary-chain verification.

Writing: a record for each page, one gzip member for each record, archives rolled at a size.
Of pages with equal payloads of MIN_SHARED bytes and more, that with the largest page_id is a
response; the others are revisit records that refer to it and carry no payload. Each task
attempt writes files of its own names through the shared file system and returns their names,
so files of lost or repeated attempts are never read.

Reading: archives are cut into byte ranges. A task finds every place in its range that looks
like a record (gzip magic that inflates to a WARC header, or the plain "WARC/1." of archives
that are not compressed), and follows each candidate's successors to the first offset outside
the range. Payloads may hold the same magic, so candidates prove nothing yet: starting at
offset 0 of each file, pointer jumping over these exits (doubling the jump each round) keeps
the entries that are reachable, and only records on the chain from a reachable entry count.

Defined results: null html is an empty payload; null urls are empty; null page_ids are kept
and never owners; rows that repeat the largest page_id of a group are all responses; other
columns are ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, discard, n_partitions, scratch, sized, written

#: Payloads of this size and more are stored once.
MIN_SHARED = 1000
#: Rows (a digest and an id, about 100 bytes) of the shared payloads that a join may broadcast.
OWNER_ROWS = 1 << 18
#: Bytes at which a task begins another archive, and bytes of a range to read.
ROLL_BYTES, RANGE_BYTES = 256 << 20, 4 << 20

RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_GZIP, _PLAIN = b"\x1f\x8b\x08", b"WARC/1."
_URN = "<urn:page:%s>"
_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def _open(uri: str):
    """pyarrow's file system and path for a path in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = re.sub(r"[\r\n]+", " ", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_URN % page_id}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_URN % refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _write(folder: str, compress: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        out, path, size, records, made = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{uuid.uuid4().hex}.warc" + ".gz" * compress
                    out, size, records = fs.open_output_stream(f"{root}/{path}", compression=None), 0, 0
                data = record_bytes(page_id, url, payload, digest, refers_to)
                data = _gzip(data) if compress else data
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= ROLL_BYTES:
                    out.close()
                    made.append((f"{folder}/{path}", size, records))
                    out = None
        if out is not None:
            out.close()
            made.append((f"{folder}/{path}", size, records))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["path", "bytes", "records"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, compress: bool = True) -> DataFrame:
    """Write pages (page_id, url, html); a row for each archive: path, bytes, records."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    shared = rows.where(F.col("n") >= MIN_SHARED).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("copies"))
    owners = written(shared.where("copies > 1").select("digest", "owner"), "warc-owners")
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    refers_to = F.when(F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner"))
    joined = rows.join(sized(owners, OWNER_ROWS), "digest", "left").select("page_id", "url", "payload", "digest", refers_to.alias("refers_to"))
    made = written(joined.mapInArrow(_write(folder, compress), "path string, bytes bigint, records bigint"), "warc-list")
    discard(owners)
    return made


class _Range:
    """Bytes of a file from start, read on as needed."""

    def __init__(self, uri: str, start: int, end: int):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        self.start = start
        self.file.seek(start)
        self.data = self.file.read(min(end, self.size) - start)

    def more(self) -> bool:
        extra = self.file.read(1 << 20)
        self.data += extra
        return bool(extra)

    def record(self, at: int) -> tuple[bytes, int] | None:
        """(record without compression, offset after it), or None if none starts there."""
        if self.data[at - self.start : at - self.start + 3] == _GZIP or self._peek(at, 3) == _GZIP:
            d, i, parts = zlib.decompressobj(31), at - self.start, []
            try:
                while not d.eof:
                    if i >= len(self.data) and not self.more():
                        return None
                    piece = self.data[i : i + (1 << 16)]
                    parts.append(d.decompress(piece))
                    i += len(piece)
                    if parts and not b"".join(parts[:2])[:7].startswith(_PLAIN[: len(b"".join(parts[:2])[:7])]):
                        return None
            except zlib.error:
                return None
            data = b"".join(parts)
            own = header(data)
            return (data, self.start + i - len(d.unused_data)) if own and own[1] + own[2] + 4 == len(data) else None
        if self._peek(at, 7) != _PLAIN:
            return None
        while True:
            own = header(self.data[at - self.start : at - self.start + (1 << 16)])
            if own:
                break
            if len(self.data) - (at - self.start) >= 1 << 16 or not self.more():
                return None
        end = at + own[1] + own[2] + 4
        if end > self.size:
            return None
        while len(self.data) < end - self.start and self.more():
            pass
        return bytes(self.data[at - self.start : end - self.start]), end

    def _peek(self, at: int, n: int) -> bytes:
        while len(self.data) < at - self.start + n and self.more():
            pass
        return bytes(self.data[at - self.start : at - self.start + n])


def header(data: bytes) -> tuple[dict[str, str], int, int] | None:
    """(fields, where the block begins, its length) of the record that data begins with."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(_PLAIN):
        return None
    fields = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    return (fields, end + 4, int(length)) if length.isdigit() else None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, uri, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = _Range(uri, start, end)
            data.more()  # magic may straddle the end of the range
            successor = {}
            for magic in (_GZIP, _PLAIN):
                at = data.data.find(magic)
                while 0 <= at < end - start:
                    if found := data.record(start + at):
                        successor[start + at] = found[1]
                    at = data.data.find(magic, at + 1)
            exits: dict[int, int | None] = {}
            for at in sorted(successor, reverse=True):
                to = successor[at]
                exits[at] = to if to >= min(end, data.size) else exits.get(to)
            if exits:
                rows = sorted(exits.items())
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([end] * len(rows), pa.int64())], names=["file", "at", "exit", "range_end"])


def reachable(candidates: DataFrame, rounds: int) -> DataFrame:
    """Entries (file, at, range_end) on the chain from offset 0, by pointer jumping over the exits.

    All joins are by shuffle: either side grows with the archives.
    """
    nodes = candidates.select("file", "at", "range_end")
    jump = candidates.where("exit is not null").select("file", "at", "exit")
    seen = candidates.where("at = 0").select("file", "at")
    with Scratch(candidates.sparkSession) as own:
        for k in range(rounds):
            onward = seen.join(jump.hint("merge"), ["file", "at"]).select("file", F.col("exit").alias("at"))
            seen = own.written(seen.unionByName(onward).distinct(), f"warc-seen-{k}")
            if k + 1 < rounds:
                further = jump.select("file", F.col("at").alias("exit"), F.col("exit").alias("next"))
                jump = own.written(jump.join(further.hint("merge"), ["file", "exit"]).select("file", "at", F.col("next").alias("exit")), f"warc-jump-{k}")
        return written(nodes.join(seen.hint("merge"), ["file", "at"], "left_semi"), "warc-entries")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, at, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data, rows = _Range(uri, at, end), []
            while at < min(end, data.size):
                found = data.record(at)
                if not found:
                    raise ValueError(f"{uri}: no record at {at}")
                record, at = found
                fields, begin, length = header(record)
                digest, page = fields["warc-payload-digest"].removeprefix("sha1:"), _PAGE.fullmatch(fields["warc-record-id"])
                refers_to = _PAGE.fullmatch(fields.get("warc-refers-to", ""))
                n = int(fields["x-payload-length"])
                if fields["warc-type"] == "response":
                    block = record[begin : begin + length]
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    if hashlib.sha1(payload).hexdigest() != digest or len(payload) != n:
                        raise ValueError(f"{uri}: the record before {at} is damaged")
                rows.append((int(page[1]) if page else None, n, digest, fields["warc-type"], int(refers_to[1]) if refers_to else None))
            if at < data.size and not data.record(at):
                raise ValueError(f"{uri}: no record at {at}")
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of archives (path, bytes) that this module wrote."""
    spark = archives.sparkSession
    largest = archives.agg(F.max("bytes")).first()[0] or 0
    n_ranges = -(-largest // range_bytes)
    files = written(archives.select(F.monotonically_increasing_id().alias("file"), "path", "bytes"), "warc-files")
    ranges = files.where("bytes > 0").select("file", "path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"))
    ranges = ranges.withColumn("end", F.col("start") + range_bytes)
    spread = max(spark.sparkContext.defaultParallelism, n_partitions(spark))
    found = written(ranges.repartition(spread).mapInArrow(_candidates, "file bigint, at bigint, exit bigint, range_end bigint"), "warc-candidates")
    entries = reachable(found, max(1, (n_ranges - 1).bit_length()) if n_ranges > 1 else 0)
    discard(found)
    # all that is read of a range begins at its first reachable entry
    first = entries.groupBy("file", "range_end").agg(F.min("at").alias("at")).join(files.select("file", "path").hint("merge"), "file").select("path", "at", "range_end")
    return first.repartition(spread).mapInArrow(_records, RECORDS)


def archive(pages: DataFrame) -> DataFrame:
    """Write pages and read them back: a row for each record."""
    return read_archives(write_archives(pages))
