"""Files read by ranges: prefixes of blobs, samples of containers, members of archives.

Spark lists the files; what is wanted of them is a table of ranges, dealt over tasks like any other. A task opens a file
by Arrow and reads the bytes of its own ranges, neighbouring ones at once, so that no file is ever held whole and none is
too large. Paths must be of a store that Arrow opens (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZSTD = b"\x28\xb5\x2f\xfd"
#: Ranges are read at once while the bytes between them are no more than GAP and all of them no more than RUN.
GAP, RUN = 1 << 16, 8 << 20
#: Bytes and rows of one Arrow batch that a task hands on, about.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 256
#: Longest value that a cell holds.
LONGEST = (1 << 31) - 1024
#: Stored and deflated members are read as streams; the other methods by the archive library.
STORED, DEFLATED = 0, 8
BEYOND, TOO_LONG = "range: beyond the file", "range: longer than a cell"


def _located(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")


def opened(path: str) -> pa.NativeFile:
    system, name = _located(path)
    return system.open_input_file(name)


class Written:
    """A file that takes its name when it is whole; what a failed attempt leaves has another name."""

    def __init__(self, path: str):
        self.system, self.name = _located(path)
        self.system.create_dir(self.name.rsplit("/", 1)[0], recursive=True)
        self.part = self.name.rsplit("/", 1)[0] + "/." + uuid.uuid4().hex
        self.stream = self.system.open_output_stream(self.part)

    def commit(self) -> None:
        if not self.stream.closed:
            self.stream.close()
        self.system.move(self.part, self.name)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, length) of every file under a folder that isn't empty; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length")


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows over as many tasks as a shuffle has: they are few bytes each, but much is read for them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


class _Rows:
    """Rows of an Arrow batch with what was read for each, handed on before they are too many bytes."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, self.at, self.data, self.reasons, self.size = batch, 0, [], [], 0

    def add(self, data: bytes | None, reason: str | None = None) -> Iterator[pa.RecordBatch]:
        self.data.append(data)
        self.reasons.append(reason)
        self.size += len(data or b"")
        if self.size >= BATCH_BYTES or len(self.data) >= BATCH_ROWS or self.at + len(self.data) == self.batch.num_rows:
            rows = self.batch.slice(self.at, len(self.data))
            self.at += len(self.data)
            arrays = [*rows.columns, pa.array(self.data, pa.binary()), pa.array(self.reasons, pa.string())]
            self.data, self.reasons, self.size = [], [], 0
            yield pa.RecordBatch.from_arrays(arrays, [*self.batch.schema.names, "data", "reject_reason"])


def _schema(rows: DataFrame) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["data binary", "reject_reason string"])


def read_prefixes(spark: SparkSession, folder: str, n: int, pattern: str = "*", read=None) -> DataFrame:
    """(path, name, data, size, length) of every file that isn't empty: ``data``, its first ``n`` bytes, are all that is
    read of it. ``read``, an accumulator, adds up the bytes."""
    if not 0 < n <= LONGEST:
        raise ValueError("a prefix must have bytes and fit a cell")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Rows(batch)
            for path in batch.column("path").to_pylist():
                with opened(path) as file:
                    data = file.read(n)
                if read is not None:
                    read.add(len(data))
                yield from rows.add(data)

    files = _dealt(list_files(spark, folder, pattern).where("length > 0"), "path")
    return files.mapInArrow(prefixes, _schema(files)).select("path", "name", "data", F.length("data").cast("long").alias("size"), "length")


def _runs(offsets: list[int], sizes: list[int], first: int, stop: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, row past the last, offset, bytes) of ranges that are read at once."""
    at = first
    while at < stop:
        end, k = offsets[at] + sizes[at], at + 1
        while k < stop and offsets[k] - end <= GAP and max(end, offsets[k] + sizes[k]) - offsets[at] <= RUN:
            end = max(end, offsets[k] + sizes[k])
            k += 1
        yield at, k, offsets[at], end - offsets[at]
        at = k


class _Inflated:
    """A compressed file read forward: ranges by offset, those that begin before the last one's end among them."""

    def __init__(self, file: pa.NativeFile):
        self.stream, self.kept, self.start, self.done = pa.CompressedInputStream(file, "zstd"), b"", 0, False

    def take(self, offset: int, size: int) -> tuple[bytes | None, str | None]:
        if not 0 <= size <= LONGEST or offset < 0:
            return None, BEYOND if size <= LONGEST else TOO_LONG
        while True:
            drop = min(len(self.kept), max(0, offset - self.start))
            self.kept, self.start = self.kept[drop:], self.start + drop
            upto = self.start + len(self.kept)
            if self.done or upto >= offset + size:
                break
            more = self.stream.read(min(RUN, offset - upto) if offset > upto else offset + size - upto)
            self.done = not more
            self.kept += more
        part = self.kept[:size] if self.start == offset else b""
        return (part, None) if len(part) == size and self.start == offset else (None, BEYOND)


def cut(ranges: DataFrame, inflated: bool = False, read=None) -> DataFrame:
    """``ranges`` (path, offset, size, ...) with ``data``, the bytes of each range, and ``reject_reason``.

    Ranges are dealt and sorted by path and offset; a file is opened once a task, and neighbouring ranges are read
    together. A file is said to be compressed by ``inflated``: its ranges count in what it inflates to, which is
    streamed by one task, the bytes between ranges dropped. What can't be read has no data and a reason: a range that
    goes beyond the end, is negative or longer than a cell, a file that isn't there. An empty range has no bytes.
    ``read``, an accumulator, adds up the bytes taken from files that aren't compressed.
    """
    n = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (ranges.repartition(n, "path") if inflated else ranges.repartitionByRange(n, "path", "offset")).sortWithinPartitions("path", "offset")

    def plain(file: pa.NativeFile, offsets: list[int], sizes: list[int], rows: range) -> Iterator[tuple[bytes | None, str | None]]:
        length = file.size()
        good = [k for k in rows if 0 <= sizes[k] <= LONGEST and 0 <= offsets[k] and offsets[k] + sizes[k] <= length]
        found: dict[int, bytes] = {}
        runs = _runs([offsets[k] for k in good], [sizes[k] for k in good], 0, len(good))
        upto = 0
        for k in rows:
            while upto < len(good) and good[upto] <= k and k not in found:
                found.clear()
                a, z, start, size = next(runs)
                file.seek(start)
                block = file.read(size)
                if read is not None:
                    read.add(len(block))
                for j in good[a:z]:
                    found[j] = block[offsets[j] - start : offsets[j] - start + sizes[j]]
                upto = z
            yield (found[k], None) if k in found else (None, BEYOND if sizes[k] <= LONGEST else TOO_LONG)

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, stream = None, None, None
        for batch in batches:
            rows = _Rows(batch)
            paths = batch.column("path").to_pylist()
            offsets, sizes = ([-1 if x is None else x for x in batch.column(c).to_pylist()] for c in ("offset", "size"))
            at = 0
            while at < len(paths):
                stop = at + 1
                while stop < len(paths) and paths[stop] == paths[at]:
                    stop += 1
                if file is None or paths[at] != path:
                    if file is not None:
                        file.close()
                    path, file = paths[at], None
                    try:
                        file = opened(path)
                        stream = _Inflated(file) if inflated else None
                    except (OSError, TypeError, ValueError) as e:
                        for _ in range(at, stop):
                            yield from rows.add(None, f"file: {type(e).__name__}")
                        at = stop
                        continue
                found = (stream.take(o, n) for o, n in zip(offsets[at:stop], sizes[at:stop])) if inflated else plain(file, offsets, sizes, range(at, stop))
                for data, reason in found:
                    yield from rows.add(data, reason)
                at = stop
        if file is not None:
            file.close()

    return dealt.mapInArrow(read_all, _schema(ranges))


def archive_index(spark: SparkSession, folder: str, pattern: str = "*.zip") -> DataFrame:
    """(archive, name, at, packed, size, method, crc, sealed, reject_reason) of the members of zip files that are no
    folders and not empty, from the directories at the files' ends: their data is not read. An archive that is none is a
    row with its reason and no name."""
    schema = "archive string, name string, at long, packed long, size long, method int, crc long, sealed boolean, reject_reason string"

    def directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = []
                try:
                    with opened(path) as file, zipfile.ZipFile(file) as archive:
                        found = [(path, i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC, bool(i.flag_bits & 1), None) for i in archive.infolist() if not i.is_dir() and i.file_size]
                except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError, struct.error) as e:
                    found = [(path, None, None, None, None, None, None, None, f"archive: {e}")]
                for lo in range(0, len(found), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found[lo : lo + 4096]), kinds)], names)

    return _dealt(list_files(spark, folder, pattern).select("path"), "path").mapInArrow(directories, schema)


def _member(file: pa.NativeFile, at: int, packed: int, size: int, method: int, crc: int, sealed: bool, most: int | None) -> bytes:
    """A member's bytes, or the first ``most`` of them, inflated piece by piece."""
    if sealed:
        raise ValueError("encrypted")
    if min(size, most or size) > LONGEST:
        raise ValueError("longer than a cell")
    if method not in (STORED, DEFLATED):
        with zipfile.ZipFile(file) as archive:
            info = next(i for i in archive.infolist() if i.header_offset == at)
            with archive.open(info) as member:
                return member.read(most or size)
    file.seek(at)
    head = file.read(30)
    if len(head) < 30 or head[:4] != b"PK\3\4":
        raise ValueError("no local header")
    name, extra = struct.unpack("<HH", head[26:30])
    file.seek(at + 30 + name + extra)
    out, left, wanted, inflate = io.BytesIO(), packed, min(size, most or size), zlib.decompressobj(-15)
    while left and out.tell() < wanted:
        block = file.read(min(left, 1 << 20))
        if not block:
            raise ValueError("cut off")
        left -= len(block)
        while block and out.tell() < wanted:
            out.write(block if method == STORED else inflate.decompress(block, max(1, wanted - out.tell())))
            block = b"" if method == STORED else inflate.unconsumed_tail
    data = out.getvalue()[:wanted]
    if len(data) < wanted:
        raise ValueError("cut off")
    if wanted == size and zlib.crc32(data) != crc:
        raise ValueError("wrong checksum")
    return data


def members(index: DataFrame, max_length: int | None = None) -> DataFrame:
    """(archive, name, data, reject_reason) of an index's members, dealt over tasks whatever archive they are of.

    A task reads a member from its place in the archive and holds no more than that. What can't be read has no data and
    a reason; rows of the index that have one keep it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns = _Rows(batch.drop_columns("reject_reason")), [batch.column(c).to_pylist() for c in batch.schema.names]
            path, file = None, None
            for archive, _, at, packed, size, method, crc, sealed, reason in zip(*columns):
                data = None
                if reason is None:
                    try:
                        if archive != path:
                            if file is not None:
                                file.close()
                            path, file = None, None
                            file, path = opened(archive), archive
                        data = _member(file, at, packed, size, method, crc, sealed, max_length)
                    except (zipfile.BadZipFile, OSError, ValueError, RuntimeError, NotImplementedError, StopIteration, zlib.error) as e:
                        reason = f"member: {e}"
                yield from rows.add(data, reason)
            if file is not None:
                file.close()

    names = ["archive", "name", "at", "packed", "size", "method", "crc", "sealed", "reject_reason"]
    dealt = _dealt(index.select(*names), "archive", "at").sortWithinPartitions("archive", "at")
    return dealt.mapInArrow(read, _schema(dealt.drop("reject_reason"))).select("archive", "name", "data", "reject_reason")
