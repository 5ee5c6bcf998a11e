"""Token ids as binary shard files with Elias-Fano document boundaries.

A shard file holds, in this order: the ids of its documents in a row (16 or 32 bits each, little-endian); the Elias-Fano
form of the documents' ends; that of the document ids, counted from the least one; a JSON footer with the lengths of
these parts, the least document id and the number of documents without an id, which come last; the footer's length (4
bytes) and the magic. Shards hold rising ranges of document ids, so a document's global start is its shard's start plus
a select on the shard.
"""

from __future__ import annotations

import json
import posixpath
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytebasin.llm.common import give_back, kept
from bytebasin.llm.elias_fano import EliasFano
from bytebasin.llm.word_bpe import WordEncoder

MAGIC = b"EFTOKENS"
#: Ids read from a shard at a time.
_READ = 4 << 20
#: Rows that the reader hands on at a time.
_ROWS = 4096


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_token_shards(docs: DataFrame, folder: str, path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", shards: int | None = None) -> list[dict]:
    """Encode every whole text, append ``end_id`` and write shard files to ``folder`` in ascending ``doc_id`` order.

    ``folder`` must be shared by the executors (any file system that Arrow opens). Null or empty texts are an
    ``end_id`` alone; rows with one ``doc_id`` follow each other by a hash of the text, and null ids come last; other
    columns are not read. One shuffle, by ranges of (``doc_id``, hash), so that many rows of one id are dealt too. A task
    writes a file named after its own attempt and the manifest names the files of the attempts that counted, so lost
    executors and speculative copies do no harm. Returns the manifest, a small record for each shard; an empty table
    gives none. Ids must be whole numbers; any other is an error when rows are read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = rows.repartitionByRange(shards or max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order, "text")
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text", F.spark_partition_id().alias("shard"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, (fs, base) = kept(("ids", path), lambda: WordEncoder(path)), _open(folder)
        end = np.array([end_id], encoder.dtype).tobytes()
        out, ids, sizes, none, task = None, [], [], 0, TaskContext.get()
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                shard = int(batch["shard"].iloc[0])
                fs.create_dir(base, recursive=True)
                name = f"shard-{shard:06d}-{task.taskAttemptId()}.eft"
                out = fs.open_output_stream(posixpath.join(base, name))
            ids.append(batch["doc_id"].to_numpy("i8")[~batch["none"].to_numpy(bool)])
            none += int(batch["none"].sum())
            for pieces in encoder.pieces(batch["text"].tolist()):
                out.write(raw := b"".join(pieces) + end)
                sizes.append(len(raw) // encoder.dtype.itemsize)
        if out is None:
            return
        ends, numbers = np.cumsum(sizes), np.concatenate(ids)
        least = int(numbers[0]) if len(numbers) else 0
        parts = [EliasFano.of(ends).to_bytes(), EliasFano.of(numbers.astype("u8") - np.uint64(least % (1 << 64))).to_bytes()]
        foot = {"n_docs": len(sizes), "n_tokens": int(ends[-1]), "id_bytes": encoder.dtype.itemsize, "least": least, "none": none, "parts": [len(p) for p in parts]}
        raw = json.dumps(foot).encode()
        out.write(b"".join([*parts, raw, struct.pack("<I", len(raw)), MAGIC]))
        out.close()
        give_back()
        yield pd.DataFrame([{"shard": shard, "n_docs": foot["n_docs"], "n_tokens": foot["n_tokens"], "file": name}])

    found = rows.mapInPandas(write, "shard int, n_docs long, n_tokens long, file string").collect()
    manifest, start = [], 0
    for row in sorted(found, key=lambda r: r["shard"]):
        manifest.append(row.asDict() | {"start": start})
        start += row["n_tokens"]
    return manifest


class TokenShard:
    """One shard file, read by ranges: boundaries at once, ids as they are asked for."""

    def __init__(self, uri: str):
        fs, name = _open(uri)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        length = struct.unpack("<I", tail[:4])[0]
        self.footer = json.loads(self.file.read_at(length, size - 12 - length))
        at = self.footer["n_tokens"] * self.footer["id_bytes"]
        first, second = self.footer["parts"]
        self.ends = EliasFano.from_bytes(self.file.read_at(first, at))
        self.numbers = EliasFano.from_bytes(self.file.read_at(second, at + first))
        self.n_docs = self.footer["n_docs"]
        self.dtype = np.dtype(f"<u{self.footer['id_bytes']}")

    def doc_id(self, i: int) -> int | None:
        return self.footer["least"] + self.numbers.select(i) if i < self.numbers.n else None

    def end(self, i: int) -> int:
        """Where the i-th document's ids end within the shard, by select; they start where those before it end."""
        return self.ends.select(i) if i >= 0 else 0

    def span(self, i: int) -> tuple[int, int]:
        return self.end(i - 1), self.end(i)

    def ids(self, start: int, end: int) -> np.ndarray:
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((end - start) * width, start * width), self.dtype)


def read_token_shards(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """Per document: ``doc_id``, global ``start``, ``n_tokens``, ``ids_crc32`` of its ids as 32-bit numbers.

    A task for each shard. Boundaries come from select, document by document, and a few MB of ids are read at a time.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, start in zip(batch["file"], batch["start"]):
                shard, found, held, begin = TokenShard(posixpath.join(folder, file)), [], 0, 0
                for i in range(shard.n_docs):
                    end = shard.end(i)
                    if not i or end > held:
                        first, held = begin, max(end, min(begin + _READ, shard.footer["n_tokens"]))
                        ids = shard.ids(first, held).astype("<u4")
                    crc = zlib.crc32(ids[begin - first : end - first])
                    found.append((shard.doc_id(i), begin + start, end - begin, crc))
                    begin = end
                    if len(found) == _ROWS:
                        yield _rows(found)
                        found = []
                yield _rows(found)

    def _rows(found: list[tuple]) -> pd.DataFrame:
        numbers, *others = zip(*found) if found else ((), (), (), ())
        # an integer column with nulls must not pass through floats
        return pd.DataFrame({"doc_id": pd.array(numbers, "Int64"), **dict(zip(("start", "n_tokens", "ids_crc32"), (pd.Series(x, dtype="int64") for x in others)))})

    files = spark.createDataFrame([(m["file"], m["start"]) for m in manifest], "file string, start long")
    return files.repartition(len(manifest)).mapInPandas(read, schema)
