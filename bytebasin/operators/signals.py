"""Signals along positions: sliding entropy, flags, patches, greatest values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytebasin.operators.stats import as_bytes

#: Windows of a blob whose counts are held at a time.
CHUNK = 4096
#: Places that a rolling window moves over in one chunk, and rows handed on at a time.
ROLL = 1 << 16


def check_window(radius: int, stride: int) -> None:
    if radius <= 0 or stride <= 0 or stride > 2 * radius + 1:
        raise ValueError("radius and stride must be positive, and the stride no longer than the window")


def window_valid(size: Column, radius: int) -> Column:
    """Whether a blob is long enough for a window."""
    return size > 2 * radius + 1


def _by_segments(x: np.ndarray, width: int, stride: int) -> Iterator[np.ndarray]:
    """Entropy of every window, a chunk of windows at a time: bytes are counted by the segments between window edges,
    and windows are differences of running counts."""
    n = -(-(len(x) - width + 1) // stride)
    table = np.arange(width + 1) * np.log2(np.maximum(1, np.arange(width + 1)))
    for lo in range(0, n, CHUNK):
        starts = np.arange(lo, min(n, lo + CHUNK)) * stride
        edges = np.unique(np.concatenate([starts, starts + width]))
        part = x[edges[0] : edges[-1]]
        cell = np.searchsorted(edges, np.arange(edges[0], edges[0] + len(part)), "right") - 1
        counts = np.bincount(cell * 256 + part, minlength=(len(edges) - 1) * 256).reshape(-1, 256)
        upto = np.vstack([np.zeros((1, 256), counts.dtype), counts.cumsum(axis=0)])
        windows = upto[np.searchsorted(edges, starts + width)] - upto[np.searchsorted(edges, starts)]
        yield np.log2(width) - table[windows].sum(axis=1) / width


def _rolling(x: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Entropy of the window at every place, a chunk of places at a time, each from the one before it.

    A step takes one byte out and another in; what it changes follows from how often these two are in the window, which
    their ranks among the equal bytes of the chunk tell. A chunk begins with a count of its own, so that rounding does
    not add up from chunk to chunk.
    """
    table = np.arange(width + 2) * np.log2(np.maximum(1, np.arange(width + 2)))
    places = len(x) - width + 1
    step = max(ROLL, 4 * width)
    for lo in range(0, places, step):
        part = x[lo : min(places, lo + step) + width - 1].astype(np.int64)
        m = len(part)
        order = np.argsort(part, kind="stable")
        keys = part[order] * m + order  # places by byte, rising
        rank = np.empty(m, np.int64)
        rank[order] = np.arange(m)
        new = np.arange(width, m)
        old = new - width
        # how often the byte that comes in, and the one that goes out, are in the window before the step
        comes = rank[new] - np.searchsorted(keys, part[new] * m + old)
        goes = np.searchsorted(keys, part[old] * m + new) - rank[old]
        change = np.where(part[new] == part[old], 0.0, table[comes + 1] - table[comes] + table[np.maximum(goes - 1, 0)] - table[goes])
        first = table[np.bincount(part[:width], minlength=256)].sum()
        yield np.log2(width) - np.concatenate([[first], first + np.cumsum(change)]) / width


def entropies(x: np.ndarray, radius: int, stride: int) -> Iterator[np.ndarray]:
    """Entropy of every window of a blob in chunks; besides the blob no more than a chunk is held."""
    width = 2 * radius + 1
    if stride >= 8:
        yield from _by_segments(x, width, stride)
        return
    at = 0
    for chunk in _rolling(x, width):
        yield chunk[-at % stride :: stride]
        at += len(chunk)


def window_entropy(samples: DataFrame, radius: int, stride: int) -> DataFrame:
    """(name, k, start, end, entropy): a row for each window of 2 * radius + 1 bytes, and the positions its value fills.

    Window k begins at k * stride; its value fills ``stride`` positions from its centre on. A blob's windows are found
    in its row and handed on chunk by chunk: no shuffle, and memory for the blob and a chunk. Blobs that are too short
    have no row.
    """
    check_window(radius, stride)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                k = 0
                for chunk in entropies(as_bytes(batch.column("data")[row].as_buffer()), radius, stride):
                    for lo in range(0, len(chunk), ROLL):
                        part = chunk[lo : lo + ROLL]
                        same = pa.array(np.full(len(part), row))
                        yield pa.RecordBatch.from_arrays([batch.column("name").take(same), batch.column("size").take(same), pa.array(np.arange(k, k + len(part))), pa.array(part)], ["name", "size", "k", "entropy"])
                        k += len(part)

    valid = samples.where(window_valid(F.col("size"), radius)).select("name", F.col("size").cast("long").alias("size"), "data")
    name = valid.schema["name"].dataType.simpleString()
    found = valid.mapInArrow(windows, f"name {name}, size long, k long, entropy double")
    start = F.col("k") * stride + radius
    return found.select("name", "k", start.alias("start"), F.least(start + stride, "size").alias("end"), "entropy")


def rolling_entropy(samples: DataFrame, radius: int) -> DataFrame:
    """(name, start, entropy) with stride 1: each window follows from the one before it."""
    sized = samples.select("name", "data", F.length("data").cast("long").alias("size"))
    return window_entropy(sized, radius, 1).select("name", "start", "entropy")


def high_entropy(entropy: Column, least: float = 7.0) -> Column:
    """Whether an entropy is above ``least``; not where there is none."""
    return F.coalesce(entropy > least, F.lit(False))


def patch_maxima(signal: DataFrame, patch: int) -> DataFrame:
    """(name, patch, value, pos): the greatest value of every patch of a signal in rows (name, pos, value), and its first
    position."""
    rows = signal.withColumn("patch", F.floor(F.col("pos") / patch))
    return rows.groupBy("name", "patch").agg(F.max("value").alias("value"), F.min(F.struct((-F.col("value")).alias("v"), "pos"))["pos"].alias("pos"))


def maxima(signal: DataFrame) -> DataFrame:
    """(name, value, pos): the greatest value of a whole sequence and its first position; parts are reduced first."""
    return signal.groupBy("name").agg(F.max("value").alias("value"), F.min(F.struct((-F.col("value")).alias("v"), "pos"))["pos"].alias("pos"))


def byte_patch_maxima(samples: DataFrame, patch: int | None = None) -> DataFrame:
    """(name, patch, value, pos) of blobs, whose bytes are the signal; without ``patch`` a blob is one patch.

    Found in the blob's row: no shuffle. A blob without bytes has no row.
    """

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, places, values, spots = [], [], [], []
            for row in range(batch.num_rows):
                x = as_bytes(batch.column("data")[row].as_buffer())
                size = patch or max(1, len(x))
                whole = len(x) // size
                at = x[: whole * size].reshape(-1, size).argmax(axis=1)
                if whole * size < len(x):
                    at = np.append(at, x[whole * size :].argmax())
                at = at + np.arange(len(at)) * size
                owner.append(np.full(len(at), row))
                places.append(np.arange(len(at)))
                values.append(x[at].astype(np.int64))
                spots.append(at)
            if owner:
                arrays = [batch.column("name").take(pa.array(np.concatenate(owner))), *[pa.array(np.concatenate(c)) for c in (places, values, spots)]]
                yield pa.RecordBatch.from_arrays(arrays, ["name", "patch", "value", "pos"])

    rows = samples.where(F.length("data") > 0).select("name", "data")
    name = rows.schema["name"].dataType.simpleString()
    return rows.mapInArrow(greatest, f"name {name}, patch long, value long, pos long")


def patch_centres(patches: DataFrame, longest: int) -> DataFrame:
    """``rel``, the centre of patch j of n, and ``abs``, the same as a share of the longest sequence."""
    rel = (F.col("patch") + 0.5) / F.col("n_patches")
    return patches.withColumns({"rel": rel, "abs": F.greatest(F.lit(0.0), F.least(F.lit(1.0), rel * F.col("size") / longest))})
