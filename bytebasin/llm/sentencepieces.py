"""SentencePiece encoding with every piece's span of source bytes.

The model's normaliser is rebuilt from its compiled character map: at each place the longest prefix in the map's double
array is replaced, and each byte of the result remembers the source bytes it came from. The library encodes and decodes;
the lengths of its pieces, laid over the normalised bytes, give the source span of each.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytebasin.llm.common import give_back, kept

SPACE = "▁".encode()


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: varints as int, strings and messages as bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while i < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, raw[i : i + n]
            i += n
        else:
            n = {1: 8, 5: 4}[key & 7]
            yield key >> 3, raw[i : i + n]
            i += n


class CharMap:
    """A compiled character map: a double array of source prefixes, and their replacements ending in zero bytes."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if n else []
        self.texts = blob[4 + n :]
        #: Bytes that begin a prefix of the map: other bytes are passed over at once.
        self.begins = np.array([bool(self.units) and self._child(self._offset(self.units[0]), b) is not None for b in range(256)])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _child(self, at: int, byte: int) -> int | None:
        node = at ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, raw: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of ``raw[start:]`` in the map, and its replacement."""
        if not self.units:
            return None
        node, found = self._offset(self.units[0]), None
        for i in range(start, len(raw)):
            if (child := self._child(node, raw[i])) is None:
                break
            unit = self.units[child]
            node = child ^ self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = i + 1 - start, self.texts[value : self.texts.index(b"\0", value)]
        return found


class Normalizer:
    """Normalised bytes of a text, and for each of them the source bytes that it stands for."""

    def __init__(self, model: bytes):
        spec = dict(_fields(next((v for k, v in _fields(model) if k == 3), b"")))
        self.map = CharMap(spec.get(2, b""))
        self.dummy_prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))

    def _replaced(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes after the character map, with the source start and end of each."""
        source = np.frombuffer(raw, np.uint8)
        at = np.arange(len(raw))
        begins = np.flatnonzero(self.map.begins[source] & (source & 0xC0 != 0x80))
        width = 1 + (source >= 0xC0) + (source >= 0xE0) + (source >= 0xF0)
        lead = np.flatnonzero(source & 0xC0 != 0x80)
        start = np.repeat(lead, width[lead])[: len(raw)]
        end = start + np.repeat(width[lead], width[lead])[: len(raw)]
        if not len(begins):
            return source, start, end
        parts, starts, ends, done = [], [], [], 0
        for i in begins.tolist():
            if i < done or not (found := self.map.longest(raw, i)):
                continue
            n, text = found
            parts += [source[done:i], np.frombuffer(text, np.uint8)]
            starts += [start[done:i], np.full(len(text), i)]
            ends += [end[done:i], np.full(len(text), i + n)]
            done = i + n
        parts.append(source[done:])
        starts.append(start[done:])
        ends.append(end[done:])
        return np.concatenate(parts), np.concatenate(starts), np.concatenate(ends)

    def __call__(self, raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes, and the start and end in ``raw`` of the source of each."""
        if not raw:
            return b"", np.zeros(0, int), np.zeros(0, int)
        text, start, end = self._replaced(raw)
        if self.squeeze:
            blank = text == 0x20
            keep = ~blank | (np.concatenate([[False], ~blank[:-1]]))  # the first of a run, none at the beginning
            last = np.flatnonzero(~blank)
            keep[(last[-1] + 1) if len(last) else 0 :] = False
            text, start, end = text[keep], start[keep], end[keep]
        if not len(text):
            return b"", start, end
        if self.dummy_prefix:
            text, start, end = (np.concatenate([[x], y]) for x, y in ((0x20, text), (start[0], start), (start[0], end)))
        blank = text == 0x20
        if self.escape and blank.any():
            times = np.where(blank, len(SPACE), 1)
            text, start, end = np.repeat(text, times), np.repeat(start, times), np.repeat(end, times)
            text[np.repeat(blank, times)] = np.tile(np.frombuffer(SPACE, np.uint8), int(blank.sum()))
        return text.astype(np.uint8).tobytes(), start, end


class PieceEncoder:
    """The library's ids for a text, each with its span of source bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            model = f.read()
        self.processor = SentencePieceProcessor(model_proto=model)
        self.normalizer = Normalizer(model)
        #: Normalised bytes of each piece; -1 for the unknown piece, whose length the text decides.
        self.widths = np.array([1 if self.processor.is_byte(i) else -1 if self.processor.is_unknown(i) else len(self.processor.id_to_piece(i).encode()) for i in range(self.processor.get_piece_size())])

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end, in UTF-8 bytes of ``text``, of the source of each id; the spans cover the text in order."""
        normal, start, end = self.normalizer(text.encode())
        widths = self.widths[ids]
        if (widths < 0).any():
            pieces = self.processor.encode(text, out_type=str)
            widths = np.array([w if w >= 0 else len(p.encode()) for w, p in zip(widths.tolist(), pieces)])
        stops = np.cumsum(widths)
        if len(stops) and stops[-1] != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        return start[stops - widths], end[stops - 1]


def _encoder(path: str) -> PieceEncoder:
    return kept(("pieces", path), lambda: PieceEncoder(path))


def with_pieces(docs: DataFrame, path: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """``docs`` with a column ``pieces``: ``ids`` (begin and end ids included), ``starts``, ``ends`` (source bytes of
    each id, begin and end ids having empty spans) and ``decoded``.

    Every whole text is encoded; a null text counts as empty and has the begin and end ids alone. ``decoded=False``
    leaves ``decoded`` null. A column named ``pieces`` is replaced; others and repeated rows stay. An empty table gives
    an empty table. No shuffle; a worker hands on a few documents at a time.
    """

    @F.pandas_udf("ids array<int>, starts array<int>, ends array<int>, decoded string")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for batch in batches:
            yield pd.DataFrame([_encoded(encoder, t, decoded) for t in batch], columns=["ids", "starts", "ends", "decoded"])
        give_back()

    return docs.withColumn("pieces", encode(F.coalesce(F.col(text), F.lit(""))))


def _encoded(encoder: PieceEncoder, text: str, decoded: bool = True) -> tuple:
    processor = encoder.processor
    ids = processor.encode(text)
    start, end = encoder.spans(text, np.array(ids, int))
    n = len(text.encode())
    full = [processor.bos_id(), *ids, processor.eos_id()]
    starts, ends = (np.concatenate([[0], x, [n]]).astype(np.int32) for x in (start, end))
    return np.array(full, np.int32), starts, ends, processor.decode(full) if decoded else None


def with_piece_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with the digests of the same encoding: ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and
    ``covered_bytes``, the source bytes that the pieces' spans cover. Ids and texts stay in the worker.

    A null text counts as empty: two ids, no byte covered. Columns by these four names are replaced; others, whatever
    their names, and repeated rows stay. An empty table gives an empty table. No shuffle.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for batch in batches:
            rows = []
            for t in batch:
                ids, start, end, decoded = _encoded(encoder, t)
                raw = np.array(ids, "<u4").tobytes()
                covered = int((end - np.maximum(start, np.maximum.accumulate(np.concatenate([[0], end[:-1]])))).clip(0).sum())
                rows.append((len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), covered))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])
        give_back()

    into = "__digest"
    while into in docs.columns:
        into += "_"
    out = docs.withColumn(into, digest(F.coalesce(F.col(text), F.lit(""))))
    names = ("n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes")
    return out.withColumns({n: F.col(f"{into}.{n}") for n in names}).drop(into)
