"""Elias-Fano form of a rising integer sequence, with a select structure."""

from __future__ import annotations

import struct

import numpy as np

#: One sampled position of the upper bits for so many values.
SAMPLE = 256
#: Values whose bits are laid out at a time, a multiple of eight.
CHUNK = 1 << 13
_HEAD = struct.Struct("<QQ")


class EliasFano:
    """Values v_0 <= v_1 <= ... from 0 on: low bits packed, high bits in unary, sampled for select.

    It takes about 2 + log2(greatest / n) bits a value, and a quarter of a bit for the samples, which are stored with
    it: nothing is unpacked to be read. An empty sequence is allowed.
    """

    def __init__(self, n: int, greatest: int, low: bytes, upper: bytes, samples: np.ndarray):
        self.n, self.greatest, self.low, self.upper, self.samples = n, greatest, low, upper, samples
        self.bits = self.low_bits(n, greatest)

    @staticmethod
    def low_bits(n: int, greatest: int) -> int:
        return max(0, (greatest // n).bit_length() - 1) if n else 0

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, "<u8")
        n, greatest = len(values), int(values[-1]) if len(values) else 0
        bits = cls.low_bits(n, greatest)
        # values go a few at a time, as each has a number for every bit; eight of them end on a byte
        places, low = np.arange(bits, dtype="<u8"), []
        for i in range(0, n, CHUNK):
            low.append(np.packbits(((values[i : i + CHUNK, None] >> places) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes())
        ones = (values >> np.uint64(bits)).astype("i8") + np.arange(n)
        upper = np.zeros(n + (greatest >> bits) + 1, np.uint8)
        upper[ones] = 1
        return cls(n, greatest, b"".join(low), np.packbits(upper, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u8"))

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.greatest) + self.low + self.upper + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, greatest = _HEAD.unpack_from(raw)
        bits = cls.low_bits(n, greatest)
        low = _HEAD.size + (n * bits + 7) // 8
        upper = low + (n + (greatest >> bits) + 8) // 8
        return cls(n, greatest, raw[_HEAD.size : low], raw[low:upper], np.frombuffer(raw, "<u8", offset=upper))

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample on, by bytes' bit counts, then within a byte."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at >> 3
        word = self.upper[byte] & (0xFF << (at & 7)) & 0xFF
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.upper[byte]
        for _ in range(left):
            word &= word - 1
        high = (byte << 3) + (word & -word).bit_length() - 1 - i
        if not self.bits:
            return high
        first = i * self.bits
        part = int.from_bytes(self.low[first >> 3 : (first + self.bits + 7) >> 3], "little")
        return high << self.bits | part >> (first & 7) & (1 << self.bits) - 1
