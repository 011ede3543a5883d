"""Elias-Fano sequences: ascending whole numbers in about 2 + log2(largest / count) bits each.

A number is cut into `low` bits, which lie packed end to end, and the rest, which is written in
unary: the bit at (number >> low) + its index is set. The number at index i therefore is
((place of the i-th set bit) - i) << low | its low bits. `select` finds that place from a sample
(the place of every 512th set bit) and a short scan; `rank` counts the numbers below a value by
halving over `select`. No table of whole numbers is held.

An empty sequence, equal neighbours and numbers up to 2**64 - 1 are allowed.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 512
HEADER = struct.Struct("<QBQQ")


class EliasFano:
    """low: bits a number has there. lows, highs: packed bits, lowest first. samples: places."""

    def __init__(self, count: int, low: int, lows: np.ndarray, highs: np.ndarray,
                 samples: np.ndarray) -> None:
        self.count, self.low = count, low
        self.lows, self.highs, self.samples = lows, highs, samples

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        """From an ascending array."""
        numbers = np.asarray(numbers, dtype=np.uint64)
        count = len(numbers)
        if not count:
            nothing = np.zeros(0, np.uint8)
            return cls(0, 0, nothing, nothing, np.zeros(0, np.uint32))
        low = max(0, (int(numbers[-1]) // count).bit_length() - 1)
        high = (numbers >> np.uint64(low)).astype(np.int64)
        places = high + np.arange(count)
        bits = np.zeros(int(places[-1]) + 1, dtype=np.uint8)
        bits[places] = 1
        packed = [np.zeros(0, np.uint8)]
        if low:
            shifts = np.arange(low, dtype=np.uint64)
            for start in range(0, count, 8_192):  # a multiple of 8, so that parts end on a byte
                part = numbers[start:start + 8_192, None] >> shifts & np.uint64(1)
                packed.append(np.packbits(part.astype(np.uint8).ravel(), bitorder="little"))
        return cls(count, low, np.concatenate(packed), np.packbits(bits, bitorder="little"),
                   places[::SAMPLE].astype(np.uint32 if places[-1] < 2**32 else np.uint64))

    def places(self, start: int, stop: int) -> np.ndarray:
        """Places of the set bits with index start to stop - 1."""
        if stop <= start:
            return np.zeros(0, np.int64)
        first, last = start // SAMPLE, (stop - 1) // SAMPLE + 1
        begin = int(self.samples[first]) // 8
        end = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.highs)
        bits = np.unpackbits(self.highs[begin:end], bitorder="little")
        bits[:int(self.samples[first]) - 8 * begin] = 0
        found = np.nonzero(bits)[0] + 8 * begin
        return found[start - first * SAMPLE:stop - first * SAMPLE]

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The numbers with index start to stop - 1."""
        stop = min(stop, self.count)
        if stop <= start:
            return np.zeros(0, np.uint64)
        high = (self.places(start, stop) - np.arange(start, stop)).astype(np.uint64)
        if not self.low:
            return high
        begin, end = start * self.low, stop * self.low
        bits = np.unpackbits(self.lows[begin // 8:-(-end // 8)], bitorder="little")
        bits = bits[begin % 8:begin % 8 + end - begin].reshape(-1, self.low).astype(np.uint64)
        lows = np.bitwise_or.reduce(bits << np.arange(self.low, dtype=np.uint64), axis=1)
        return high << np.uint64(self.low) | lows

    def select(self, index: int) -> int:
        """The number at `index`."""
        if not 0 <= index < self.count:
            raise IndexError(index)
        return int(self.slice(index, index + 1)[0])

    def rank(self, value: int) -> int:
        """How many of the numbers are smaller than `value`."""
        low, high = 0, self.count
        while low < high:
            middle = (low + high) // 2
            if self.select(middle) < value:
                low = middle + 1
            else:
                high = middle
        return low

    def to_bytes(self) -> bytes:
        header = HEADER.pack(self.count, self.low, len(self.lows), len(self.highs))
        wide = self.samples.dtype == np.uint64
        return header + bytes([wide]) + (
            self.lows.tobytes() + self.highs.tobytes()
            + self.samples.astype("<u8" if wide else "<u4").tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        count, low, lows, highs = HEADER.unpack_from(data)
        at = HEADER.size
        wide, at = data[at], at + 1
        samples = np.frombuffer(data, "<u8" if wide else "<u4", offset=at + lows + highs)
        return cls(count, low, np.frombuffer(data, np.uint8, lows, at),
                   np.frombuffer(data, np.uint8, highs, at + lows), samples)
