"""Elias-Fano sequences over NumPy arrays, and files of such arrays that are memory-mapped."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

def _every_byte(x: int) -> np.uint64:
    return np.uint64(x * 0x0101010101010101)


def _places() -> np.ndarray:
    """For byte b and rank r, at b * 8 + r: the place of b's r-th set bit."""
    out = np.zeros((256, 8), np.uint8)
    for b in range(256):
        set_bits = [i for i in range(8) if b >> i & 1]
        out[b, : len(set_bits)] = set_bits
    return out.ravel()


_PLACES = _places()


def select_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the r-th (from 0) set bit of each word: running counts of all bytes at once, then the byte's own table."""
    word, r = np.asarray(word, np.uint64), np.asarray(r).astype(np.uint64)
    s = word - ((word >> np.uint64(1)) & _every_byte(0x55))
    s = (s & _every_byte(0x33)) + ((s >> np.uint64(2)) & _every_byte(0x33))
    s = ((s + (s >> np.uint64(4))) & _every_byte(0x0F)) * _every_byte(1)  # byte k: set bits up to and with byte k
    passed = ((r * _every_byte(1)) | _every_byte(0x80)) - s  # a byte's top bit stays where r is at least its count
    shift = np.bitwise_count(passed & _every_byte(0x80)).astype(np.uint64) << np.uint64(3)
    before = (s << np.uint64(8)) >> shift & np.uint64(0xFF)
    at = ((word >> shift & np.uint64(0xFF)) << np.uint64(3)) + r - before
    return shift.astype(np.int64) + _PLACES[at.astype(np.int64)]


class EliasFano:
    """A non-decreasing sequence of integers from 0 to 2^62: low bits packed, high bits in unary.

    ``parts`` are plain arrays, so a sequence can live in a mapped file. One directory entry a
    64-bit word counts set bits before it; that serves selection of ones and zeros.
    """

    NAMES = ("meta", "low", "high", "ones", "zeros")

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts
        self.n, self.width, self.top = (int(x) for x in parts["meta"])
        self.low, self.high, self.ones, self.zeros = (parts[k] for k in self.NAMES[1:])
        self.mask = np.uint64((1 << self.width) - 1)

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(n * width // 64 + 2, np.uint64)
        for at in range(0, n, 1 << 16 if width else max(n, 1)):
            part = values[at : at + (1 << 16)]
            if width:
                bits = ((part[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
                packed = np.packbits(bits.ravel(), bitorder="little")
                start = at * width // 8  # 2^16 values fill whole bytes
                low.view(np.uint8)[start : start + len(packed)] = packed
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        size = int(places[-1]) + 2 if n else 1
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(high).astype(np.int64)
        ones = np.cumsum(counts) - counts
        zeros = 64 * np.arange(len(high)) - ones
        kind = np.uint32 if size < 2**32 else np.int64
        return cls({"meta": np.array([n, width, top], np.int64), "low": low, "high": high, "ones": ones.astype(kind), "zeros": zeros.astype(kind)})

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        a, b = self.low[word] >> shift, self.low[word + 1] << (np.uint64(63) - shift) << np.uint64(1)
        return (a | b) & self.mask

    def _select(self, i: np.ndarray, zero: bool) -> np.ndarray:
        before = self.zeros if zero else self.ones
        word = np.searchsorted(before, i.astype(before.dtype), "right") - 1
        bits = self.high[word]
        return word * 64 + select_in_word(~bits if zero else bits, i - before[word].astype(np.int64))

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i."""
        if not len(i):
            return np.zeros(0, np.uint64)
        return ((self._select(i, False) - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Position of the first value >= x (n where there is none): two selections of zeros, then a search of one bucket's low bits."""
        x = np.asarray(x, np.uint64)
        out = np.full(len(x), self.n, np.int64)
        at = np.flatnonzero(x <= np.uint64(self.top)) if self.n else np.zeros(0, np.int64)
        if not len(at):
            return out
        x = x[at]
        h = (x >> np.uint64(self.width)).astype(np.int64)
        lo = np.zeros(len(at), np.int64)
        some = h > 0
        lo[some] = self._select(h[some] - 1, True) - (h[some] - 1)
        hi = np.full(len(at), self.n, np.int64)
        inner = h < self.top >> self.width
        hi[inner] = self._select(h[inner], True) - h[inner]
        want = x & self.mask
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            a, b = lo[open_], hi[open_]
            mid = (a + b) >> 1
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, a)
            hi[open_] = np.where(less, b, mid)
            open_ = open_[lo[open_] < hi[open_]]
        out[at] = lo
        return out

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, there or not) of each x."""
        i = self.successor(x)
        ok = i < self.n
        ok[ok] = self.get(i[ok]) == np.asarray(x, np.uint64)[ok]
        return i, ok


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """All arrays in one file, each at a multiple of 64 bytes. A repeated task replaces the file with the same."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text = len(text).to_bytes(8, "little") + text
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(text.ljust(-(-len(text) // 64) * 64, b"\0"))
        for a in arrays.values():
            f.write(a.tobytes().ljust(-(-a.nbytes // 64) * 64, b"\0"))
    os.replace(own, path)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped: pages come in as they are touched."""
    data = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(data[:8].tobytes(), "little")
    start = -(-(8 + size) // 64) * 64
    out = {}
    for name, (kind, n, at) in json.loads(data[8 : 8 + size].tobytes()).items():
        out[name] = data[start + at : start + at + n * np.dtype(kind).itemsize].view(kind)
    return out


def named(prefix: str, ef: EliasFano) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in ef.parts.items()}


def of(arrays: dict[str, np.ndarray], prefix: str) -> EliasFano:
    return EliasFano({k: arrays[f"{prefix}.{k}"] for k in EliasFano.NAMES})


def logs_to_bytes(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, book): probabilities as 8-bit steps, even on a log scale between the least and the largest."""
    if not len(p):
        return np.zeros(0, np.uint8), np.zeros(256, np.float64)
    x = np.log(p)
    low, high = float(x.min()), float(x.max())
    book = np.exp(np.linspace(low, high, 256))
    step = (high - low) / 255 or 1.0
    return np.rint((x - low) / step).astype(np.uint8), book
