"""Words of batches of texts as positions in one byte buffer, with hashes of words and runs of words.

Everything is vectorised over the bytes of a batch; no word becomes a Python object.
"""

from __future__ import annotations

import numpy as np
import xxhash

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64

#: Odd multiplier of the rolling hashes and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, _U), np.ones(1, _U)
#: A random odd-looking value for each byte, so that sums of bytes say little about each other.
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n-1 of the multiplier and of its inverse."""
    global _powers  # grows as batches do
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        made = []
        for base in (_BASE, _INVERSE):
            a = np.full(size, base, _U)
            a[0] = 1
            made.append(np.cumprod(a, dtype=_U))
        _powers = tuple(made)
    return _powers[0][:n], _powers[1][:n]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordBatch:
    """Words of texts. `raw`: words joined by one blank, each followed by one; `starts`,
    `ends`: bytes of each word there; `bounds[i]:bounds[i + 1]`: the words of text i."""

    def __init__(self, texts: list, lower: bool = False):
        blobs = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        joined = b"\n".join(blobs) + b"\n"
        if lower:
            joined = joined.translate(_LOWER)
        buf = np.frombuffer(joined, np.uint8)
        inside = ~_BLANK[buf]
        shifted = np.empty_like(inside)
        shifted[0], shifted[1:] = False, inside[:-1]
        begins = np.flatnonzero(inside & ~shifted)
        sizes = np.flatnonzero(shifted & ~inside) - begins
        self.buf = np.where(inside, buf, np.uint8(32))[inside | shifted]
        self.raw = self.buf.tobytes()
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        lengths = np.fromiter(map(len, blobs), np.int64, len(blobs))
        at = np.concatenate(([0], np.cumsum(lengths + 1)))
        self.bounds = np.searchsorted(begins, at)
        self.counts = np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.empty(0, _U)
        power, inverse = _power(len(self.buf))
        sums = np.cumsum(_BYTE[self.buf] * power, dtype=_U)
        before = np.where(self.starts > 0, sums[self.starts - 1], _U(0))
        return scramble((sums[self.ends - 1] - before) * inverse[self.starts] + (self.ends - self.starts).astype(_U))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive values; shorter by n - 1 than hashes."""
    if len(hashes) < n:
        return np.empty(0, _U)
    power, inverse = _power(len(hashes))
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(hashes * power, dtype=_U)))
    return scramble((sums[n:] - sums[:-n]) * inverse[: len(hashes) - n + 1])


def spans_of(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run hashes[start:end], of any length; empty runs are alike."""
    power, inverse = _power(len(hashes) + 1)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(hashes * power[: len(hashes)], dtype=_U)))
    return scramble((sums[ends] - sums[starts]) * inverse[starts] + scramble((ends - starts).astype(_U)))


_P1, _P2, _P3, _P4, _P5 = map(_U, (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotate(x, n):
    return (x << _U(n)) | (x >> _U(64 - n))


def xxh64(raw: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span of raw. Spans are grouped by length, and those of one length hashed
    together; a length with few spans goes to the library one by one."""
    first = [_U((seed + x) % (1 << 64)) for x in (int(_P1) + int(_P2), int(_P2), 0, -int(_P1))]
    short = _U((seed + int(_P5)) % (1 << 64))
    out = np.empty(len(starts), _U)
    sizes = ends - starts
    order = np.argsort(sizes, kind="stable")
    marks = np.concatenate(([0], np.flatnonzero(np.diff(sizes[order])) + 1, [len(order)])) if len(order) else [0]
    buf = np.frombuffer(raw + b"\0" * 8, np.uint8)
    view = memoryview(raw)
    for a, b in zip(marks[:-1], marks[1:]):
        rows = order[a:b]
        size = int(sizes[rows[0]])
        if b - a < 24 or size > 256:
            out[rows] = [xxhash.xxh64_intdigest(view[s : s + size], seed) for s in starts[rows].tolist()]
            continue
        block = buf[starts[rows][:, None] + np.arange(-(-size // 8) * 8)] if size % 8 else buf[starts[rows][:, None] + np.arange(size)]
        lanes = np.ascontiguousarray(block).view("<u8").astype(_U, copy=False) if size else np.empty((b - a, 0), _U)
        halves = block.view("<u4") if size else None
        at = 0
        if size >= 32:
            v = [np.full(b - a, x, _U) for x in first]
            while size - 8 * at >= 32:
                for k in range(4):
                    v[k] = _rotate(v[k] + lanes[:, at + k] * _P2, 31) * _P1
                at += 4
            h = _rotate(v[0], 1) + _rotate(v[1], 7) + _rotate(v[2], 12) + _rotate(v[3], 18)
            for x in v:
                h = (h ^ (_rotate(x * _P2, 31) * _P1)) * _P1 + _P4
        else:
            h = np.full(b - a, short, _U)
        h = h + _U(size)
        while size - 8 * at >= 8:
            h = _rotate(h ^ (_rotate(lanes[:, at] * _P2, 31) * _P1), 27) * _P1 + _P4
            at += 1
        byte = 8 * at
        if size - byte >= 4:
            h = _rotate(h ^ (halves[:, byte // 4].astype(_U) * _P1), 23) * _P2 + _P3
            byte += 4
        while byte < size:
            h = _rotate(h ^ (block[:, byte].astype(_U) * _P5), 11) * _P1
            byte += 1
        h = (h ^ (h >> _U(33))) * _P2
        h = (h ^ (h >> _U(29))) * _P3
        out[rows] = h ^ (h >> _U(32))
    return out
