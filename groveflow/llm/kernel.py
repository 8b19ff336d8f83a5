"""Array kernels shared by the text operators: words, hashes, windows over Arrow string columns.

All of them work on whole texts as UTF-8 bytes. A batch is cut into slices of about half a megabyte (one text is
never cut), so that memory follows the slice or the longest single text, not the partition.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODES = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wraps around)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE + (1 << 17))
            for name, base in (("up", self.base), ("down", self.inverse)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))
        return self.up[:n], self.down[:n]


_POWERS = _Powers(int(_ODD))


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def trim() -> None:
    """Give freed memory back to the system: a worker lives on, and holds what the largest stage before has used."""
    if _trim is not None:
        _trim(0)


def texts(column) -> pa.Array:
    """The column as one string array; nulls are empty texts. Called for each batch, it also gives back freed memory."""
    trim()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each (one more offset than texts)."""
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(array: pa.Array, size: int = SLICE):
    """(first row, last row + 1) of runs of texts that hold about `size` bytes together; one text at least."""
    if not len(array):
        return
    _, offsets = bytes_of(array)
    at = 0
    while at < len(array):
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(max(end, at + 1), len(array))
        yield at, end
        at = end


def word_table(spec: str) -> np.ndarray:
    """256 entries: the lower-cased byte if it belongs to a word, else 0.

    `alnum`: digits, letters, and everything beyond ASCII; `space`: all but blanks and \\t to \\r.
    """
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    if spec == "alnum":
        keep = np.zeros(256, bool)
        keep[48:58] = keep[97:123] = keep[65:91] = keep[128:] = True
    elif spec == "space":
        keep = np.ones(256, bool)
        keep[[9, 10, 11, 12, 13, 32]] = False
    else:
        raise ValueError(f"unknown kind of words {spec!r}")
    codes = _BYTE_CODES[table]
    codes[~keep] = 0
    return codes


ALNUM, SPACED = word_table("alnum"), word_table("space")


class Words:
    """Words of a slice: byte bounds, 64-bit hash, first word of each text (`first` has one more entry)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashes: bool = True):
        n = len(data)
        codes = table[data]
        inside = np.empty(n + 1, bool)
        np.not_equal(codes, 0, out=inside[:n])
        inside[n] = False
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        cut = offsets[:-1][offsets[:-1] < n]
        begin[cut] = inside[cut]
        self.start = np.flatnonzero(begin)
        stop = np.zeros(n + 1, bool)
        stop[1:] = inside[:-1] & ~inside[1:]
        cut = offsets[1:][offsets[1:] > 0]
        stop[cut] = inside[cut - 1]
        self.stop = np.flatnonzero(stop)
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        if hashes:
            up, down = _POWERS.upto(n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(codes * up[:n], out=total[1:])
            self.hash = mix((total[self.stop] - total[self.start]) * down[self.start])

    def texts(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.count)), self.count)


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values (len(values) - k + 1 of them); k is part of the hash."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out *= _ODD
        out += values[j : j + n]
    return mix(out)


def sliding(values: np.ndarray, width: int, ufunc) -> np.ndarray:
    """ufunc (minimum or maximum) over each run of `width` values."""
    have = 1
    while have * 2 <= width:
        values = ufunc(values[: len(values) - have], values[have:])
        have *= 2
    if have < width:
        rest = width - have
        values = ufunc(values[: len(values) - rest], values[rest:])
    return values


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1 of all i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def lists(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
