"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Separators of words: space and the five ASCII controls from tab to carriage return.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Text handled at once by a Python worker, in bytes.
SLICE_BYTES = 4 << 20
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class WordHash(dict):
    """64-bit hashes of words (bytes), memoised up to a bound."""

    def __init__(self, bound: int = 300_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; bytes.split() separates at exactly the six characters of WORD_SPLIT."""
    return utf8(text).split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * M1
    h = h ^ (h >> np.uint64(33))
    h = h * M2
    return h ^ (h >> np.uint64(33))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words, given the words' hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.full(m, np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))
    for i in range(n):
        out = (out ^ h[i : i + m]) * M1
        out = out ^ (out >> np.uint64(29))
    return mix(out)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about `most` bytes together; a longer text comes alone."""
    n = batch.num_rows
    if n == 0:
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if total and total + s > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += s
    yield batch.slice(start, n - start)


def vectors_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists of doubles: which rows hold a vector of finite numbers, their lengths, and all rows' places (offsets) in the flat values that `gathered` reads.

    Null and empty lists and lists with a null, NaN or infinite entry hold no vector.
    """
    if len(column) == 0:
        return np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.int64)
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    sizes = np.diff(offsets)
    there = np.ones(len(column), bool) if column.null_count == 0 else column.is_valid().to_numpy(zero_copy_only=False)
    return there & (sizes > 0) & (bad[offsets[1:]] == bad[offsets[:-1]]), sizes, offsets[:-1]


def gathered(column: pa.Array, starts: np.ndarray, dim: int) -> np.ndarray:
    """The vectors of `dim` entries that begin at these places of a column's flat values, as a matrix."""
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat[starts[:, None] + np.arange(dim)] if len(starts) else np.empty((0, dim))


def binaries(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of bytes."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    offsets = (np.arange(len(matrix) + 1, dtype=np.int64) * width).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix.tobytes())]).cast(pa.binary())
