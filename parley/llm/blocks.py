"""Texts of an Arrow batch as one byte array: words, shingles and hashes without a Python loop per word.

Hashes are 64-bit: a polynomial over the bytes modulo 2**64 with an odd base, finished by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
CHUNK_BYTES = 1 << 19  # texts are handled in pieces of about this many bytes; a longer text is one piece

_U = np.uint64
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse for i below ``n``, modulo 2**64."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.full(size, base, _U)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = x.astype(_U)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def pieces(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``size`` bytes."""
    if not batch.num_rows:
        return
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = (np.cumsum(n) - n) // size
    cut = np.flatnonzero(np.diff(run)) + 1
    for a, b in zip(np.r_[0, cut], np.r_[cut, batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    kind = pa.binary() if pa.types.is_binary(column.type) else pa.string()
    column = pc.fill_null(column, b"" if kind == pa.binary() else "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))


def is_space(data: np.ndarray) -> np.ndarray:
    """Bytes 0x20 and 0x09 to 0x0D."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``h[i]``: sum of ``(byte + 1) * BASE**position`` over the first ``i`` bytes."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, _U)
    out[1:] = data
    out[1:] += _U(1)
    out[1:] *= up
    return np.cumsum(out, out=out)


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes in [start, end), the same wherever they stand; not mixed."""
    _, down = powers(len(h))
    return (h[end] - h[start]) * down[start]


def word_bounds(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte range of each word, and the first word of each row with the number of words at the end.

    ``solid`` marks the bytes of words; by default all that are no white space.
    """
    n = len(data)
    solid = ~is_space(data) if solid is None else solid
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    stops = np.zeros(n + 1, bool)
    stops[1:] = solid
    stops[1:n] &= ~solid[1:]
    edge = offsets[:-1][offsets[:-1] < n]
    begins[edge] = solid[edge]
    edge = offsets[1:][offsets[1:] > 0]
    stops[edge] = solid[edge - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(stops), np.searchsorted(start, offsets)


class Words:
    """Words (runs of bytes that are no white space) of all texts of a column.

    start, end    byte range of each word
    doc           row of each word
    hash          64-bit hash of each word
    first         first word of each row, and the number of words at the end
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.start, self.end, self.first = word_bounds(data, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        h = range_hash(prefix_hash(data), self.start, self.end)
        self.hash = mix(h + (self.end - self.start).astype(_U) * _U(0xD6E8FEB86659FD93))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside a row, and the number of the first word of each."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(words.doc[:n] == words.doc[size - 1:])
    out = np.zeros(len(at), _U)
    for k in range(size):
        out = out * _U(BASE) + words.hash[at + k]
    return mix(out), at


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Per row its sorted distinct shingle hashes: windows of ``size`` words, or all words where there are fewer."""
    h, at = windows(words, size)
    edge = np.searchsorted(at, words.first)
    out = []
    for i, n in enumerate(words.counts()):
        if n >= size:
            out.append(np.unique(h[edge[i]:edge[i + 1]]))
        elif n:
            x = np.array([n], _U)
            for w in words.hash[words.first[i]:words.first[i + 1]]:
                x = mix(x * _U(BASE) + w)
            out.append(x)
        else:
            out.append(np.zeros(0, _U))
    return out


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows with equal ``key`` as one table each; the input must be sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        for a, b in zip(np.r_[0, cut], np.r_[cut, len(k)], strict=True):
            if held and k[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(int(a), int(b - a)))
            last = k[a]
    if held:
        yield pa.Table.from_batches(held)
