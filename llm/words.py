"""Whole texts to words and 64-bit word hashes, a block of documents at a time.

Works on the UTF-8 bytes of an Arrow column: the word classes below are given by ASCII bytes alone, and
every byte of a longer character belongs to a word, so no text is decoded.  Blocks are cut by bytes
between documents, so memory follows the block and the longest single text, never the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1 << 20
LONG_WORD = 256  # bytes; longer words are hashed one by one

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def _bytes_of(*spans: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in spans:
        table[low:high + 1] = True
    return table


SPACED = ~_bytes_of((0x20, 0x20), (0x09, 0x0D))  # words are what ASCII white space leaves
ALNUM = ~_bytes_of((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))  # digits, a-z, everything beyond ASCII
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


@dataclass
class Block:
    """Words of some documents: word i is data[starts[i]:ends[i]]; document d has words bounds[d] to bounds[d+1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word."""
        size = (self.ends - self.starts).astype(np.int64)
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        load = np.ndarray(len(self.data) + 1, dtype="<u8", buffer=padded.tobytes(), strides=(1,))
        out = mix(size.astype(np.uint64) * _ODD + _ODD)
        live, at, left = np.arange(len(size)), self.starts, size
        while live.size:
            part = load[at] & _MASKS[np.minimum(left, 8)]
            out[live] = mix((out[live] + part) * _ODD)
            more = (left > 8) & (size[live] <= LONG_WORD)
            live, at, left = live[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i]:self.ends[i]].tobytes())
        return out

    def stems(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Hash of the first `size` bytes (8 at most) of each longer word; shorter words keep their own hash."""
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        load = np.ndarray(len(self.data) + 1, dtype="<u8", buffer=padded.tobytes(), strides=(1,))
        longer = np.flatnonzero(self.ends - self.starts > size)
        out = hashes.copy()
        out[longer] = mix((load[self.starts[longer]] & _MASKS[size]) * _ODD + np.uint64(size))
        return out

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of `width` words inside one document, and the index of its first word."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        rolled = hashes[:n].copy()
        for k in range(1, width):
            rolled = rolled * _ODD + hashes[k:k + n]
        fits = np.ones(n, dtype=bool)
        inner = self.bounds[1:-1]
        for k in range(1, width):  # a run may not reach over the first word of a later document
            cut = inner - k
            fits[cut[(cut >= 0) & (cut < n)]] = False
        first = np.flatnonzero(fits)
        return mix(rolled[first] + np.uint64(width)), first

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def split(texts: pa.Array, inside: np.ndarray, fold: bool = True) -> Block:
    """Words of a text column; a null text has none.  `inside` says which bytes belong to words, after folding A-Z."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, ends_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(ends_buffer, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    if fold:
        data = FOLD[data]
    n = len(data)
    word = np.zeros(n + 2, dtype=bool)
    word[1:-1] = inside[data]
    new = np.zeros(n + 1, dtype=bool)
    new[offsets] = True
    here = word[1:-1]
    starts = np.flatnonzero(here & (~word[:-2] | new[:-1]))
    ends = np.flatnonzero(here & (~word[2:] | new[1:])) + 1
    return Block(data, offsets, starts, ends, np.searchsorted(starts, offsets))


_kept: dict[str, Any] = {}  # what this worker holds from task to task


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What `make` returns, once for all tasks of a pass in this worker; passes whose `blocks` don't name it let it go."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one hold `limit` bytes at most, or one document.

    Workers outlive a pass, so all that one keeps but `keep` goes first, and Arrow's free memory goes back last.
    """
    for name in _kept.keys() - {keep}:
        del _kept[name]
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        start = 0
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(total, total[start] + limit, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()
