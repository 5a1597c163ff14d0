"""Counts by 64-bit hash: packed on their way between tasks, kept as sorted arrays in files that workers map.

The hash space is cut into equal ranges, the shards; their number follows the bytes of the corpus, so one
shard's keys fit into a task.  Files lie in the folder that all executors share; a worker maps only what it
searches, and mapped pages belong to the operating system, so memory doesn't grow with the corpus.  A file
is written under another name and then renamed, so a repeated task leaves the same file.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.session import shared_folder

SHARD_BYTES = 16 << 20  # bytes of text for each shard
PENDING = 1 << 21  # keys that a task holds before it sends them on
OPEN_FILES = 1024


def mounted_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, as a path that workers can map."""
    base = shared_folder(spark)
    scheme, _, rest = base.rpartition("://") if "://" in base else ("file", "", base.removeprefix("file:"))
    if scheme != "file":
        raise ValueError(f"memory-mapped arrays need a mounted folder in spark.checkpoint.dir, not {scheme}://")
    folder = f"{rest}/{name}-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def remove_folder(folder: str) -> None:
    shutil.rmtree(folder, ignore_errors=True)


def shards_for(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    return max(1, -(-size // shard_bytes))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The range of the hash space that a key falls into; rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def squeeze(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, its first bytes, second bytes, ... together."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def expand(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def rising(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys; they have fewer bits."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Tally:
    """Counts of keys in one task; `full` says when to send them on."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > PENDING:
            self.parts = [self.sums()]
            self.held = len(self.parts[0][0])

    def full(self) -> bool:
        return self.held > PENDING // 2 and len(self.parts) == 1

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return added(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))

    def drain(self, shards: int) -> Iterator[tuple[int, list[bytes]]]:
        """(shard, packed keys and counts) of all held so far."""
        keys, counts = self.sums()
        self.parts, self.held = [], 0
        edges = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
        for shard in np.flatnonzero(edges[1:] > edges[:-1]):
            part = slice(edges[shard], edges[shard + 1])
            yield int(shard), [squeeze(rising(keys[part])), squeeze(counts[part].astype(np.int64))]


TALLY_SCHEMA = "shard int, data array<binary>"


def unpacked(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(expand(data[0], np.uint64), dtype=np.uint64), expand(data[1], np.int64)


@lru_cache(maxsize=OPEN_FILES)
def _mapped(path: str, kind: str) -> np.ndarray:
    if not os.path.exists(path):
        return np.zeros(0, dtype=kind)  # no key fell into this shard
    return np.memmap(path, dtype=kind, mode="r")


class Arrays:
    """Sorted keys in one file for each shard, and columns of the same length beside them."""

    def __init__(self, folder: str, name: str, shards: int, **kinds: str) -> None:
        self.folder, self.name, self.shards = folder, name, shards
        self.kinds = {"keys": "<u8", **kinds}

    def _path(self, column: str, shard: int) -> str:
        return f"{self.folder}/{self.name}-{shard}.{column}"

    def write(self, shard: int, **columns: np.ndarray) -> None:
        for column, values in columns.items():
            if len(values):
                path = self._path(column, shard)
                mine = f"{path}-{uuid.uuid4().hex}"
                np.ascontiguousarray(values, dtype=self.kinds[column]).tofile(mine)
                os.replace(mine, path)

    def find(self, keys: np.ndarray, *columns: str) -> tuple[np.ndarray, ...]:
        """For each of the sorted `keys` whether it is there, and the columns' values there (0 elsewhere).

        The column `place` is the key's place in its shard.
        """
        there = np.zeros(len(keys), dtype=bool)
        out = {c: np.zeros(len(keys), dtype=self.kinds.get(c, "<i8")) for c in columns}
        edges = np.searchsorted(shard_of(keys, self.shards), np.arange(self.shards + 1))
        for shard in np.flatnonzero(edges[1:] > edges[:-1]):
            part = slice(edges[shard], edges[shard + 1])
            known = _mapped(self._path("keys", int(shard)), "<u8")
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, keys[part]), len(known) - 1)
            there[part] = hit = known[at] == keys[part]
            for c in columns:
                values = at if c == "place" else _mapped(self._path(c, int(shard)), self.kinds[c])[at]
                out[c][part] = np.where(hit, values, 0)
        return there, *[out[c] for c in columns]

    def look_up(self, keys: np.ndarray, *columns: str) -> tuple[np.ndarray, ...]:
        """`find` for keys in any order, repeated or not."""
        if not len(keys):
            return self.find(keys, *columns)
        distinct, back = np.unique(keys, return_inverse=True)
        return tuple(v[back] for v in self.find(distinct, *columns))
