"""Benchmark decontamination: 13-word windows of benchmark items, looked up in every window of every text.

The windows of the items are hashed into a set that each task receives; hits are verified on the words
themselves.  The set is broadcast in blocks of at most BLOCK_BYTES of item text (or one item), and a document
meets all blocks in one Python step: each step of a task is a worker of its own, which Spark keeps.  A worker
holds the windows of all blocks; the result is the same for one block and for many.

Nulls and ties: null or empty texts have no words and no hits; null or empty items have no windows.  Items
with equal windows each count; items that share an item_id count once.  Rows are judged one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import words

WINDOW = 13
PERCENT = 5  # share of hit words from which a document is contaminated
BLOCK_BYTES = 8 << 20
SIEVE = 1 << 20  # bits tried before the search in the set
SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Windows:
    """The windows of some items: by length, sorted hashes with a sieve; and which items have each."""

    def __init__(self, items: list[tuple[str, str | None]], width: int) -> None:
        self.items: dict[bytes, set[str]] = {}
        found: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            block = words.split(pa.array([text], pa.string()), words.ALNUM)
            n = len(block.starts)
            size = min(n, width)
            if not n:
                continue
            hashes, first = block.windows(block.hashes(), size)
            found.setdefault(size, []).append(hashes)
            own = [block.word(i) for i in range(n)]
            for i in first:
                self.items.setdefault(b" ".join(own[i:i + size]), set()).add(item)
        self.sets = {}
        for size, parts in found.items():
            known = np.unique(np.concatenate(parts))
            sieve = np.zeros(SIEVE, dtype=bool)
            sieve[(known % np.uint64(SIEVE)).astype(np.int64)] = True
            self.sets[size] = known, sieve

    def hits(self, block: words.Block, hashes: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, words, items) of every verified window."""
        for size, (known, sieve) in self.sets.items():
            rolled, first = block.windows(hashes, size)
            maybe = np.flatnonzero(sieve[(rolled % np.uint64(SIEVE)).astype(np.int64)])
            at = np.minimum(np.searchsorted(known, rolled[maybe]), len(known) - 1)
            for i in first[maybe[known[at] == rolled[maybe]]]:
                items = self.items.get(b" ".join(block.word(k) for k in range(i, i + size)))
                if items:
                    yield int(i), size, items


def _judged(docs: DataFrame, windows: list[Broadcast], carried: list[str], percent: int, clean: bool) -> DataFrame:
    """Counts of each document from its spans (first word, end word) in all blocks of windows; with `clean`, also its text without the words hit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.blocks(batches):
            names = batch.schema.names
            texts = batch.column(names.index("text"))
            block = words.split(texts, words.ALNUM)
            hashes, total = block.hashes(), np.diff(block.bounds)
            spans: list[list[int]] = [[] for _ in total]
            items: list[set[str]] = [set() for _ in total]
            for known in windows:
                for i, size, found in known.value.hits(block, hashes):
                    d = int(np.searchsorted(block.bounds, i, side="right")) - 1
                    low = i - int(block.bounds[d])
                    if spans[d] and spans[d][-2] <= low <= spans[d][-1]:
                        spans[d][-1] = max(spans[d][-1], low + size)
                    else:
                        spans[d] += [low, low + size]
                    items[d] |= found
            hit, out = np.zeros(len(total), dtype=np.int64), texts.to_pylist() if clean else None
            for d in range(len(total)):
                if not spans[d]:
                    continue
                mark = np.zeros(total[d] + 2, dtype=bool)
                for low, high in zip(spans[d][::2], spans[d][1::2], strict=True):
                    mark[low + 1:high + 1] = True
                hit[d] = mark.sum()
                if clean:
                    edges = np.flatnonzero(mark[1:] != mark[:-1]).reshape(-1, 2) + block.bounds[d]
                    raw, base, at, kept = out[d].encode(), int(block.offsets[d]), 0, []
                    for low, high in edges:
                        kept.append(raw[at:int(block.starts[low]) - base])
                        at = int(block.ends[high - 1]) - base
                    out[d] = b"".join([*kept, raw[at:]]).decode()
            digest = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
            columns = [pa.array(total), pa.array(hit), pa.array([len(i) for i in items], pa.int64()), pa.array(digest, pa.string()),
                       pa.array((hit > 0) & (100 * hit >= percent * total))]
            extra = [pa.array(out, pa.string())] if clean else []
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in carried], *columns, *extra],
                                             names=[*carried, *(c.split()[0] for c in SCHEMA.split(", ")), *["clean_text"] * clean])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.mapInArrow(run, f"{kinds}, {SCHEMA}" + ", clean_text string" * clean)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, percent: int = PERCENT,
                  keep: tuple[str, ...] = ("doc_id",), clean: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`keep` columns of each document with its words, hit words, items met, their digest and the verdict.

    `clean` adds clean_text, the text without the hit spans.  `docs` has text, `benchmark` item_id and text.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL AND text <> ''")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // block_bytes))
    carried = list(dict.fromkeys([*keep, "text"]))
    windows = []
    for part in range(parts):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()  # at most about block_bytes
        windows.append(docs.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in some], width)))
    return _judged(docs.select(*carried), windows, carried, percent, clean).select(*keep, *(c.split()[0] for c in SCHEMA.split(", ")), *["clean_text"] * clean)
