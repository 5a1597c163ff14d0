"""Quality rules: plain counts of a text, and its likelihood under trusted text against raw text.

Features are hashed n-grams: words, pairs of words, and runs of other signs.  Two multinomials over BUCKETS
are counted over all documents: raw (every document) and target (documents labelled as trusted), the target
with PRIOR features of the raw mixture beneath it.  A document's ratio is the mean over its features of
log target - log raw; it is kept from the threshold on.  The same text always has the same verdict.

Every trusted document teaches the target, and every document counts as raw.  Trusted ids are broadcast in blocks of
about llm.tables.TEACH_ROWS: the first block meets the documents in the pass that counts raw, each further one takes a pass
that counts its own documents alone, so no text is shuffled.  The counts reach the driver as BUCKETS rows at any corpus size.

Nulls and ties: a null or empty text has no words and fails the base rules; its ratio is 0.  Repeated rows
are judged alike.  Without trusted documents all ratios are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import words
from llm.tables import TEACH_ROWS, id_blocks

BUCKETS = 1 << 16
PRIOR = 50.0
LEAST_RATIO = -0.1
LEAST_WORDS, MOST_REPEATED = 50, 50
SIGNS = ~words.ALNUM & words.SPACED
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every feature."""
    named, signs = words.split(texts, words.ALNUM, fold=False), words.split(texts, SIGNS, fold=False)
    hashes = named.hashes()
    pairs, first = named.windows(hashes, 2)
    owner, other = np.repeat(np.arange(len(named)), np.diff(named.bounds)), np.repeat(np.arange(len(signs)), np.diff(signs.bounds))
    every = np.concatenate([hashes, pairs, signs.hashes()])
    return (every % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([owner, owner[first], other])


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def plain_counts(texts: pa.Array) -> list[np.ndarray]:
    """The base counts of each text, in the order of COUNTS."""
    block = words.split(texts, words.SPACED, fold=False)
    n = np.diff(block.bounds)
    inside = words.SPACED[block.data] & ((block.data & 0xC0) != 0x80)
    rolled, first = block.windows(block.hashes(), 3)
    owner = np.repeat(np.arange(len(block)), n)
    _, back, uses = np.unique(words.mix(rolled + owner[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    again = first[uses[back] > 1]
    covered = np.zeros(len(block.starts) + 3, dtype=bool)
    for k in range(3):
        covered[again + k] = True
    repeated = np.zeros(len(block), dtype=np.int64)
    for d in range(len(block)):
        raw = block.data[block.offsets[d]:block.offsets[d + 1]].tobytes()
        lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
        repeated[d] = len(lines) - len(set(lines))
    return [n, sums(inside, block.offsets), sums(SYMBOLS[block.data], block.offsets), repeated, sums(covered[:len(block.starts)], block.bounds)]


def multinomials(docs: DataFrame, trusted: DataFrame, block: int = TEACH_ROWS) -> np.ndarray:
    """Log target - log raw of every bucket; all documents whose id is in `trusted` (doc_id, ...) make the target."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in words.blocks(batches):
            place, owner = features(batch.column(0))
            good = batch.column(1).fill_null(0).to_numpy()[owner] > 0
            total[0] += np.bincount(place, minlength=BUCKETS)
            total[1] += np.bincount(place[good], minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[k][at]) for k in (0, 1))], names=["b", "n0", "n1"])

    def counted(ids: DataFrame, how: str) -> np.ndarray:
        rows = docs.select("doc_id", "text").join(F.broadcast(ids.withColumn("label", F.lit(1))), "doc_id", how).select("text", "label")
        sums = rows.mapInArrow(run, "b long, n0 long, n1 long").groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        total = np.zeros((2, BUCKETS))
        for batch in sums.toArrow().to_batches():  # BUCKETS rows at most
            total[:, batch.column(0).to_numpy()] = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        return total

    first, *others = id_blocks(trusted, block)
    raw, target = counted(first, "left")
    for ids in others:
        target += counted(ids, "inner")[1]
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log(target + PRIOR) - np.log(raw * (target.sum() / raw.sum()) + PRIOR)


def judge(docs: DataFrame, labels: DataFrame, value: str = "quality", least: float = LEAST_RATIO,
          keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns with the base counts, base_failed, the ratio and whether the document is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(multinomials(docs, labels.where(F.col(value) > 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.blocks(batches):
            names = batch.schema.names
            texts = batch.column(names.index("text"))
            counts = plain_counts(texts)
            place, owner = features(texts)
            size = np.bincount(owner, minlength=len(texts))
            ratio = np.bincount(owner, weights=shared.value[place], minlength=len(texts)) / np.maximum(1, size)
            failed = (counts[0] < LEAST_WORDS) | (100 * counts[4] > MOST_REPEATED * counts[0])
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in keep], *map(pa.array, counts), pa.array(failed), pa.array(ratio),
                                              pa.array(~failed & (ratio >= least))], names=[*keep, *COUNTS, "base_failed", "ratio", "kept"])

    kinds = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} long" for c in COUNTS)])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{kinds}, base_failed boolean, ratio double, kept boolean")
