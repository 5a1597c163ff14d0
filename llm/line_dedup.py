"""Removal of lines that stand, the same or nearly, in an earlier place of the corpus.

Two lines of at least NEAR_WORDS words are near when one edit of a word (another word, one more, one less)
makes one the other; shorter lines repeat by being equal alone.  A line is removed when a near or equal line
stands in a document of smaller doc_id, or earlier in its own.

Method: deletion neighbourhood.  Dropping one word of either line leads two near lines to a common
variant.  A variant's key holds what tells the cases apart - the place of the word left out, or that
nothing is - and each join of equal variants is verified by the edit distance of the words themselves.

1. Each line that has a word is a row of hashes; equal lines become one class, its earliest
   place found by minima that combine before the shuffle.
2. Near lines share their first or their last half.  Only classes of long lines that share a half with another one,
   few in any corpus, are read again and send out all their variants.
3. Within a variant each class meets the earliest ones only (of full lines, of lines less a word), not
   all; whether an earlier near line exists needs no more.
4. Documents with lines to remove are rebuilt; all others pass unchanged.

Lines are split at \\n; words are what ASCII white space leaves, A-Z lower-cased.  Lines without words stay.
Nulls and ties: null texts and rows with a null doc_id stay as they are, and remove nothing.  Rows that
share a doc_id are one document whose order is unknown: they don't remove each other's lines.  A text
whose lines all go becomes empty.  Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codewarden.session import cut_lineage
from llm import words
from llm.jaccard_join import SIEVE_BITS, sieve

NEAR_WORDS = 20  # of a line that may go for a near one; one word of a shorter line says more


def least(min_words: int | None) -> tuple[int, int]:
    """Words of a line that takes part, and of one that has near lines."""
    return (1, NEAR_WORDS) if min_words is None else (min_words, min_words)


_PLACE = np.uint64(0x9FB21C651E98DF25)
_HALVES = [np.uint64(k) for k in (0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407)]
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, _BASE, dtype=np.uint64)]))


def line_hashes(hashes: np.ndarray) -> np.ndarray:
    """Sums h[0] + h[1] B + ... before each word, so that any run of words is a difference of two."""
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * _powers(len(hashes))[:-1], dtype=np.uint64)])


@np.errstate(over="ignore")
def variants(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a line: of all words (for lines with one more), of all but word i by place and by content.

    Returns (keys, kinds): kind 0 the whole line, 1 a line less one word that meets whole lines, 2 a line
    less the word at a place, which meets lines that differ there.
    """
    n = len(hashes)
    sums = line_hashes(hashes)
    less = sums[:-1] + (sums[-1] - sums[1:]) * _INVERSE
    size = np.uint64(n)
    whole = words.mix(sums[-1:] + size * _PLACE)
    return (np.concatenate([whole, words.mix(less + (size - np.uint64(1)) * _PLACE),
                            words.mix(words.mix(less + size * _PLACE) + np.arange(1, n + 1, dtype=np.uint64) * _HALVES[0])]),
            np.concatenate([np.zeros(1, np.int32), np.ones(n, np.int32), np.full(n, 2, np.int32)]))


@dataclass
class Lines:
    """The lines of a block that are long enough: document, number, first and end word of each."""

    block: words.Block
    hashes: np.ndarray
    doc: np.ndarray
    number: np.ndarray
    low: np.ndarray
    high: np.ndarray


def lines_of(texts: pa.Array, min_words: int) -> Lines:
    block = words.split(texts, words.SPACED)
    breaks = np.flatnonzero(block.data == 10)
    owner = np.searchsorted(block.offsets, breaks, side="right") - 1
    doc = np.concatenate([np.arange(len(block)), owner])
    number = np.concatenate([np.zeros(len(block), np.int64), np.arange(len(breaks)) - np.searchsorted(owner, owner) + 1])
    low = np.concatenate([block.bounds[:-1], np.searchsorted(block.starts, breaks)])
    order = np.lexsort((number, doc))
    doc, number, low = doc[order], number[order], low[order]
    last = np.append(doc[1:] != doc[:-1], [True] * bool(len(doc)))
    high = np.where(last, block.bounds[1:][doc], np.append(low[1:], 0)) if len(doc) else low
    long = high - low >= min_words
    return Lines(block, block.hashes(), doc[long], number[long], low[long], high[long])


def line_keys(lines: Lines) -> np.ndarray:
    """Five keys of each line: of itself; of the halves that it shares with near lines if it is the shorter of
    the two; if it has a word more."""
    h, low, high = lines.hashes, lines.low, lines.high
    power = _powers(len(h))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * power[:-1], dtype=np.uint64)])
    back = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(len(h), _INVERSE, dtype=np.uint64)]))

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (sums[b] - sums[a]) * back[a]

    n = high - low
    out = [run(low, high) + n.astype(np.uint64) * _PLACE]
    for size in (n, n - 1):  # words of the shorter line
        half, u = size // 2, size.astype(np.uint64)
        out += [run(low, low + half) + u * _HALVES[0], run(high - size + half, high) + u * _HALVES[1]]
    return words.mix(np.stack(out, axis=1))


LINE = "text_hash long, line int, n int, h long, p1 long, s1 long, p2 long, s2 long"


def lines(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """(doc_id, text_hash, line, n, h, halves) of each first occurrence in its document; later ones have n = 0.

    Lines under `near_words` have no halves.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.blocks(batches):
            found = lines_of(batch.column(2), min_words)
            keys = line_keys(found)
            n = np.zeros(len(keys), dtype=np.int32)
            _, once = np.unique(words.mix(keys[:, 0] + found.doc.astype(np.uint64) * _PLACE), return_index=True)
            n[once] = (found.high - found.low)[once]
            picked, keyed, short = pa.array(found.doc), keys.view(np.int64), found.high - found.low < near_words
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), pa.array(found.number.astype(np.int32)), pa.array(n),
                                              *(pa.array(keyed[:, k].copy(), mask=short if k else None) for k in range(5))], names=["doc_id", *(c.split()[0] for c in LINE.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, {LINE}")


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word more, less or other makes one line the other; equal lines are no edit apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def near_classes(docs: DataFrame, classes: DataFrame, near_words: int) -> DataFrame:
    """(h) of the classes that have an earlier near class.  `classes`: h, doc_id, line and the halves."""
    half = F.explode(F.array(F.col("p1"), F.col("s1"), F.col("p2"), F.col("s2"))).alias("half")
    group = Window.partitionBy("half")
    shared = (classes.where("p1 IS NOT NULL").select("h", half).withColumn("low", F.min("h").over(group)).withColumn("high", F.max("h").over(group))
              .where("low <> high").select("h").distinct())
    asked = cut_lineage(classes.join(shared, "h", "left_semi").select("h", "doc_id", "line"))
    bits = docs.sparkSession.sparkContext.broadcast(sieve(asked, "doc_id"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(2).to_numpy(zero_copy_only=False)
            hit = pa.array(((bits.value[place >> 6] >> (place & 63)) & 1) == 1)
            batch = pa.RecordBatch.from_arrays([batch.column(k).filter(hit) for k in (0, 1)], names=["doc_id", "text"])
            for some in words.blocks(iter([batch])):
                found = lines_of(some.column(1), near_words)
                content = [b" ".join(map(found.block.word, range(low, high))) for low, high in zip(found.low, found.high, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(found.doc)), pa.array(found.number.astype(np.int32)),
                                                  pa.array(line_keys(found)[:, 0].copy().view(np.int64)), pa.array(content, pa.binary())],
                                                 names=["doc_id", "line", "h", "words"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = words.split(batch.column(1), words.SPACED)
            hashes = block.hashes()
            for d in range(len(block)):
                key, kind = variants(hashes[block.bounds[d]:block.bounds[d + 1]])
                picked = pa.array(np.full(len(key), d))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind), *(batch.column(k).take(picked) for k in (0, 2, 3))],
                                                 names=["variant", "kind", "h", "doc_id", "line"])

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [one_edit(a.split(), b.split()) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_()))], names=["h"])

    key = docs.schema["doc_id"].dataType.simpleString()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE_BITS))
    found = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", place.alias("place")).mapInArrow(
        near, f"doc_id {key}, line int, h long, words binary")
    found = cut_lineage(found.join(asked, ["h", "doc_id", "line"], "left_semi").dropDuplicates(["h"]))
    rows = found.select("h", "words", "doc_id", "line").mapInArrow(spread, f"variant long, kind int, h long, doc_id {key}, line int")
    spot = F.struct("doc_id", "line", "h")
    same = Window.partitionBy("variant")
    # kind 0 lines are the variant itself, kind 1 lines have a word more; two of kind 1 may be two edits apart.
    met = (rows.withColumn("whole", F.min(F.when(F.col("kind") == 0, spot)).over(same))
           .withColumn("longer", F.min(F.when(F.col("kind") == 1, spot)).over(same))
           .withColumn("other", F.min(F.when(F.col("kind") == 2, spot)).over(same)))
    earlier = F.when(F.col("kind") == 0, F.col("longer")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("other"))
    pairs = (met.withColumn("first", earlier).where(F.col("first").isNotNull() & (F.col("first.h") != F.col("h")))
             .where(F.struct("first.doc_id", "first.line") < F.struct("doc_id", "line"))
             .select("h", F.col("first.h").alias("g")).distinct())
    texts = found.select("h", "words")
    both = (pairs.join(texts, "h").join(texts.select(F.col("h").alias("g"), F.col("words").alias("earlier")), "g")
            .select("h", "words", "earlier"))
    return both.mapInArrow(confirmed, "h long").distinct()


def removed_lines(docs: DataFrame, min_words: int | None = None) -> DataFrame:
    """(doc_id, text_hash, removed): line numbers, from 0, that go from each document."""
    min_words, near_words = least(min_words)
    every = cut_lineage(lines(docs, min_words, near_words))
    named = every.where("n > 0")
    first = named.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("uses"))
    once = named.join(first.drop("uses"), ["h", "doc_id"]).groupBy("h", "doc_id").agg(
        F.min("line").alias("line"), *(F.first(c).alias(c) for c in ("p1", "s1", "p2", "s2")))
    near = cut_lineage(near_classes(docs, once, near_words))
    gone = (first.where("uses > 1").select("h", F.col("doc_id").alias("kept")).join(near.withColumn("near", F.lit(True)), "h", "full"))
    hit = named.join(gone, "h").where("near OR doc_id > kept")
    again = every.where("n = 0")
    return (hit.select("doc_id", "text_hash", "line").unionByName(again.select("doc_id", "text_hash", "line"))
            .groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("removed")))


def dedup_lines(docs: DataFrame, min_words: int | None = None) -> DataFrame:
    """`docs` with their text less the removed lines, and removed: the numbers of those lines (empty: unchanged).

    Lines under `min_words` stay; without it all lines that have a word take part, and those under NEAR_WORDS
    go for equal lines alone.
    """
    gone = removed_lines(docs, min_words)
    columns = [c for c in docs.columns if c not in ("removed", "text_hash")]
    rows = docs.select(*columns).withColumn("text_hash", F.xxhash64("text"))
    met = rows.join(gone.hint("shuffle_hash"), ["doc_id", "text_hash"], "left")
    left = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("removed", i))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return met.select(*(text.alias("text") if c == "text" else F.col(c) for c in columns),
                      F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
