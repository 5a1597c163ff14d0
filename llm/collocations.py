"""Phrase collocations: runs of two to four words that stand together more often than their parts explain.

Method: Misra-Gries summaries.  Runs of one, two, three and four words are gone through in turn; a longer run
is only looked at where the two shorter ones in it survived.  Runs are dealt to hash partitions (shards), the
counts of tasks are merged there into one summary, and its capacity exceeds the partition's mass divided by
the threshold.  Then what a counter lost is less than the threshold, so every frequent run survives; one whose
counter and loss together stay below the threshold can't be frequent and goes.  Survivors lie as sorted arrays
in the shared folder.  A second pass counts them exactly, by their text, and the rest is joins over these counts.

Words: A-Z are lower-cased; pieces end at `.,;:!?` and line ends, words at blanks and tabs.  All counts are per
language, null being `und`.  A candidate's score is floor(SCALE * a / (l + r)) for its lowest-scoring cut, the
shortest first part among equals; it goes if its words lie inside a longer candidate with at least SHARE of its
count.  Products are decimals of 38 digits.  Ties in the ranking go to the larger count, then to the lower phrase.

Runs that share a 64-bit hash can only make a summary keep more; the second pass compares the hashes of all
single words with the run they are counted with, and Spark adds the counts by text.

Nulls, empty tables and rows: a null or empty text has no words; an empty table gives no rows; every row counts,
repeated or not.  Texts are read whole, in blocks cut between documents.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codewarden.session import cut_lineage
from llm import hashed, words

LONGEST = 4
LEAST = 30  # occurrences of a candidate
SHARE = 80  # percent of its count that a longer candidate needs to take its place
SCALE = 2_000_000
TOP = 2_000
BUCKETS = 64  # parts of a language that are ranked before the language is

SPLITS = words._bytes_of(*[(b, b) for b in b".,;:!?"], (0x0A, 0x0D))
INSIDE = ~(SPLITS | words._bytes_of((0x20, 0x20), (0x09, 0x09)))
_ODD = np.uint64(0x9E3779B97F4A7C15)


class MisraGries:
    """At most `capacity` counters; no count is short by more than `lost`, and no counter is too high."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        """Add another summary (or exact counts): add up, then take the largest count that doesn't fit from all."""
        self.keys, self.counts = hashed.added(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        self.lost += lost
        over = len(self.counts) - self.capacity
        if over > 0:
            cut = int(np.partition(self.counts, over - 1)[over - 1])
            kept = self.counts > cut
            self.keys, self.counts, self.lost = self.keys[kept], self.counts[kept] - cut, self.lost + cut

    def possible(self, least: int) -> np.ndarray:
        """The keys, sorted, whose true count may reach `least`."""
        return self.keys[self.counts + self.lost >= least]


class Runs:
    """Runs of words inside the pieces of a batch (text, lang); `hashes[k]`, `valid[k]` by first word, for k words."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.block = block = words.split(batch.column(0), INSIDE)
        self.langs = batch.column(1).fill_null("und").to_pylist()
        self.doc = np.repeat(np.arange(len(block)), np.diff(block.bounds))
        breaks = np.concatenate([[0], np.cumsum(SPLITS[block.data], dtype=np.int64)])
        self.word = block.hashes()
        self.joined = (self.doc[1:] == self.doc[:-1]) & (breaks[block.starts[1:]] == breaks[block.ends[:-1]])
        own = {name: xxhash.xxh3_64_intdigest(name.encode()) for name in set(self.langs)}
        lang = np.array([own[name] for name in self.langs], dtype=np.uint64)
        self.hashes = {1: words.mix(self.word + lang[self.doc])}
        self.valid = {1: np.ones(len(self.word), dtype=bool)}

    def grow(self, k: int) -> None:
        """Runs of k words from those of k - 1."""
        n = max(0, len(self.word) - k + 1)
        self.hashes[k] = words.mix(self.hashes[k - 1][:n] * _ODD + self.word[k - 1:])
        self.valid[k] = self.valid[k - 1][:n] & self.joined[k - 2:]

    def kept(self, k: int, survivors: list[hashed.Arrays]) -> np.ndarray:
        """First words of the runs of k words that the survivors of k words hold."""
        first = np.flatnonzero(self.valid[k])
        return first[survivors[k - 1].look_up(self.hashes[k][first])[0]]

    def possible(self, k: int, survivors: list[hashed.Arrays]) -> np.ndarray:
        """First words of the runs of k words whose two shorter runs survived."""
        for size in range(2, k + 1):
            self.grow(size)
        if k == 1:
            return np.flatnonzero(self.valid[1])
        short = np.zeros(len(self.word) + 1, dtype=bool)
        short[self.kept(k - 1, survivors)] = True
        n = len(self.valid[k])
        return np.flatnonzero(self.valid[k] & short[:n] & short[1:n + 1])

    def texts(self, first: np.ndarray, k: int) -> pa.Array:
        """The words of each run, one blank between them."""
        block = self.block
        at = first[:, None] + np.arange(k)
        size = (block.ends - block.starts)[at].ravel()
        step = size + 1
        to = np.cumsum(step) - step  # each word and the blank after it, one after another
        total = int(step.sum())
        out = np.full(total, 0x20, dtype=np.uint8)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to, size) + inner] = block.data[np.repeat(block.starts[at].ravel(), size) + inner]
        last = np.zeros(total, dtype=bool)
        ends = to[k - 1::k] + size[k - 1::k]
        last[ends] = True  # the blank after a run
        offsets = np.concatenate([[0], ends - np.arange(len(ends))])
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out[~last].tobytes())])


def _summarise(docs: DataFrame, k: int, survivors: list[hashed.Arrays], kept: hashed.Arrays, least: int) -> tuple[int, int, int]:
    """Write the runs of k words that may be frequent; returns their number, the mass and the largest loss."""
    shards = kept.shards

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = hashed.Tally()

        def sent() -> Iterator[pa.RecordBatch]:
            rows = list(tally.drain(shards))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.list_(pa.binary()))],
                                             names=["shard", "data"])

        for batch in words.blocks(batches):
            runs = Runs(batch)
            first = runs.possible(k, survivors)
            tally.add(runs.hashes[k][first])
            if tally.full():
                yield from sent()
        yield from sent()

    def merge(rows: pa.Table) -> pa.Table:
        data = rows.column("data")
        mass = sum(int(hashed.expand(d[1].as_py(), np.int64).sum()) for d in data)
        summary = MisraGries(mass // least + 1)
        waiting, held = [], 0
        for d in data:
            waiting.append(hashed.unpacked([x.as_py() for x in d]))
            held += len(waiting[-1][0])
            if held > summary.capacity:
                summary.merge(*map(np.concatenate, zip(*waiting)))
                waiting, held = [], 0
        if waiting:
            summary.merge(*map(np.concatenate, zip(*waiting)))
        keys = summary.possible(least)
        kept.write(rows.column("shard")[0].as_py(), keys=keys)
        return pa.table({"kept": pa.array([len(keys)], pa.int64()), "mass": pa.array([mass], pa.int64()), "lost": pa.array([summary.lost], pa.int64())})

    merged = docs.mapInArrow(count, hashed.TALLY_SCHEMA).groupBy("shard").applyInArrow(merge, "kept long, mass long, lost long")
    return tuple(merged.agg(*[F.coalesce(f(c), F.lit(0)) for f, c in ((F.sum, "kept"), (F.sum, "mass"), (F.max, "lost"))]).first())


def _exact(docs: DataFrame, survivors: list[hashed.Arrays]) -> DataFrame:
    """(lang, phrase, size, n) of all survivors; a null phrase counts all words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.blocks(batches):
            runs = Runs(batch)
            langs = pa.array(runs.langs, pa.string())
            total = np.diff(runs.block.bounds)
            out = [(langs, pa.nulls(len(langs), pa.large_string()), np.zeros(len(langs), np.int32), total)]
            for k in range(1, LONGEST + 1):
                if k > 1:
                    runs.grow(k)
                first = runs.kept(k, survivors)
                _, place, back, n = np.unique(runs.hashes[k][first], return_index=True, return_inverse=True, return_counts=True)
                own = first[place]
                other = np.zeros(len(first), dtype=bool)  # runs of other words with the same hash
                for j in range(k):
                    other |= runs.word[first + j] != runs.word[own[back] + j]
                if other.any():
                    n = n - np.bincount(back[other], minlength=len(n))
                    own, n = np.concatenate([own, first[other]]), np.concatenate([n, np.ones(int(other.sum()), np.int64)])
                out.append((langs.take(pa.array(runs.doc[own])), runs.texts(own, k), np.full(len(own), k, np.int32), n))
            for lang, phrase, size, n in out:
                yield pa.RecordBatch.from_arrays([lang, phrase.cast(pa.string()), pa.array(size, pa.int32()), pa.array(n, pa.int64())],
                                                 names=["lang", "phrase", "size", "n"])

    return docs.mapInArrow(count, "lang string, phrase string, size int, n long").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


def frequent_runs(docs: DataFrame, least: int = LEAST, shard_bytes: int = hashed.SHARD_BYTES) -> DataFrame:
    """(lang, phrase, size, n): every run of one to four words with `least` occurrences or more; a null phrase for all words."""
    spark = docs.sparkSession
    rows = docs.select("text", F.col("lang").cast("string").alias("lang"))
    folder, shards = hashed.mounted_folder(spark, "collocations"), hashed.shards_for(rows, shard_bytes)
    survivors: list[hashed.Arrays] = []
    try:
        for k in range(1, LONGEST + 1):
            kept = hashed.Arrays(folder, f"runs{k}", shards)
            _summarise(rows, k, survivors, kept, least)
            survivors.append(kept)
        return cut_lineage(_exact(rows, survivors).where((F.col("n") >= least) | F.col("phrase").isNull()))
    finally:
        hashed.remove_folder(folder)


def _joined(parts: str, low: int, high: int) -> Column:
    return F.array_join(F.slice(parts, low, high), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shard_bytes: int = hashed.SHARD_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` of each language."""
    counts = frequent_runs(docs, least, shard_bytes)
    runs = counts.where("phrase IS NOT NULL").withColumn("w", F.split("phrase", " "))
    candidates = runs.where("size >= 2")

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "size", F.col("n").alias("a"), "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"),
        F.expr("array_join(slice(w, k + 1, size - k), ' ')").alias("tail"))
    part = lambda side, name: runs.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    scored = (cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
              .withColumn("score", F.expr(f"CAST(a AS DECIMAL(20, 0)) * {SCALE} div (CAST(l AS DECIMAL(20, 0)) + r)").cast("long")))
    lowest = scored.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = [(low, size) for size in (2, 3) for low in range(1, LONGEST)]
    within = reduce(DataFrame.unionByName, [
        candidates.where(f"size > {size} AND size >= {low + size - 1}").select("lang", _joined("w", low, size).alias("phrase"), F.col("n").alias("longer"))
        for low, size in inner])
    within = within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = (lowest.join(within, ["lang", "phrase"], "left")
            .where(F.expr(f"longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {SHARE}"))
            .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = left.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*best))).where(F.col("rank") <= top)
    ranks = some.drop("bucket").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("phrase IS NULL").select("lang", F.col("n").alias("total"))
    return ranks.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def oracle_sql(least: int = LEAST, top: int = TOP) -> str:
    """The same in SQL: all runs are written out."""
    runs = " UNION ALL ".join(f"SELECT lang, {k} AS size, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase "
                              f"FROM p WHERE len(w) >= {k}" for k in range(1, LONGEST + 1))
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, n AS a, {k} AS k, array_to_string(w[1:{k}], ' ') AS head, array_to_string(w[{k + 1}:], ' ') AS tail "
                              f"FROM f WHERE size > {k}" for k in range(1, LONGEST))
    inner = " UNION ALL ".join(f"SELECT lang, n AS longer, array_to_string(w[{low}:{low + size - 1}], ' ') AS phrase FROM f WHERE size > {size} AND size >= {low + size - 1}"
                               for size in (2, 3) for low in range(1, LONGEST))
    return rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS MATERIALIZED (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, count(*) AS n FROM ({runs}) GROUP BY lang, size, phrase HAVING count(*) >= {least}),
cut AS (SELECT c.lang, c.phrase, c.a, c.k, h.n AS l, t.n AS r, ({SCALE} * c.a::HUGEINT // (h.n + t.n))::BIGINT AS score
        FROM ({cuts}) c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, phrase, max(longer) AS longer FROM ({inner}) GROUP BY lang, phrase),
kept AS (SELECT x.* FROM lowest x LEFT JOIN inside i ON i.lang = x.lang AND i.phrase = x.phrase WHERE i.longer IS NULL OR 100 * i.longer < {SHARE} * x.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, total.n, k.score FROM ranked k JOIN total ON total.lang = k.lang WHERE k.rank <= {top}"""
