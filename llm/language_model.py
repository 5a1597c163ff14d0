"""Perplexity by an interpolated modified Kneser-Ney n-gram model, counted in Spark and searched in mapped arrays.

Tokens: A-Z are lower-cased, words end at ASCII white space, one end token closes each text.  A text is read
after ORDER - 1 begin marks, which are context and never scored.  Words are known by a 64-bit hash; their
ids are their places in the sorted hashes of the vocabulary, and a longer n-gram is the hash of its ids.

Counting: tasks count n-grams in blocks and send them, packed, to the shard of their hash.  The shard adds
up, writes its n-grams as a sorted array, and passes on what depends on them: each distinct n-gram is one
left extension of its last words (the Kneser-Ney count of the next lower order), and one follower of its first
words (total and numbers of followers seen once, twice, more often).  These are sums, so they are added up in
each shard before they are sent.

Model: p(w | c) = max(n(c w) - D(n(c w)), 0) / n(c) + g(c) p(w | c without its first word), D(1), D(2), D(3+)
from the counts of counts of each order (0.5, 1, 1.5 where these give nothing between 0 and the count), g(c)
the mass that D took.  Below one word stands the uniform share of V + 1 words; an unknown word has only that.
A context never seen passes on to the shorter one.  So the probabilities of all known words and one unknown
add up to 1 after every context.

The arrays lie in the shared folder and are mapped, so no task holds the model; `scored` writes the scores and then
removes it.  Counts are kept whole: nothing is pruned.

Nulls, empty tables and rows: a null or empty text is its end token; a row with a null doc_id is not held out;
every row counts, repeated or not.  Without any training text N and V are 0 and every token has probability 1.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.session import cut_lineage
from llm import hashed, words
from llm.tables import remainder

ORDER = 2  # words of an n-gram; a third one triples what is written
HELD_OUT = (5, 1)  # rows whose crc32 has this remainder don't teach

END = words.mix(np.array([0xE0D], dtype=np.uint64))[0]
_ODD = np.uint64(0x9E3779B97F4A7C15)
PENDING = 1 << 20  # n-grams that a task holds before it sends them on
SCHEMA = "kind string, shard int, data array<binary>"


def hash_ids(ids: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each row of ids."""
    out = np.full(len(ids), ids.shape[1], dtype=np.uint64)
    for k in range(ids.shape[1]):
        out = words.mix((out + ids[:, k].astype(np.uint64)) * _ODD)
    return out


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of all texts, and where each text begins (one more for the end)."""
    block = words.split(texts, words.SPACED)
    bounds = block.bounds + np.arange(len(block.bounds))
    out = np.full(bounds[-1], END, dtype=np.uint64)
    inner = np.ones(len(out), dtype=bool)
    inner[bounds[1:] - 1] = False
    out[inner] = block.hashes()
    return out, bounds


class Distinct:
    """Rows of ids with sums beside them, packed and unpacked; `first` rows of equal ids are added up."""

    def __init__(self, ids: np.ndarray, sums: list[np.ndarray]) -> None:
        keys = hash_ids(ids)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.ids = keys[first], ids[order[first]]
        self.sums = [np.add.reduceat(s[order], first) if len(first) else s for s in sums]

    def packed(self, kind: str, shards: int) -> Iterator[tuple[str, int, list[bytes]]]:
        edges = np.searchsorted(hashed.shard_of(self.keys, shards), np.arange(shards + 1))
        for shard in np.flatnonzero(edges[1:] > edges[:-1]):
            part = slice(edges[shard], edges[shard + 1])
            ids = self.ids[part]
            order = np.argsort(ids[:, 0], kind="stable")
            columns = [hashed.rising(ids[order, 0]), *[ids[order, k] for k in range(1, ids.shape[1])]]
            yield kind, int(shard), [*map(hashed.squeeze, columns), *[hashed.squeeze(s[part][order].astype(np.uint32)) for s in self.sums]]

    @staticmethod
    def unpacked(rows: pa.ChunkedArray, width: int, kind: type) -> Distinct:
        parts = []
        for row in rows:
            data = [x.as_py() for x in row]
            columns = [hashed.expand(d, kind) for d in data[:width]]
            columns[0] = np.cumsum(columns[0], dtype=kind)
            parts.append((np.stack(columns, axis=1), [hashed.expand(d, np.uint32).astype(np.int64) for d in data[width:]]))
        return Distinct(np.concatenate([ids for ids, _ in parts]), [np.concatenate(s) for s in zip(*[s for _, s in parts])])


def _rows(found: list[tuple[str, int, list[bytes]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in found], pa.string()), pa.array([s for _, s, _ in found], pa.int32()),
                                       pa.array([d for _, _, d in found], pa.list_(pa.binary()))], names=["kind", "shard", "data"])


def discounts(n: list[int]) -> np.ndarray:
    """D(0), D(1), D(2), D(3+) from how many n-grams were seen once, twice, three and four times."""
    out = np.array([0, 0.5, 1.0, 1.5])
    if all(n):
        y = n[0] / (n[0] + 2 * n[1])
        own = np.array([0, *[i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]])
        if all(0 < own[i] <= i for i in (1, 2, 3)):
            out = own
    return out


@dataclass
class Level:
    """n-grams of one size: their counts, and of their contexts the total and the mass that discounts take."""

    grams: hashed.Arrays
    contexts: hashed.Arrays | None
    discount: np.ndarray
    total: int = 0  # of the one empty context of single words
    taken: float = 0.0


@dataclass
class Model:
    folder: str
    order: int
    shards: int
    train_tokens: int
    types: int
    bases: np.ndarray  # id of the first word of each shard
    vocabulary: hashed.Arrays
    levels: list[Level]  # of single words first

    @property
    def begin(self) -> int:
        return self.types

    @property
    def unknown(self) -> int:
        return self.types + 1

    def ids(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of token hashes; `unknown` and 0 for words that training hasn't."""
        there, place, n = self.vocabulary.look_up(found, "place", "n")
        return np.where(there, place + self.bases[hashed.shard_of(found, self.shards)], self.unknown), n

    def padded(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each token its id after those of the ORDER - 1 tokens before it, begin marks before a text."""
        out = np.full((len(ids), self.order), self.begin, dtype=ids.dtype)
        at = np.arange(len(ids)) - np.repeat(bounds[:-1], np.diff(bounds))
        for back in range(self.order):
            has = at >= back
            out[has, self.order - 1 - back] = ids[np.flatnonzero(has) - back]
        return out

    def probabilities(self, grams: np.ndarray) -> np.ndarray:
        p = np.full(len(grams), 1 / (self.types + 1))
        for size, level in enumerate(self.levels, 1):
            part = grams[:, self.order - size:]
            n = level.grams.look_up(hash_ids(part), "n")[1]
            left = np.maximum(n - level.discount[np.minimum(n, 3)], 0)
            if size == 1:
                p = left / level.total + level.taken / level.total * p if level.total else p
                continue
            there, total, taken = level.contexts.look_up(hash_ids(part[:, :-1]), "total", "taken")
            p = np.where(there, (left + taken * p) / np.maximum(total, 1), p)
        return p

    def remove(self) -> None:
        hashed.remove_folder(self.folder)


def _vocabulary(docs: DataFrame, folder: str, shards: int) -> tuple[hashed.Arrays, np.ndarray, int, int]:
    """Counts of all tokens, the id of the first word of each shard, and how many tokens and types there are."""
    arrays = hashed.Arrays(folder, "words", shards, n="<i8")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = hashed.Tally()
        for batch in words.blocks(batches):
            tally.add(tokens(batch.column(0))[0])
            if tally.full():
                yield _rows([("word", *x) for x in tally.drain(shards)])
        yield _rows([("word", *x) for x in tally.drain(shards)])

    def merge(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        parts = [hashed.unpacked([x.as_py() for x in d]) for d in rows.column("data")]
        keys, n = hashed.added(*map(np.concatenate, zip(*parts)))
        arrays.write(shard, keys=keys, n=n)
        return pa.table({"shard": pa.array([shard], pa.int32()), "types": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})

    found = docs.select("text").mapInArrow(count, SCHEMA).groupBy("shard").applyInArrow(merge, "shard int, types long, tokens long").collect()
    sizes = np.zeros(shards, dtype=np.int64)
    for r in found:
        sizes[r["shard"]] = r["types"]
    return arrays, np.cumsum(sizes) - sizes, sum(r["tokens"] for r in found), int(sizes.sum())


def _ngrams(docs: DataFrame, model: Model, kind: type) -> DataFrame:
    """Counts of the longest n-grams, packed by shard."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[Distinct] = []

        def sums() -> Distinct:
            return Distinct(np.concatenate([d.ids for d in parts]), [np.concatenate([d.sums[0] for d in parts])])

        for batch in words.blocks(batches):
            found, bounds = tokens(batch.column(0))
            grams = model.padded(model.ids(found)[0].astype(kind), bounds)
            parts.append(Distinct(grams, [np.ones(len(grams), dtype=np.int64)]))
            if sum(len(d.keys) for d in parts) > PENDING:
                yield _rows(list(sums().packed("gram", model.shards)))
                parts = []
        if parts:
            yield _rows(list(sums().packed("gram", model.shards)))

    return docs.select("text").mapInArrow(count, SCHEMA)


def _level(grams: DataFrame, model: Model, size: int, kind: type) -> tuple[Level, DataFrame]:
    """Write the n-grams of one size; returns the level and the packed counts of the next lower one."""
    shards, folder = model.shards, model.folder
    arrays = hashed.Arrays(folder, f"grams{size}", shards, n="<i8")

    def merge(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        found = Distinct.unpacked(rows.column("data").combine_chunks(), size, kind)
        n = found.sums[0]
        arrays.write(shard, keys=found.keys, n=n)
        seen = [int((n == i).sum()) for i in (1, 2, 3, 4)]
        out = [("counts", shard, [np.array([*seen, int(n.sum()), int((n > 2).sum())], dtype=np.int64).tobytes()])]
        if size > 1:
            out += Distinct(found.ids[:, 1:], [np.ones(len(n), dtype=np.int64)]).packed("gram", shards)
            out += Distinct(found.ids[:, :-1], [n, *[(test).astype(np.int64) for test in (n == 1, n == 2, n > 2)]]).packed("context", shards)
        return pa.Table.from_batches([_rows(out)])

    # Written out: three readers follow, and the files must not be written again by each.
    done = cut_lineage(grams.groupBy("shard").applyInArrow(merge, SCHEMA))
    counts = np.zeros(6, dtype=np.int64)
    for row in done.where("kind = 'counts'").select("data").toLocalIterator():  # 48 bytes for each shard
        counts += np.frombuffer(row["data"][0], dtype=np.int64)
    level = Level(arrays, None, discounts(counts[:4].tolist()))
    if size == 1:
        level.total = int(counts[4])
        level.taken = float(level.discount[1:] @ [counts[0], counts[1], counts[5]])
        return level, done

    contexts, discount = hashed.Arrays(folder, f"contexts{size}", shards, total="<i8", taken="<f8"), level.discount

    def merge_contexts(rows: pa.Table) -> pa.Table:
        found = Distinct.unpacked(rows.column("data").combine_chunks(), size - 1, kind)
        total, once, twice, more = found.sums
        contexts.write(rows.column("shard")[0].as_py(), keys=found.keys, total=total, taken=once * discount[1] + twice * discount[2] + more * discount[3])
        return pa.table({"contexts": pa.array([len(total)], pa.int64())})

    done.where("kind = 'context'").groupBy("shard").applyInArrow(merge_contexts, "contexts long").agg(F.sum("contexts")).collect()
    level.contexts = contexts
    return level, done.where("kind = 'gram'")


def train(docs: DataFrame, order: int = ORDER, shard_bytes: int = hashed.SHARD_BYTES) -> Model:
    """The model of all texts of `docs`; it lies in the shared folder until `remove`."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    folder, shards = hashed.mounted_folder(docs.sparkSession, "language-model"), hashed.shards_for(docs, shard_bytes)
    vocabulary, bases, total, types = _vocabulary(docs, folder, shards)
    model = Model(folder, order, shards, total, types, bases, vocabulary, [])
    kind = np.uint32 if types < (1 << 32) - 2 else np.uint64
    grams = _ngrams(docs, model, kind)
    for size in range(order, 0, -1):
        level, grams = _level(grams, model, size, kind)
        model.levels.insert(0, level)
    return model


SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns of each document with its tokens, those known, both log10 probabilities and the perplexity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.blocks(batches):
            found, bounds = tokens(batch.column(batch.schema.get_field_index("text")))
            ids, n = model.ids(found)
            base = np.log10((n + 0.5) / (model.train_tokens + 0.5 * (model.types + 1)))
            own = np.log10(model.probabilities(model.padded(ids, bounds)))
            total = np.diff(bounds)
            add = lambda values: np.add.reduceat(values, bounds[:-1])  # noqa: E731  every text has a token
            scores = add(own)
            columns = [total, add((n > 0).astype(np.int64)), np.full(len(total), model.train_tokens), add(base), scores, 10 ** (-scores / total)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], *map(pa.array, columns)],
                                             names=[*keep, *(c.split()[0] for c in SCORES.split(", "))])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, {SCORES}")


def held_out(folds: int = HELD_OUT[0], fold: int = HELD_OUT[1]):
    return F.coalesce(remainder(F.col("doc_id"), folds) == fold, F.lit(False))


def scored(docs: DataFrame, order: int = ORDER, shard_bytes: int = hashed.SHARD_BYTES) -> DataFrame:
    """All documents scored by a model of those not held out."""
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    model = train(rows.where("NOT held_out"), order, shard_bytes)
    try:
        return cut_lineage(score(rows, model, ("doc_id", "held_out")))
    finally:
        model.remove()
