"""Packing of tokenized documents into sequences of one window, with little padding.

Method: non-negative least squares on the histogram of piece lengths.  A document is cut at multiples of
the window; what remains is one shorter piece.  Lengths fall into classes of GRAIN tokens.  Columns are
all shallow combinations (up to three classes) that fill the window, the unknowns are how often each is
used, the target is the histogram.  The solution is rounded down to what is there, and the rest is
packed greedily, longest first, on counts.  Only the histogram (256 numbers) reaches the driver.

Pieces of a class are numbered across partitions by counts for each partition, so a class that holds a
third of all pieces is no group of its own; each number has its place in the plan by search.

Nulls and ties: a null or empty text is its end token alone.  Repeated rows are packed as often as they
stand; rows with a null doc_id too.  Whole sequences are one window and need no partner.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codewarden.session import cut_lineage
from llm import words

SEQUENCE = 1024
GRAIN = 4
END = 0
CACHED_WORDS = 600_000  # words, and parts of words, whose ids a worker keeps; it starts anew beyond, before the 699,050 at which Python doubles the table
JOINED_WORDS = 4_000
CLOSING = ".,;:!?%&$*#|\"')(<>-"
SLICE_BYTES = 4 << 20

# White space beside single blanks and line ends inside the text: such texts are encoded as a whole.
ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core, and threads hold memory of their own
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def odd(word: str) -> bool:
    """Whether a word, cut at single blanks and before line ends, shows that its text has other white space, or some at an end."""
    return word in ("", "\n") or ODD_SPACE.search(word) is not None


class Encoder:
    """Token ids, as little-endian 32-bit bytes, of texts.

    The tokenizer splits a text before a single blank in any case, so a plain text is its words, each but
    the first with the blank before it, and the tokenizer encodes each different word once.  New words go to
    it as one text; a token that begins with the blank begins the next word.  A text that holds one of the
    tokenizer's added tokens is encoded as a whole, as these are found before any splitting.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.known: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = [a for a in self.added if a.split() != [a]]  # these may stand across words
        self.opens = np.zeros(max(names.values()) + 1, dtype=bool)
        self.opens[[i for name, i in names.items() if name.startswith("\u0120")]] = True  # how byte-level vocabularies write a blank

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _opened(self, new: list[str]) -> None:
        """Keep the ids of words without inner white space, each with a blank before it."""
        for low in range(0, len(new), JOINED_WORDS):
            part = new[low:low + JOINED_WORDS]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(part):  # never for a byte-level vocabulary; then one by one
                self.known.update(zip(part, self._encode([" " + w for w in part]), strict=True))
                continue
            raw, edges = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            self.known.update(zip(part, map(raw.__getitem__, map(slice, edges, edges[1:]))))

    def _learn(self, new: list[str]) -> None:
        """Words come apart again where the tokenizer splits them: after a line end at their front, and before closing signs.

        What is left of a word, its core, is kept as a word too.  A word that is letters and digits alone is its own core.
        """
        known, bare = self.known, self.bare
        if len(bare) > CACHED_WORDS:
            bare.clear()
        opened, loose, pieces = [], {"\n"}, []
        for w in new:
            if w.isalnum():
                opened.append(w)
                continue
            line = w[1:] if w[0] == "\n" else w
            core = line.rstrip(CLOSING)
            if not core or not core[-1].isalnum():
                core = line
            tail = line[len(core):]
            if line is not w:
                loose.add(core)
            elif core not in known:
                opened.append(core)
            loose.add(tail)
            pieces.append((w, line is not w, core, tail))
        self._opened(list(dict.fromkeys(opened)))
        missing = [p for p in loose if p and p not in bare]
        bare.update(zip(missing, self._encode(missing), strict=True))
        bare[""], end = b"", bare["\n"]
        for w, after, core, tail in pieces:
            known[w] = end + bare[core] + bare[tail] if after else known[core] + bare[tail]

    def _strange(self, new: list[str]) -> list[int]:
        """Places of the words that are odd or hold an added token; mostly there are none, which one look at all of them shows."""
        every = f" {' '.join(new)} "
        if not ("  " in every or "\n " in every or ODD_SPACE.search(every) or any(a in every for a in self.added)):
            return []
        return [k for k, w in enumerate(new) if odd(w) or any(a in w for a in self.added)]

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Arrow cuts the texts and numbers their different words, so each is looked up once a block, and joins the ids again."""
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded, edges = parts.flatten().dictionary_encode(), parts.offsets.to_numpy()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        apart = np.zeros(len(texts), dtype=bool)
        for a in self.spaced:
            apart |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known = self.known
        ids = list(map(known.get, names))
        new = [k for k, x in enumerate(ids) if x is None]
        # A word that was learnt holds no odd white space and no added token, so only new ones are looked at.
        strange = self._strange([names[k] for k in new])
        if strange:
            at = np.zeros(len(names), dtype=bool)
            at[[new[k] for k in strange]] = True
            apart |= np.add.reduceat(at[code], edges[:-1]) > 0  # a text has one word at least
        plain = np.flatnonzero(~apart)
        first = edges[:-1][plain]
        used = np.repeat(~apart, np.diff(edges))
        used[first] = False
        later = np.zeros(len(names), dtype=bool)
        later[code[used]] = True
        new = [k for k in new if later[k]]
        self._learn([names[k] for k in new])
        for k in new:
            ids[k] = known[names[k]]
        opening, code = np.unique(code[first]), code.copy()
        code[first] = len(names) + np.searchsorted(opening, code[first])  # a first word has no blank before it
        ids += self._encode([names[k] for k in opening])
        used[first] = True
        joined = pa.array(ids, pa.large_binary()).take(pa.array(code[used]))
        at, raw = np.frombuffer(joined.buffers()[1], dtype=np.int64), memoryview(joined.buffers()[2] or b"")
        ends = np.cumsum(np.diff(edges)[plain])
        out: list[bytes] = [b""] * len(texts)
        low = 0
        for i, high in zip(plain.tolist(), at[ends].tolist(), strict=True):
            out[i], low = bytes(raw[low:high]), high
        whole = np.flatnonzero(apart)
        for i, one in zip(whole.tolist(), self._encode(texts.take(pa.array(whole)).to_pylist()), strict=True):
            out[i] = one
        return out


def pieces(docs: DataFrame, path: str, window: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the documents cut at multiples of the window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = words.kept(path, lambda: Encoder(path))
        end = np.array([END], dtype="<u4").tobytes()
        for batch in words.blocks(batches, limit=SLICE_BYTES, keep=path):
            owner, start, length, crc, total = [], [], [], [], []
            for d, ids in enumerate(encode(batch.column(1))):
                ids += end
                n = len(ids) // 4
                for low in range(0, n, window):
                    high = min(n, low + window)
                    owner.append(d)
                    start.append(low)
                    length.append(high - low)
                    crc.append(zlib.crc32(ids[4 * low:4 * high]))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(units: int) -> list[tuple[int, ...]]:
    """All combinations of up to three classes whose sizes fill the window."""
    two = [(a, units - a) for a in range(1, units // 2 + 1)]
    three = [(a, b, units - a - b) for a in range(1, units // 3 + 1) for b in range(a, (units - a) // 2 + 1)]
    return [(units,), *two, *three]


def least_squares(columns: np.ndarray, target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative x with a small |columns x - target|, by accelerated projected gradient."""
    step = 1 / np.linalg.norm(columns @ columns.T, 2)
    x = np.zeros(columns.shape[1])
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (columns.T @ (columns @ y - target)))
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / later * (new - x), later
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(classes of a sequence, how many such sequences) that use up the histogram (index: class, from 1)."""
    units, left, out = len(histogram) - 1, histogram.astype(np.int64).copy(), []
    if left[units]:
        out.append(((units,), int(left[units])))
        left[units] = 0
    if left.sum():
        sets = [c for c in combinations(units) if len(c) > 1]
        columns = np.zeros((units + 1, len(sets)))
        for k, c in enumerate(sets):
            for a in c:
                columns[a, k] += 1
        x = least_squares(columns, left / left.max()) * left.max()
        for k in np.argsort(-x, kind="stable"):
            use = int(x[k])
            for a in set(sets[k]):
                use = min(use, int(left[a]) // sets[k].count(a))
            if use > 0:
                out.append((sets[k], use))
                for a in sets[k]:
                    left[a] -= use
    while left.any():
        room, one = units, []
        while room:
            fits = np.flatnonzero(left[:room + 1] - np.bincount(one, minlength=units + 1)[:room + 1] > 0)
            if not len(fits):
                break
            one.append(int(fits[-1]))
            room -= one[-1]
        use = min(int(left[a]) // one.count(a) for a in set(one))
        out.append((tuple(sorted(one)), use))
        for a in one:
            left[a] -= use
    return out


def slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each class rows (first number, pieces in a sequence, first sequence, place in the sequence), by number."""
    taken: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for classes, use in planned:
        for place, a in enumerate(dict.fromkeys(classes)):
            k = classes.count(a)
            rows.setdefault(a, []).append((taken.get(a, 0), k, base, place))
            taken[a] = taken.get(a, 0) + k * use
        base += use
    return {a: np.array(r, dtype=np.int64) for a, r in rows.items()}


def pack(docs: DataFrame, path: str, window: int = SEQUENCE, grain: int = GRAIN) -> DataFrame:
    """Each piece of each document with its sequence and its offset there."""
    cut = pieces(docs, path, window).withColumn("class", F.ceil(F.col("length") / F.lit(grain)).cast("int"))
    cut = cut_lineage(cut.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    counts = cut_lineage(cut.groupBy("class", "part").agg(F.count("*").alias("n")))
    histogram = np.zeros(window // grain + 1, dtype=np.int64)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():
        histogram[r["class"]] = r["n"]
    places = docs.sparkSession.sparkContext.broadcast(slots(plan(histogram)))

    before = F.sum("n").over(Window.partitionBy("class").orderBy("part")) - F.col("n")
    number = F.row_number().over(Window.partitionBy("class", "part").orderBy("row")) - 1
    numbered = (cut.withColumn("number", number).join(counts.select("class", "part", before.alias("before")), ["class", "part"])
                .withColumn("number", (F.col("number") + F.col("before")).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, number = batch.column(batch.schema.get_field_index("class")).to_numpy(), batch.column(batch.schema.get_field_index("number")).to_numpy()
            sequence, place = np.zeros(len(kind), dtype=np.int64), np.zeros(len(kind), dtype=np.int64)
            for a in np.unique(kind):
                at = np.flatnonzero(kind == a)
                rows = places.value[int(a)]
                found = rows[np.searchsorted(rows[:, 0], number[at], side="right") - 1]
                own = number[at] - found[:, 0]
                sequence[at], place[at] = found[:, 2] + own // found[:, 1], found[:, 3] * window + own % found[:, 1]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(sequence), pa.array(place)],
                                             names=[*names, "sequence_id", "place"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = numbered.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long")
    above = Window.partitionBy("sequence_id").orderBy("place")
    return placed.withColumn("offset", F.sum("length").over(above) - F.col("length")).drop("place")
