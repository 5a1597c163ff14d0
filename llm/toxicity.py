"""Toxicity by maximum-scoring segments of token log-odds.

1. Words and their stems (first bytes, so that inflected forms count together) are counted by
   hash bucket: over all documents (the Dirichlet prior), and by documents in the labelled ones of either
   class.  A bucket has the log-odds ratio under that prior, drawn towards zero by z standard
   deviations; a word has the best of its buckets, zero at least, less DRIFT, so that ordinary text scores below zero.
   How long stems are (STEMS) and z (ZS) follow the labels: few labels ask for a small z, many for a large
   one.  Each pair learns from the taught documents less one in INNER, and the one with the fewest errors on
   those (the first of equals) learns from all.
2. In each text the scan of Ruzzo and Tompa finds every maximal-scoring segment in linear time; only
   words of positive score can open one, and all words between count by running sums.
3. Segment scores become extreme-value evidence: with lambda solving sum p exp(lambda s) = 1 over the words
   of ordinary labelled documents (their scores, as counts in SCORE_BINS bins), a text of n words holds a segment of score S by chance about n exp(-lambda S) times.  Evidence
   of a text is the sum of lambda S - ln n over its significant segments.
4. A logistic curve over the evidence of the labelled documents, as counts in EVIDENCE_BINS bins, gives
   the score.

Everything that reaches the driver has a fixed size: BUCKETS rows of counts for each of STEMS, and the bins.

About llm.tables.TEACH_ROWS labels teach at most; the prior counts every document.

Nulls and ties: a null or empty text has no segments and the score of no evidence.  Repeated rows are
scored alike; a null doc_id has no label and is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import words
from llm.tables import join_labels, remainder

BUCKETS = 1 << 19
STEMS = ((4, 5), (6, 8))
PRIOR, EACH = 500.0, 0.5  # what the corpus counts as beside the labelled documents, and each bucket at least
ZS = (2.5, 1.5, 1.0)
INNER = 4
SCORE_BINS, SCORE_STEP, SCORE_LEAST = 400, 0.05, -8.0
DRIFT = 0.05
MOST_DECAY = 64.0
CHANCE = 0.05  # segments expected by chance, up to which one is significant
EVIDENCE_BINS = 200
EVIDENCE_STEP = 0.5


@dataclass(frozen=True)
class Model:
    odds: np.ndarray
    lam: float
    stems: tuple[int, ...] = STEMS[0]


def buckets(block: words.Block, hashes: np.ndarray, stems: tuple[int, ...]) -> list[np.ndarray]:
    """The bucket of each word, and of each of its stems."""
    every = [hashes, *(block.stems(hashes, k) for k in stems)]
    return [(h % np.uint64(BUCKETS)).astype(np.int64) for h in every]


def word_scores(block: words.Block, hashes: np.ndarray, model: Model) -> np.ndarray:
    """The best log-odds of each word and its stems, zero at least, less DRIFT."""
    return np.maximum(0, np.max([model.odds[b] for b in buckets(block, hashes, model.stems)], axis=0)) - np.float32(DRIFT)


def counts(rows: DataFrame) -> np.ndarray:
    """Word counts of `rows` (text, label, inner) for each of STEMS by bucket: all; of label 1, of label 0, not inner; the same, inner."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(STEMS), 5, BUCKETS), dtype=np.int64)
        for batch in words.blocks(batches):
            block = words.split(batch.column(0), words.ALNUM)
            owner, hashes = np.repeat(np.arange(len(block)), np.diff(block.bounds)), block.hashes()
            label, inner = batch.column(1).fill_null(-1).to_numpy()[owner], batch.column(2).to_numpy(zero_copy_only=False)[owner]
            own = [(label > 0) & ~inner, (label == 0) & ~inner, (label > 0) & inner, (label == 0) & inner]
            for s, stems in enumerate(STEMS):
                for place in buckets(block, hashes, stems):
                    total[s, 0] += np.bincount(place, minlength=BUCKETS)
                    for k in range(4):  # once for each document, as words come in bursts
                        once = np.unique(owner[own[k]] * BUCKETS + place[own[k]]) % BUCKETS
                        total[s, k + 1] += np.bincount(once, minlength=BUCKETS)
        for s in range(len(STEMS)):
            at = np.flatnonzero(total[s, 0])
            for low in range(0, len(at), 1 << 16):
                part = at[low:low + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part + s * BUCKETS), *(pa.array(total[s, k][part]) for k in range(5))],
                                                 names=["b", *(f"n{k}" for k in range(5))])

    found = rows.select("text", "label", "inner").mapInArrow(run, "b long, n0 long, n1 long, n2 long, n3 long, n4 long")
    out = np.zeros((5, len(STEMS) * BUCKETS), dtype=np.int64)
    for batch in found.groupBy("b").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(5))).toArrow().to_batches():  # BUCKETS rows at most for each of STEMS
        out[:, batch.column(0).to_numpy()] = [batch.column(k + 1).to_numpy() for k in range(5)]
    return out.reshape(5, len(STEMS), BUCKETS).transpose(1, 0, 2)


def log_odds(all_words: np.ndarray, toxic: np.ndarray, other: np.ndarray, prior: float = PRIOR, z: float = ZS[0]) -> np.ndarray:
    """Log-odds ratio of each bucket under a Dirichlet prior, less z standard deviations towards zero."""
    a = EACH + prior * all_words / max(1, all_words.sum())

    def odds(y: np.ndarray) -> np.ndarray:
        return np.log(y + a) - np.log(max(1, y.sum()) + a.sum() - y - a)

    delta, spread = odds(toxic) - odds(other), np.sqrt(1 / (toxic + a) + 1 / (other + a))
    return np.sign(delta) * np.maximum(0, np.abs(delta) - z * spread)


def ordinary(rows: DataFrame, models: list[Model]) -> np.ndarray:
    """Words by model and score bin in the documents of label 0."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(shared.value), SCORE_BINS), dtype=np.int64)
        for batch in words.blocks(batches):
            block = words.split(batch.column(0), words.ALNUM)
            hashes = block.hashes()
            for m, model in enumerate(shared.value):
                place = np.clip((word_scores(block, hashes, model) - SCORE_LEAST) / SCORE_STEP, 0, SCORE_BINS - 1).astype(np.int64)
                total[m] += np.bincount(place, minlength=SCORE_BINS)
        m, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(at), pa.array(total[m, at])], names=["m", "b", "n"])

    out = np.zeros((len(models), SCORE_BINS), dtype=np.int64)
    for r in rows.where("label = 0").select("text").mapInArrow(run, "m long, b long, n long").groupBy("m", "b").agg(F.sum("n").alias("n")).collect():
        out[r["m"], r["b"]] = r["n"]
    return out


def decay(counted: np.ndarray, best: float) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1 over ordinary words; their mean score is negative.

    One more word of the best score is counted, as ordinary text may hold it though none was seen.  At most
    MOST_DECAY.
    """
    score = SCORE_LEAST + (np.arange(SCORE_BINS) + 0.5) * SCORE_STEP
    counted = counted.copy()
    counted[int(np.clip((best - DRIFT - SCORE_LEAST) / SCORE_STEP, 0, SCORE_BINS - 1))] += 1
    p = counted / counted.sum()
    if not p[score > 0].any() or (p * score).sum() >= 0:
        return 1.0
    p, score = p[p > 0], score[p > 0]
    low, high = 0.0, 1.0
    while high < MOST_DECAY and (p * np.exp(np.minimum(high * score, 700))).sum() < 1:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * score, 700))).sum() < 1 else (low, mid)
    return high


def fitted(rows: DataFrame, models: list[Model]) -> list[Model]:
    """`models` with the lambda of ordinary words of `rows` (text, label)."""
    return [Model(m.odds, decay(counted, float(m.odds.max())), m.stems) for m, counted in zip(models, ordinary(rows, models), strict=True)]


def train(rows: DataFrame) -> Model:
    """The model of `rows` (text, label, inner); label is null where a document may not teach.

    Stems and z are those with the fewest errors on the inner documents after learning from the others.
    """
    counted = counts(rows)
    pairs = [(s, z) for s in range(len(STEMS)) for z in ZS]
    tried = [Model(log_odds(*counted[s, :3], z=z).astype(np.float32), 1.0, STEMS[s]) for s, z in pairs]
    outcome = trials(rows.where("label IS NOT NULL"), fitted(rows.where("NOT inner"), tried))
    s, z = pairs[int(np.argmin(outcome))]
    toxic, other = counted[s, 1] + counted[s, 3], counted[s, 2] + counted[s, 4]
    return fitted(rows, [Model(log_odds(counted[s, 0], toxic, other, z=z).astype(np.float32), 1.0, STEMS[s])])[0]


def trials(rows: DataFrame, models: list[Model]) -> list[int]:
    """Errors of each model on the inner ones of `rows` (text, label, inner), with the curve of the others."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(shared.value), EVIDENCE_BINS, 2, 2), dtype=np.int64)
        for batch in words.blocks(batches):
            block = words.split(batch.column(0), words.ALNUM)
            hashes = block.hashes()
            toxic, inner = (batch.column(1).to_numpy() > 0).astype(int), batch.column(2).to_numpy(zero_copy_only=False).astype(int)
            for m, model in enumerate(shared.value):
                place = np.minimum(weigh(block, hashes, model)[0] / EVIDENCE_STEP, EVIDENCE_BINS - 1).astype(int)
                np.add.at(total[m], (place, toxic, inner), 1)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(total[at])], names=["m", "bin", "toxic", "inner", "n"])

    found = (rows.select("text", "label", "inner").mapInArrow(run, "m long, bin long, toxic long, inner long, n long")
             .groupBy("m", "bin", "toxic", "inner").agg(F.sum("n").alias("n")).collect())
    errors = []
    for m in range(len(models)):
        a, b = curve([(r["bin"], r["toxic"], r["n"]) for r in found if r["m"] == m and not r["inner"]])
        errors.append(sum(r["n"] for r in found if r["m"] == m and r["inner"] and (a + b * EVIDENCE_STEP * r["bin"] >= 0) != bool(r["toxic"])))
    return errors


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score) of a sequence; linear in its length."""
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    stack: list[list[float]] = []  # first, end, sum before, sum after, nearest earlier candidate with a smaller sum before
    for i in np.flatnonzero(scores > 0):
        one = [i, i + 1, sums[i], sums[i + 1], -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= one[2]:
                j = int(stack[j][4])
            one[4] = j
            if j < 0 or stack[j][3] >= one[3]:
                stack.append(one)
                break
            one[0], one[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(int(a), int(b), float(r - l)) for a, b, l, r, _ in stack]


def weigh(block: words.Block, hashes: np.ndarray, model: Model) -> tuple[np.ndarray, list[list[dict]]]:
    """The evidence of each text and its significant passages."""
    score = word_scores(block, hashes, model)
    size = np.diff(block.bounds)
    held, passages = np.zeros(len(size)), [[] for _ in size]
    above = np.concatenate([[0], np.cumsum(score > 0)])[block.bounds]
    for d in np.flatnonzero(np.diff(above)):
        for first, end, s in segments(score[block.bounds[d]:block.bounds[d + 1]]):
            gain = model.lam * s - np.log(size[d])
            if gain >= -np.log(CHANCE):
                held[d] += gain
                passages[d].append({"first": first, "end": end, "score": s})
    return held, passages


def evidence(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """`keep` columns with n_words, evidence, and the significant passages (first word, end word, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in words.blocks(batches):
            names = batch.schema.names
            block = words.split(batch.column(names.index("text")), words.ALNUM)
            held, passages = weigh(block, block.hashes(), known)
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in keep], pa.array(np.diff(block.bounds)), pa.array(held), pa.array(passages, kind)],
                                             names=[*keep, "n_words", "evidence", "passages"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(
        run, f"{kinds}, n_words long, evidence double, passages array<struct<first: bigint, end: bigint, score: double>>")


def curve(binned: list[tuple[int, int, int]]) -> tuple[float, float]:
    """(intercept, slope) of a logistic curve over (bin, label, rows); evidence never speaks against a label."""
    if not binned:
        return -1.0, 1.0
    x, y, w = (np.array(c, dtype=float) for c in zip(*binned, strict=True))
    x = x * EVIDENCE_STEP
    x, y, w = np.append(x, [0, 0, 10, 10]), np.append(y, [0, 1, 0, 1]), np.append(w, [1, 0.5, 0.5, 1])  # keeps it finite
    a, b = -1.0, 0.5
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(w * (y - p)).sum(), (w * (y - p) * x).sum()])
        v = w * p * (1 - p)
        h = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum()]]) + 1e-6 * np.eye(2)
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + move[0], b + move[1]
        if np.abs(move).max() < 1e-9:
            break
    return float(a), float(max(b, 1e-3))


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, value: str = "toxic",
                    keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns with held_out, score, predicted, evidence and passages; labels of the fold `held` are not used."""
    out = F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False))
    rows = join_labels(docs.select("doc_id", "text"), labels.where(~out), value, "left")
    inner = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / folds) % INNER == 0
    rows = rows.withColumn("inner", F.coalesce(inner, F.lit(False)))
    model = train(rows)
    taught = evidence(rows.where("label IS NOT NULL"), model, ["label"])
    place = F.least(F.floor(F.col("evidence") / EVIDENCE_STEP), F.lit(EVIDENCE_BINS - 1)).alias("bin")
    a, b = curve([tuple(r) for r in taught.groupBy(place, F.when(F.col("label") > 0, 1).otherwise(0).alias("label"))
                  .agg(F.count("*").alias("n")).collect()])
    found = evidence(docs.withColumn("held_out", out), model, [*keep, "held_out"])
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("evidence"))))
    return (found.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
            .select(*keep, "held_out", "score", "predicted", "n_words", "evidence", "passages"))
