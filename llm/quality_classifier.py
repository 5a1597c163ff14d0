"""Quality classifier: naive Bayes features in a linear support vector machine.

1. Each text is its set of n-gram indicators: words, pairs of words, runs of other signs, and whether a
   word follows itself, hashed to BUCKETS.
2. Documents of either label are counted for each bucket, over all labelled documents that may teach (about
   llm.tables.TEACH_ROWS at most); the log-count ratio scales the bucket's indicator.
3. A hinge-loss model is fitted by dual coordinate descent on at most SAMPLE labelled documents, those of
   least hash; a fifth of them is set aside for the logistic curve that turns margins into scores.

To the driver come BUCKETS rows of counts and the sample's bucket numbers, both of bounded size.

Nulls and ties: a null or empty text has no indicators and the score of the bias.  Repeated rows are scored
alike; a null doc_id has no label and is not held out.  Without labels of both kinds all scores are the
share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import words
from llm.quality_rules import SIGNS
from llm.tables import join_labels, remainder

BUCKETS = 1 << 18
SAMPLE = 4_000  # labelled documents that the fit reads, half of either label where there are as many
SMOOTH = 1.0
COST, ROUNDS = 1.0, 15


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, one text after another, and where each text begins."""
    named, signs = words.split(texts, words.ALNUM, fold=False), words.split(texts, SIGNS, fold=False)
    hashes = named.hashes()
    pairs, first = named.windows(hashes, 2)
    same = hashes[first] == hashes[first + 1] if len(first) else np.zeros(0, dtype=bool)
    pairs = np.where(same, np.uint64(1), pairs)
    owner, other = np.repeat(np.arange(len(named)), np.diff(named.bounds)), np.repeat(np.arange(len(signs)), np.diff(signs.bounds))
    place = (np.concatenate([hashes, pairs, signs.hashes()]) % np.uint64(BUCKETS)).astype(np.int64)
    every = np.unique(np.concatenate([owner, owner[first], other]) * BUCKETS + place)
    return every % BUCKETS, np.searchsorted(every, np.arange(len(named) + 1) * BUCKETS)


def log_ratios(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratio of every bucket over `rows` (text, label), and documents of label 0 and 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), dtype=np.int64)
        docs = np.zeros(2, dtype=np.int64)
        for batch in words.blocks(batches):
            place, edge = indicators(batch.column(0))
            label = (batch.column(1).to_numpy() > 0).astype(np.int64)
            docs += np.bincount(label, minlength=2)
            each = np.repeat(label, np.diff(edge))
            for k in (0, 1):
                total[k] += np.bincount(place[each == k], minlength=BUCKETS)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), *(pa.array(np.append(total[k][at], docs[k])) for k in (0, 1))], names=["b", "n0", "n1"])

    counted = rows.select("text", "label").mapInArrow(run, "b long, n0 long, n1 long").groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = np.zeros((2, BUCKETS + 1))
    for batch in counted.toArrow().to_batches():  # BUCKETS + 1 rows at most; bucket -1 counts documents
        total[:, batch.column(0).to_numpy()] = [batch.column(1).to_numpy(), batch.column(2).to_numpy()]
    docs, seen = total[:, -1], total[:, :-1] + SMOOTH
    share = seen / (docs + 2 * SMOOTH)[:, None]
    return np.log(share[1]) - np.log(share[0]), docs


def descend(sets: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, cost: float = COST, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of least hinge loss, by dual coordinate descent over rows of unit length; classes weigh alike."""
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(sets))
    rows = []
    for s in sets:
        v = ratios[s]
        rows.append((s, v / max(1e-9, np.linalg.norm(v))))
    limit = cost * len(y) / (2 * np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum())))
    order = np.arange(len(sets))
    for r in range(rounds):
        np.random.default_rng(r).shuffle(order)
        for i in order:
            s, v = rows[i]
            new = min(max(alpha[i] - (y[i] * (w[s] @ v + bias) - 1) / 2, 0.0), limit[i])  # |v| = 1, and 1 for the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[s] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over margins, each label weighing alike; increasing."""
    a, b = 2.0, 0.0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    goal = (y > 0) * 0.98 + 0.01
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, v = weight * (goal - p), weight * p * (1 - p) + 1e-6
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]])
        move = np.clip(np.linalg.solve(h, [(g * margin).sum() - 1e-3 * (a - 2), g.sum() - 1e-3 * b]), -0.5, 0.5)
        a, b = a + move[0], b + move[1]
        if np.abs(move).max() < 1e-9:
            break
    return max(a, 0.1), b


def train(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from `rows` (doc_id, text, label)."""
    ratios, docs = log_ratios(rows)
    if not docs.all():
        share = docs[1] / docs.sum() if docs.sum() else 0.5
        return Model(np.zeros(BUCKETS, dtype=np.float32), 0.0, 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.blocks(batches):
            place, edge = indicators(batch.column(0))
            sets = [place[edge[i]:edge[i + 1]] for i in range(batch.num_rows)]
            small = [s.astype("<i4").tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(small, pa.binary())], names=["label", "buckets"])

    picked = []
    for part in (rows.where(F.col("label") > 0), rows.where(F.col("label") <= 0)):
        ids = part.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        # A doc_id that stands in many rows is one document of the sample.
        picked.append(part.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label")))
    found = picked[0].unionByName(picked[1]).select("text", "label").mapInArrow(run, "label int, buckets binary").collect()
    found.sort(key=lambda r: (r["buckets"], r["label"]))
    sets = [np.frombuffer(r["buckets"], dtype="<i4").astype(np.int64) for r in found]
    y = np.array([1.0 if r["label"] > 0 else -1.0 for r in found])
    aside = np.arange(len(y)) % 5 == 0
    fit = np.flatnonzero(~aside) if len(y) >= 50 else np.arange(len(y))
    w, bias = descend([sets[i] for i in fit], y[fit], ratios)
    margin = np.array([w[s] @ ratios[s] / max(1e-9, np.linalg.norm(ratios[s])) + bias for s in sets])
    test = np.flatnonzero(aside) if len(y) >= 50 else fit
    return Model(np.stack([w * ratios, ratios ** 2]).astype(np.float32), bias, *curve(margin[test], y[test]))


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, value: str = "quality",
                    sample: int = SAMPLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns with held_out, score and predicted; labels of the fold `held` are not used."""
    out = F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(train(join_labels(docs.select("doc_id", "text"), labels.where(~out), value), sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in words.blocks(batches):
            names = batch.schema.names
            place, edge = indicators(batch.column(names.index("text")))
            if m.weights.ndim == 2:
                total = np.concatenate([np.zeros((2, 1)), np.cumsum(m.weights[:, place], axis=1, dtype=np.float64)], axis=1)
                over = total[:, edge[1:]] - total[:, edge[:-1]]
                margin = over[0] / np.sqrt(np.maximum(over[1], 1e-18)) + m.bias
            else:
                margin = np.zeros(batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(m.slope * margin + m.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in [*keep, "held_out"]], pa.array(score),
                                              pa.array((score >= 0.5).astype(np.int32))], names=[*keep, "held_out", "score", "predicted"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.withColumn("held_out", out).select(*dict.fromkeys([*keep, "held_out", "text"]))
    return rows.mapInArrow(run, f"{kinds}, held_out boolean, score double, predicted int")
