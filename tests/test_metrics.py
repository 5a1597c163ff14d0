"""Metrics against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from codewarden.operators import metrics as M


def scored(spark, n=400, distinct=30, positives=0.3, seed=2):
    rng = random.Random(seed)
    rows = [(int(rng.random() < positives), rng.randrange(distinct) / distinct) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "label int, score double")


def brute_auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def brute_best(rows):
    best = (-1.0, 0.0)
    for t in sorted({s for _, s in rows}):
        tp = sum(y and s >= t for y, s in rows)
        fp = sum((not y) and s >= t for y, s in rows)
        f1 = 2 * tp / (tp + fp + sum(y for y, _ in rows)) if tp else 0.0
        if f1 > best[0] + 1e-12:
            best = (f1, t)
    return best


@pytest.mark.parametrize("distinct", [3, 30, 10_000])
def test_auc_and_best_f1(spark, distinct):
    rows, df = scored(spark, distinct=distinct)
    assert M.roc_auc(df, "label", "score").first().auc == pytest.approx(brute_auc(rows))
    best = M.best_f1(M.precision_recall(M.score_counts(df, "label", "score"))).first()
    assert (best.f1, best.threshold) == pytest.approx(brute_best(rows))


def test_auc_guards(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "label int, score double")
    assert M.roc_auc(df, "label", "score").first().auc == 0.5
    assert M.roc_auc(df.limit(0), "label", "score").first().auc == 0.0
    mixed = spark.createDataFrame([(1, float("nan")), (0, 0.0), (1, None)], "label int, score double")
    assert M.roc_auc(mixed, "label", "score").first().auc == 0.5


def test_auc_is_monotone_invariant(spark):
    _, df = scored(spark)
    same = df.withColumn("score", F.exp(F.col("score") * 3))
    assert M.roc_auc(df, "label", "score").first().auc == pytest.approx(M.roc_auc(same, "label", "score").first().auc)


def test_confusion_one_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 0)], "label int, p int")
    r = M.with_rates(M.confusion(df, "label", "p")).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (0, 0, 1, 1) and r.precision == 1.0 and r.recall == 0.5


def test_confidence_summary(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (5.0,), (9.0,), (None,)], "c double")
    r = M.confidence_summary(df, "c", 10).first()
    assert r.n == 5 and (r["min"], r["max"], r["mean"]) == (1.0, 9.0, 4.25)
    assert r.median == pytest.approx(3.5) and r.pk == pytest.approx(1.3)


@pytest.mark.parametrize("method", ["rows", "counts"])
@pytest.mark.parametrize("positives", [0.3, 0.01])
def test_bootstrap_keeps_sizes(spark, method, positives):
    rows, df = scored(spark, positives=positives, seed=9)
    counts = M.score_counts(df, "label", "score")
    draw = {"rows": M.bootstrap_by_rows, "counts": M.bootstrap_by_counts}[method](counts, 15, 3)
    sizes = draw.groupBy("round").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).collect()
    pos = sum(y for y, _ in rows)
    assert len(sizes) == 15 and all(r.p + r.n == len(rows) for r in sizes)
    if pos > 5:
        assert all(r.p == pos for r in sizes)
    else:
        assert len({r.p for r in sizes}) > 1


def test_bootstrap_counts_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(M, "SCORES_PER_BUCKET", 4)
    rows, df = scored(spark, distinct=50)
    a = M.bootstrap_threshold(df, "label", "score", 60, 1, "counts").first()
    b = M.bootstrap_threshold(df, "label", "score", 60, 1, "rows").first()
    assert a.rounds == b.rounds == 60 and abs(a.threshold - b.threshold) < 0.15 and a.ci_low <= a.threshold <= a.ci_high
    assert a.tp + a.fn == sum(y for y, _ in rows)
