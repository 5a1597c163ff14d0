"""Scores against labels: confusion, curves, thresholds, bootstrap.

Row-level data is reduced to one row per distinct score before anything is ordered.
"""

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.functions.draws import decimal_blocks, hashed_numbers
from codewarden.functions.features import finite, predicted
from codewarden.operators.ordering import running_totals, seeded_hash
from codewarden.session import cut_lineage


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _count(condition: Column, weight: Column | None) -> Column:
    """Rows that meet the condition, or the sum of their weights for rows that stand for many."""
    if weight is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0)).cast("bigint")


def confusion_columns(label: Column, prediction: Column, weight: Column | None = None) -> list[Column]:
    """Always four counts, also when only one class is present."""
    return [
        _count((label == 0) & (prediction == 0), weight).alias("tn"),
        _count((label == 0) & (prediction == 1), weight).alias("fp"),
        _count((label == 1) & (prediction == 0), weight).alias("fn"),
        _count((label == 1) & (prediction == 1), weight).alias("tp"),
    ]


def confusion(scored: DataFrame, label: str, prediction: str, by: Sequence[str] = (),
              weight: str | None = None) -> DataFrame:
    w = None if weight is None else F.col(weight)
    return scored.groupBy(*by).agg(*confusion_columns(F.col(label), F.col(prediction), w))


def with_rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from the four counts; an empty denominator gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns({
        "accuracy": ratio_or_zero(tp + tn, tn + fp + fn + tp),
        "precision": ratio_or_zero(tp, tp + fp),
        "recall": ratio_or_zero(tp, tp + fn),
        "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
    })


def class_distribution(rows: DataFrame, label: str) -> DataFrame:
    positive = F.count_if(F.col(label) == 1)
    return rows.agg(F.count("*").alias("total"), positive.alias("pos"),
                    F.count_if(F.col(label) == 0).alias("neg"),
                    ratio_or_zero(positive, F.count("*")).alias("pos_ratio"))


def score_counts(scored: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score; a null or NaN score counts as 0."""
    clean = finite(F.coalesce(F.col(score).cast("double"), F.lit(0.0)), infinite_to_one=False)
    return scored.groupBy(*by, clean.alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def roc_auc(scored: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank statistic with ties counted half; one class only gives 0.5, no rows at all 0."""
    by = list(by)
    ranked = running_totals(score_counts(scored, label, score, by), by, "score", ["neg"], descending=False)
    wins = F.sum(F.col("pos") * (F.col("run_neg") - F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    auc = F.when(F.count("*") == 0, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(wins, pairs), F.lit(0.5)))
    return ranked.groupBy(*by).agg(auc.alias("auc"))


def precision_recall(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall when predicting positive at or above each distinct score."""
    by = list(by)
    curve = running_totals(counts, by, "score", ["pos", "neg"], descending=True)
    return curve.select(
        *by, F.col("score").alias("threshold"), F.col("run_pos").alias("tp"), F.col("run_neg").alias("fp"),
        ratio_or_zero(F.col("run_pos"), F.col("run_pos") + F.col("run_neg")).alias("precision"),
        ratio_or_zero(F.col("run_pos"), F.col("all_pos")).alias("recall"))


def best_f1(curve: DataFrame, by: Sequence[str] = (), padded: bool = False, digits: int = 12) -> DataFrame:
    """Threshold of the highest F1, the lowest such threshold on ties.

    `padded` adds 1e-10 to the denominator, as the training report does; the tuner maps 0/0 to 0.
    F1 is compared at `digits` decimals, so equal values do not depend on rounding noise.
    """
    top = 2 * F.col("precision") * F.col("recall")
    bottom = F.col("precision") + F.col("recall")
    f1 = top / (bottom + F.lit(1e-10)) if padded else ratio_or_zero(top, bottom)
    best = F.max_by(F.struct("threshold", "f1", "precision", "recall"),
                    F.struct(F.round("f1", digits), -F.col("threshold")))
    return curve.withColumn("f1", f1).groupBy(*by).agg(best.alias("_b")).select(
        *by, F.col("_b.threshold").alias("threshold"), F.col("_b.f1").alias("f1"),
        F.col("_b.precision").alias("precision"), F.col("_b.recall").alias("recall"))


CHUNK = 65_536
MOST_TASKS = 4_096
ROUNDS_HELD = 16  # rounds of a chunk whose draws a task holds at once
SHIPPED_SCORES = 1 << 20  # distinct scores up to which the tasks hold them all, 24 MB


def _numbered(counts: DataFrame) -> DataFrame:
    """(label, rank, score): every row of a class under its rank by score, from the score counts.

    A score held by many rows is unfolded in chunks, never as one long array.
    """
    per_class = counts.select("score", F.explode(F.array(
        F.struct(F.lit(1).alias("label"), F.col("pos").alias("n")),
        F.struct(F.lit(0).alias("label"), F.col("neg").alias("n")))).alias("c")).select(
        "score", "c.label", "c.n").where("n > 0")
    ranked = running_totals(per_class, ["label"], "score", ["n"], descending=False)
    chunks = ranked.select("label", "score", "run_n", F.explode(
        F.sequence(F.col("run_n") - F.col("n"), F.col("run_n") - 1, F.lit(CHUNK))).alias("lo"))
    return chunks.select("label", "score", F.explode(
        F.sequence("lo", F.least(F.col("lo") + CHUNK, F.col("run_n")) - 1)).alias("rank"))


def bootstrap_by_rows(counts: DataFrame, rounds: int, seed: int) -> DataFrame:
    """Score counts per round, from as many hashed draws as there are rows in each class.

    With five positives or fewer the draws ignore the class.  Draws are a function of (seed, round,
    class, number), so they can be checked elsewhere; the cost is rounds times rows.  Rows under one score
    are the same, so a draw is looked up in the running counts of the scores, which every task holds; draws
    are counted where they are made.  Only beyond SHIPPED_SCORES are they joined to the rows.
    """
    counts = cut_lineage(counts)
    if counts.count() <= SHIPPED_SCORES:
        return _counted_draws(counts, rounds, seed)
    return _joined_draws(counts, rounds, seed)


def _draw_groups(pos: np.ndarray, neg: np.ndarray) -> tuple[dict, dict]:
    """For each group of draws the places of its scores, the rows under each, their label; and the running number of rows."""
    places = np.arange(len(pos))
    if pos.sum() > 5:
        groups = {1: (places, pos, np.ones_like(places)), 0: (places, neg, np.zeros_like(places))}
    else:  # without strata all rows form one group; negatives come first
        groups = {-1: (np.tile(places, 2), np.concatenate([neg, pos]), np.repeat([0, 1], len(places)))}
    return groups, {g: np.cumsum(n) for g, (_, n, _) in groups.items()}


def _counted_draws(counts: DataFrame, rounds: int, seed: int) -> DataFrame:
    spark = counts.sparkSession
    few = counts.select("score", "pos", "neg").toArrow().sort_by("score")  # at most SHIPPED_SCORES rows
    score, pos, neg = (few.column(c).to_numpy() for c in ("score", "pos", "neg"))
    sizes = {g: int(e[-1]) if len(e) else 0 for g, e in _draw_groups(pos, neg)[1].items()}
    shared = spark.sparkContext.broadcast((score, pos, neg))
    chunks = {g: -(-size // CHUNK) for g, size in sizes.items()}
    total = sum(chunks.values())
    parts = [spark.range(0, n, 1, max(1, min(n, MOST_TASKS * n // max(1, total)))).select(F.lit(g).alias("grp"), (F.col("id") * CHUNK).alias("lo"))
             for g, n in chunks.items()]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, pos, neg = shared.value
        groups, ends = _draw_groups(pos, neg)
        for batch in batches:
            for grp, lo in zip(batch["grp"].tolist(), batch["lo"].tolist()):
                yield from _chunk_draws(score, groups, ends, grp, lo, min(lo + CHUNK, sizes[grp]), rounds, seed)

    drawn = reduce(DataFrame.unionByName, parts).mapInPandas(draw, "round int, score double, pos bigint, neg bigint")
    return drawn.groupBy("round", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _chunk_draws(score: np.ndarray, groups: dict, ends: dict, grp: int, low: int, high: int, rounds: int, seed: int) -> Iterator[pd.DataFrame]:
    """(round, score, pos, neg) of the draws that have the numbers from low up to high, some rounds at a time."""
    place, _, label = groups[grp]
    size = np.uint64(ends[grp][-1])
    for first in range(1, rounds + 1, ROUNDS_HELD):
        numbers = range(first, min(first + ROUNDS_HELD, rounds + 1))
        found = [[] for _ in numbers]
        for _, digits in decimal_blocks(low, high):
            for part, number in zip(found, numbers):
                slots = hashed_numbers(f"{seed}|{number}|{grp}|", digits) % size
                part.append(np.searchsorted(ends[grp], slots.astype(np.int64), side="right"))
        each = [np.unique(np.concatenate(f), return_counts=True) for f in found]
        at, n = (np.concatenate([e[k] for e in each]) for k in (0, 1))
        number = np.repeat(np.array(numbers), [len(e[0]) for e in each])
        yield pd.DataFrame({"round": number, "score": score[place[at]], "pos": n * label[at], "neg": n * (1 - label[at])})


def _joined_draws(counts: DataFrame, rounds: int, seed: int) -> DataFrame:
    totals = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    rows = _numbered(counts).join(F.broadcast(totals), F.lit(True))
    stratified = F.col("p") > 5
    # Without strata all rows form one group; negatives come first.
    rows = rows.select(
        "label", "score",
        F.when(stratified, F.col("label")).otherwise(F.lit(-1)).alias("grp"),
        F.when(stratified | (F.col("label") == 0), F.col("rank")).otherwise(F.col("rank") + F.col("n"))
        .alias("slot"),
        F.when(~stratified, F.col("p") + F.col("n")).when(F.col("label") == 1, F.col("p"))
        .otherwise(F.col("n")).alias("size"))
    draws = rows.select("grp", "slot", "size", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    digits = F.substring(seeded_hash(seed, F.col("round"), F.col("grp"), F.col("slot")), 1, 15)
    draws = draws.select("round", "grp", (F.conv(digits, 16, 10).cast("bigint") % F.col("size")).alias("slot"))
    drawn = draws.join(rows.select("grp", "slot", "label", "score"), ["grp", "slot"])
    return drawn.groupBy("round", "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


SCORES_PER_BUCKET = 20_000


def bootstrap_by_counts(counts: DataFrame, rounds: int, seed: int) -> DataFrame:
    """Score counts per round, drawn as multinomials over the distinct scores.

    Same distribution as row draws, at a cost that follows the distinct scores, not the rows.  The
    draw is made in two levels: first how many rows fall into each bucket of scores, then inside
    each bucket.  Scores are spread over the buckets by hash, so no task holds more than a bucket.
    """
    buckets = max(1, -(-counts.count() // SCORES_PER_BUCKET))
    per_class = counts.select("score", F.explode(F.array(
        F.struct(F.lit(1).alias("label"), F.col("pos").alias("n")),
        F.struct(F.lit(0).alias("label"), F.col("neg").alias("n")))).alias("c")).select(
        "score", "c.label", "c.n").where("n > 0")
    totals = counts.agg(F.sum("pos").alias("_p"))
    placed = per_class.join(F.broadcast(totals), F.lit(True)).select(
        "score", "label", "n", F.when(F.col("_p") > 5, F.col("label")).otherwise(F.lit(-1)).alias("grp"),
        F.pmod(F.xxhash64("score"), F.lit(buckets)).cast("int").alias("bucket"))
    sizes = placed.groupBy("grp", "bucket").agg(F.sum("n").alias("n"))

    def draw_buckets(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bucket")
        weight = part["n"].to_numpy(dtype=float)
        place = int(part["grp"].iloc[0]) + 1
        drawn = np.stack([np.random.default_rng([seed, number, place]).multinomial(
            int(weight.sum()), weight / weight.sum()) for number in range(1, rounds + 1)])
        row, column = np.nonzero(drawn)
        return pd.DataFrame({"grp": part["grp"].iloc[0], "bucket": part["bucket"].to_numpy()[column],
                             "round": row + 1, "drawn": drawn[row, column]})

    # One row per bucket and group here.
    per_bucket = sizes.groupBy("grp").applyInPandas(
        draw_buckets, "grp int, bucket int, round int, drawn bigint")

    def draw_scores(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty or left.empty:
            return pd.DataFrame({"round": [], "score": [], "label": [], "n": []})
        right = right.sort_values(["score", "label"])
        weight = right["n"].to_numpy(dtype=float)
        weight /= weight.sum()
        place = [int(left["grp"].iloc[0]) + 1, int(left["bucket"].iloc[0])]
        hits = np.stack([np.random.default_rng([seed, int(number), *place]).multinomial(int(drawn), weight)
                         for number, drawn in zip(left["round"], left["drawn"])])
        row, column = np.nonzero(hits)
        return pd.DataFrame({"round": left["round"].to_numpy()[row], "score": right["score"].to_numpy()[column],
                             "label": right["label"].to_numpy()[column], "n": hits[row, column]})

    drawn = per_bucket.groupBy("grp", "bucket").cogroup(placed.groupBy("grp", "bucket")).applyInPandas(
        draw_scores, "round int, score double, label int, n bigint")
    return drawn.groupBy("round", "score").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("neg"))


def _round_thresholds(counts: DataFrame, rounds: int, seed: int, method: str) -> DataFrame:
    draw = {"rows": bootstrap_by_rows, "counts": bootstrap_by_counts}[method]
    return best_f1(precision_recall(draw(counts, rounds, seed), ["round"]), ["round"]).select(
        "round", "threshold", "f1")


def bootstrap_thresholds(scored: DataFrame, label: str, score: str, rounds: int = 100, seed: int = 42,
                         method: str = "counts") -> DataFrame:
    """Best-F1 threshold of every round."""
    return _round_thresholds(cut_lineage(score_counts(scored, label, score)), rounds, seed, method)


def threshold_summary(thresholds: DataFrame) -> DataFrame:
    """Mean, population deviation and the 95 % interval of the bootstrap thresholds."""
    return thresholds.agg(
        F.count("*").alias("rounds"), F.avg("threshold").alias("threshold"),
        F.stddev_pop("threshold").alias("deviation"),
        F.percentile("threshold", F.lit(0.025)).alias("ci_low"),
        F.percentile("threshold", F.lit(0.975)).alias("ci_high"))


def bootstrap_threshold(scored: DataFrame, label: str, score: str, rounds: int = 100, seed: int = 42,
                        method: str = "counts") -> DataFrame:
    """Robust threshold and how it does on the full data; one row."""
    counts = cut_lineage(score_counts(scored, label, score))  # the rows are read once, for all rounds
    summary = threshold_summary(_round_thresholds(counts, rounds, seed, method))
    counts = counts.join(F.broadcast(summary), F.lit(True))
    at = predicted(F.col("score"), F.col("threshold"))
    zero = F.lit(0).cast("bigint")
    full = counts.groupBy("rounds", "threshold", "deviation", "ci_low", "ci_high").agg(
        F.sum(F.when(at == 0, F.col("neg")).otherwise(zero)).alias("tn"),
        F.sum(F.when(at == 1, F.col("neg")).otherwise(zero)).alias("fp"),
        F.sum(F.when(at == 0, F.col("pos")).otherwise(zero)).alias("fn"),
        F.sum(F.when(at == 1, F.col("pos")).otherwise(zero)).alias("tp"))
    return with_rates(full)


def exact_quantiles(rows: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row of linearly interpolated quantiles, from counts per distinct value.

    The built-in exact percentile keeps all distinct values in one buffer; here they stay spread.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(
        F.count("*").alias("n"))
    ranked = running_totals(counts, [], "value", ["n"], descending=False)
    ends = []
    for name, share in shares.items():
        place = (F.col("all_n") - 1) * F.lit(share)
        ends += [F.min(F.when(F.col("run_n") > F.floor(place), F.col("value"))).alias(f"_lo_{name}"),
                 F.min(F.when(F.col("run_n") > F.ceil(place), F.col("value"))).alias(f"_hi_{name}"),
                 F.max(place - F.floor(place)).alias(f"_at_{name}")]
    out = ranked.agg(*ends)
    return out.select(*[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_at_{n}")).alias(n) for n in shares])


def confidence_summary(rows: DataFrame, confidence: str, percentile: float = 10) -> DataFrame:
    """Spread of the confidences of true positives, with the median and one chosen percentile."""
    c = F.col(confidence)
    basic = rows.agg(F.count("*").alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"))
    return basic.join(
        F.broadcast(exact_quantiles(rows, confidence, {"median": 0.5, "pk": percentile / 100})), F.lit(True))


def true_positives(scored: DataFrame, label: str, decision: str, confidence: str) -> DataFrame:
    return scored.where((F.col(label) == 1) & (F.col(decision) == "VULNERABLE") & F.col(confidence).isNotNull())


def top_groups(scored: DataFrame, label: str, group: str, raw: str, calibrated: str, k: int = 10,
               weight: str | None = None) -> DataFrame:
    """The `k` groups with most positives, with the recall of both predictions."""
    w = None if weight is None else F.col(weight)
    n = _count(F.lit(True), w)
    recall = lambda c: _count(F.col(c) == 1, w) / n
    return scored.where(F.col(label) == 1).groupBy(group).agg(
        n.alias("n"), recall(raw).alias("raw_recall"), recall(calibrated).alias("calibrated_recall"),
    ).orderBy(F.desc("n"), group).limit(k)


def comparison(scored: DataFrame, label: str, raw: str, calibrated: str, weight: str | None = None) -> DataFrame:
    """One row per metric: baseline, calibrated and their difference.  One pass over the rows."""
    pairs = F.explode(F.array(
        F.struct(F.lit("baseline").alias("side"), F.col(raw).alias("prediction")),
        F.struct(F.lit("calibrated").alias("side"), F.col(calibrated).alias("prediction")))).alias("p")
    kept = [F.col(label).alias("label")] + ([] if weight is None else [F.col(weight).alias("weight")])
    sides = scored.select(*kept, pairs).select(*[c for c in ("label", "weight")[:len(kept)]], "p.*")
    rates = with_rates(confusion(sides, "label", "prediction", ["side"], None if weight is None else "weight"))
    long = rates.unpivot("side", ["accuracy", "precision", "recall", "f1"], "metric", "value")
    wide = long.groupBy("metric").pivot("side", ["baseline", "calibrated"]).agg(F.first("value"))
    return wide.withColumn("delta", F.col("calibrated") - F.col("baseline"))
