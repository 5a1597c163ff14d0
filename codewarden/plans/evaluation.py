"""Threshold tuning and evaluation over task and result tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.functions import features as X
from codewarden.functions.constants import DEFAULT_THRESHOLD
from codewarden.operators import metrics
from codewarden.operators.tables import in_split
from codewarden.session import cut_lineage
from codewarden.sources.store import stored_threshold


def finished(tasks: DataFrame, results: DataFrame, split: str, parity_like: bool = False) -> DataFrame:
    """Results of the successful tasks of a split."""
    done = in_split(tasks, split, parity_like).where(F.col("status") == "Success")
    wanted = done.select(F.col("id").alias("vuln_id"), "ground_truth_label", F.col("cwe_id").alias("task_cwe"))
    return results.join(wanted, "vuln_id")


def scored_rows(joined: DataFrame, threshold: float | None, meta: DataFrame | None = None) -> DataFrame:
    """Label, both predictions, score and group of every finished task.

    The threshold is the given one, else the stored one of `meta`, else the default.
    """
    limit = F.lit(DEFAULT_THRESHOLD if threshold is None else threshold)
    if threshold is None and meta is not None:
        joined = joined.join(F.broadcast(stored_threshold(meta).select(F.col("threshold").alias("_threshold"))), F.lit(True))  # one row
        limit = F.col("_threshold")
    score = F.coalesce(F.col("calibrated_confidence"), F.lit(0.0))
    return joined.select(
        F.col("ground_truth_label").alias("label"), X.decision_flag(F.col("final_decision")).alias("raw_pred"),
        X.predicted(score, limit).alias("cal_pred"), score.alias("score"),
        X.cwe_or_other(F.col("task_cwe")).alias("cwe"))


def outcome_counts(rows: DataFrame) -> DataFrame:
    """Rows counted by label, both predictions and group: all that the tables below need."""
    return cut_lineage(rows.groupBy("label", "raw_pred", "cal_pred", "cwe").agg(F.count("*").alias("rows")))


def evaluate(tasks: DataFrame, results: DataFrame, split: str, threshold: float | None = None,
             meta: DataFrame | None = None) -> dict[str, DataFrame]:
    """Comparison table, AUC, confusion matrix and group breakdown of one split.

    The joined rows are read twice: once for the counts, once for the scores.
    """
    return _reports(scored_rows(finished(tasks, results, split), threshold, meta))


def _reports(rows: DataFrame) -> dict[str, DataFrame]:
    counts = outcome_counts(rows)
    return {
        "comparison": metrics.comparison(counts, "label", "raw_pred", "cal_pred", "rows"),
        "auc": metrics.roc_auc(rows, "label", "score"),
        "confusion": metrics.confusion(counts, "label", "cal_pred", weight="rows"),
        "groups": metrics.top_groups(counts, "label", "cwe", "raw_pred", "cal_pred", weight="rows"),
    }


def evaluation_report(rows: DataFrame) -> DataFrame:
    """All figures of one evaluation as (section, item, baseline, calibrated)."""
    tables = _reports(rows)
    nothing = F.lit(None).cast("double").alias("baseline")
    table = tables["comparison"].select(F.lit("metric").alias("section"), F.col("metric").alias("item"), "baseline", "calibrated")
    auc = tables["auc"].select(F.lit("metric").alias("section"), F.lit("auc").alias("item"), nothing, F.col("auc").alias("calibrated"))
    matrix = tables["confusion"].unpivot([], ["tn", "fp", "fn", "tp"], "item", "calibrated").select(
        F.lit("confusion").alias("section"), "item", nothing, F.col("calibrated").cast("double"))
    groups = tables["groups"].select(
        F.lit("group").alias("section"), F.concat_ws(":", "cwe", F.col("n").cast("string")).alias("item"),
        F.col("raw_recall").alias("baseline"), F.col("calibrated_recall").alias("calibrated"))
    return table.unionByName(auc).unionByName(matrix).unionByName(groups)


def tune(tasks: DataFrame, results: DataFrame, split: str, rounds: int = 100, seed: int = 42,
         method: str = "counts") -> DataFrame:
    rows = finished(tasks, results, split)
    return metrics.bootstrap_threshold(rows, "ground_truth_label", "calibrated_confidence", rounds, seed, method)


def tp_confidence_percentile(tasks: DataFrame, results: DataFrame, split: str, percentile: float = 10) -> DataFrame:
    rows = metrics.true_positives(finished(tasks, results, split), "ground_truth_label", "final_decision",
                                  "native_confidence")
    return metrics.confidence_summary(rows, "native_confidence", percentile)
