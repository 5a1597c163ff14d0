"""The 15-column feature vector and the rules around it."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from codewarden.functions import constants as K


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def _or(column: Column, default: float) -> Column:
    return F.coalesce(column.cast("double"), F.lit(default))


def feature_columns(online: bool = False) -> list[Column]:
    """Feature columns, in model order, from a results table.

    A native confidence of exactly 0 counts as 0.5, as in training; `online` keeps it.
    """
    native = F.col("native_confidence").cast("double")
    if online:
        confidence = F.coalesce(native, F.lit(0.0))
    else:
        confidence = F.when(F.coalesce(native, F.lit(0.0)) == 0.0, F.lit(0.5)).otherwise(native)
    by_name = {
        "llm_native_conf": confidence,
        "static_has_flow": flag(F.col("static_has_flow")),
        "static_complexity": _or(F.col("static_complexity"), 0.0),
        "static_apis_count": _or(F.col("feat_static_apis_count"), 0.0),
        "static_risk_density": _or(F.col("feat_static_risk_density"), 0.0),
        "static_graph_density": _or(F.col("feat_static_graph_density"), 0.0),
        "source_type": _or(F.col("feat_static_source_type"), 0.0),
        "code_len_log": F.log1p(_or(F.col("feat_code_len"), 0.0)),
        "is_compressed": flag(F.col("feat_is_compressed")),
        "rag_sim_avg": _or(F.col("feature_rag_similarity"), 0.0),
        "rag_top1_sim": _or(F.col("feat_rag_top1_sim"), 0.0),
        "rag_var": _or(F.col("feat_rag_sim_variance"), 0.0),
        "conflict_disagree_weighted": _or(F.col("feat_conflict_disagreement"), 0.0),
        "conflict_special": _or(F.col("feat_conflict_static_yes_llm_no"), 0.0),
        "llm_entropy": _or(F.col("feat_llm_uncertainty"), 0.0),
    }
    return [by_name[name].alias(name) for name in K.FEATURE_NAMES]


def finite(value: Column, infinite_to_one: bool = True) -> Column:
    """NaN becomes 0; infinities become +1 and -1 unless `infinite_to_one` is off."""
    clean = F.nanvl(value, F.lit(0.0))
    if not infinite_to_one:
        return clean
    return (
        F.when(clean == float("inf"), F.lit(1.0))
        .when(clean == float("-inf"), F.lit(-1.0))
        .otherwise(clean)
    )


def decision_flag(decision: Column) -> Column:
    return F.when(decision == "VULNERABLE", F.lit(1)).otherwise(F.lit(0))


def cwe_or_other(cwe: Column) -> Column:
    empty = cwe.isNull() | (cwe == "") | (F.upper(cwe) == "N/A")
    return F.when(empty, F.lit("Other")).otherwise(cwe)


def predicted(score: Column, threshold: Column | float) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(score >= limit, F.lit(1)).otherwise(F.lit(0))


def weighted_conflict(source_type: Column, has_flow: Column, decision: Column) -> Column:
    """Provenance weight times the disagreement between data flow and decision."""
    return source_type.cast("double") * F.abs(has_flow.cast("int") - decision)


def flow_but_benign(has_flow: Column, decision: Column) -> Column:
    return F.when(has_flow & (decision == 0), F.lit(1)).otherwise(F.lit(0))


def reflection_reason(source_type: Column, has_flow: Column, decision: Column, score: Column,
                      weak_below: float = 0.5) -> Column:
    """Why a positive verdict gets a second round; NULL when it gets none."""
    conflict = (source_type == K.SOURCE_DATAFLOW) & ~has_flow & (decision == 1)
    weak = (decision == 1) & (score < weak_below)
    return F.when(conflict, F.lit("Conflict")).when(weak, F.lit("WeakCalibration"))
