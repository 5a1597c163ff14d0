"""The audit run as four table jobs: prompts out, responses in, rebuttals out, final results.

Responses arrive as a table (task_id, round, content, logprobs), whatever produced them.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.functions import constants as K
from codewarden.functions import features as X
from codewarden.functions import prompts as P
from codewarden.functions import responses as R
from codewarden.functions import static_facts as S
from codewarden.operators.retrieval import hit_stats
from codewarden.operators.static_facts import decode_features
from codewarden.operators.tables import with_static_cache

Scorer = Callable[[DataFrame], DataFrame]


def task_features(tasks: DataFrame, cache: DataFrame, hits: DataFrame) -> DataFrame:
    """Tasks with static facts, text features and retrieval statistics; the hits as one small array."""
    stats = hit_stats(tasks.select(F.col("id").alias("qid")), hits).withColumnRenamed("qid", "id")
    # The list of a task is as long as the search returns hits for it.
    listed = hits.groupBy(F.col("qid").alias("id")).agg(F.array_sort(F.collect_list(
        F.struct("rank", "original_id", "label", "similarity"))).alias("hits"))
    rows = decode_features(with_static_cache(tasks, cache))
    rows = rows.join(stats, "id").join(listed, "id", "left")
    return rows.withColumns({
        "api_count": F.size("apis"),
        "density": S.risk_density(F.size("apis"), F.col("code")),
        "graph_density": S.nesting(F.col("code"))["density"],
        "code_len": F.length("code"),
        "compressed": S.is_long(F.col("code")),
        "evidence": P.evidence_text(F.col("source_type"), F.col("has_flow")),
    })


def make_prompts(features: DataFrame, few_shot: str = "", low_density: float = 0.3, system: str = "") -> DataFrame:
    """(id, prompt), as sent: after the system text, if there is one, and without control characters."""
    rules = P.constraint_text(F.col("source_type"), F.col("has_flow"), F.col("density"), low_density)
    prompt = P.audit_prompt(F.col("code"), F.col("complexity"), F.col("density"), F.col("evidence"),
                            P.hits_text(F.col("hits")), rules, few_shot)
    return features.select("id", P.as_sent(prompt, system).alias("prompt"))


def native_score(rows: DataFrame) -> DataFrame:
    """The score where no calibrator is at hand: the native confidence."""
    return rows.withColumn("score", F.coalesce("llm_native_conf", F.lit(0.5)))


def _answers(responses: DataFrame, number: int) -> DataFrame:
    """Checked responses of one round with their certainty measures."""
    rows = responses.where(F.col("round") == number).select(
        F.col("task_id").alias("id"), "content", R.native_confidence(F.col("logprobs")).alias("_conf"),
        R.entropy(F.col("logprobs")).alias("_ent"))
    return R.parse_responses(rows)


def _with_response(features: DataFrame, responses: DataFrame, number: int) -> DataFrame:
    return features.join(_answers(responses, number).select(
        "id", "response", F.col("_conf").alias("native_confidence"), F.col("_ent").alias("feat_llm_uncertainty")),
        "id", "left")


def _vector(rows: DataFrame) -> DataFrame:
    """The 15 features, computed online from the task's own columns."""
    decision = X.decision_flag(F.col("response.final_decision"))
    named = rows.withColumns({
        "static_has_flow": F.col("has_flow"), "static_complexity": F.col("complexity"),
        "feat_static_apis_count": F.col("api_count"), "feat_static_risk_density": F.col("density"),
        "feat_static_graph_density": F.col("graph_density"), "feat_static_source_type": F.col("source_type"),
        "feat_code_len": F.col("code_len"), "feat_is_compressed": F.col("compressed"),
        "feature_rag_similarity": F.col("sim_avg"), "feat_rag_top1_sim": F.col("sim_max"),
        "feat_rag_sim_variance": F.col("sim_var"),
        "feat_conflict_disagreement": X.weighted_conflict(F.col("source_type"), F.col("has_flow"), decision),
        "feat_conflict_static_yes_llm_no": X.flow_but_benign(F.col("has_flow"), decision),
    })
    return named.withColumns(dict(zip(K.FEATURE_NAMES, X.feature_columns(online=True))))


def score_round1(features: DataFrame, responses: DataFrame, scorer: Scorer = native_score,
                 weak_below: float = 0.5) -> DataFrame:
    """Tasks with the first response, its score and the reason for a second round, if any."""
    scored = scorer(_vector(_with_response(features, responses, 1)))
    decision = X.decision_flag(F.col("response.final_decision"))
    return scored.withColumn("reason", X.reflection_reason(
        F.col("source_type"), F.col("has_flow"), decision, F.col("score"), weak_below))


def make_rebuttals(round1: DataFrame, prompts: DataFrame) -> DataFrame:
    """(id, reason, prompt) for the tasks that get a second round."""
    asked = round1.where(F.col("reason").isNotNull()).select("id", "reason", "evidence", "score")
    return asked.join(prompts, "id").select("id", "reason", P.as_sent(P.rebuttal_prompt(
        F.col("prompt"), F.col("evidence"), F.col("score"))).alias("prompt"))


def finalise(features: DataFrame, responses: DataFrame, scorer: Scorer = native_score, weak_below: float = 0.5,
             reliable_from: float = K.RELIABLE_CONFIDENCE) -> DataFrame:
    """Outcome of every task: the second response where one was asked for and came, else the first.

    A task without a first response has status Failed and no result values.
    """
    first = score_round1(features, responses, scorer, weak_below)
    first = first.withColumnRenamed("score", "first_score")
    second = _answers(responses, 2).select(
        "id", F.col("response").alias("_r2"), F.col("_conf").alias("_conf2"), F.col("_ent").alias("_ent2"))
    joined = first.join(second, "id", "left")
    used = F.col("reason").isNotNull() & F.col("_r2").isNotNull()
    merged = joined.withColumns({
        "reflected": used,
        "response": F.when(used, F.col("_r2")).otherwise(F.col("response")),
        "native_confidence": F.when(used, F.col("_conf2")).otherwise(F.col("native_confidence")),
        "feat_llm_uncertainty": F.when(used, F.col("_ent2")).otherwise(F.col("feat_llm_uncertainty")),
    }).drop("_r2", "_conf2", "_ent2")
    failed = F.col("response").isNull()
    scored = scorer(_vector(merged)).withColumn("failed", failed)
    decision = F.col("response.final_decision")
    return scored.select(
        F.col("id").alias("vuln_id"), F.when(failed, F.lit("Failed")).otherwise(F.lit("Success")).alias("status"),
        F.to_json(F.struct(*[F.col(f"response.{c}") for c in (
            "thought_process", "static_analysis_review", "evidence", "final_decision", "confidence", "cwe_id")]))
        .alias("raw_json"),
        decision.alias("final_decision"), F.col("response.cwe_id").alias("cwe_id"), "native_confidence",
        F.when(~failed, F.col("score")).alias("calibrated_confidence"), "first_score", "reason", "reflected",
        (F.col("reflected") & (decision == "VULNERABLE") & (F.col("native_confidence") < reliable_from))
        .alias("unreliable"), F.col("source_type").cast("int").alias("source_type"),
        F.col("has_flow").alias("static_has_flow"), F.col("complexity").alias("static_complexity"),
        "feat_static_apis_count", "feat_static_risk_density",
        "feat_static_graph_density", "feat_static_source_type", "feat_code_len", "feat_is_compressed",
        "feature_rag_similarity", "feat_rag_top1_sim", "feat_rag_sim_variance", "feat_conflict_disagreement",
        "feat_conflict_static_yes_llm_no", "feat_llm_uncertainty")
