"""Static facts of tasks: external results where there are some, lexical ones elsewhere."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.functions import constants as K
from codewarden.functions import static_facts as S
from codewarden.operators.tables import uncached

FEATURE_SCHEMA = "has_flow boolean, complexity int, apis array<string>"


def fuse_facts(tasks: DataFrame, facts: DataFrame, task_id: str = "id", code: str = "code",
               names=K.LEXICAL_API_NAMES, calls_first: bool = False) -> DataFrame:
    """Tasks with has_data_flow, complexity, apis, source_type, analysis_mode and lexical_hit.

    `facts` is one row per task the tool could analyse.  A task without one falls back to the
    lexical scan: no data flow is claimed for it.  With `calls_first` a name that is merely
    mentioned counts only in texts without any call of a listed name.
    """
    scan = S.scan_names if calls_first else S.names_used
    tool = facts.select(F.col("task_id").alias(task_id), F.col("complexity").alias("_complexity"),
                        F.col("has_data_flow").alias("_flow"), F.col("apis").alias("_apis"), F.lit(True).alias("_ok"))
    joined = tasks.join(tool, task_id, "left").withColumn("_lexical", scan(F.col(code), names))
    ok = F.coalesce("_ok", F.lit(False))
    return joined.select(
        *tasks.columns,
        (ok & F.coalesce("_flow", F.lit(False))).alias("has_data_flow"),
        F.when(F.coalesce("_complexity", F.lit(0)) > 0, F.col("_complexity"))
        .otherwise(S.lexical_complexity(F.col(code))).alias("complexity"),
        S.merge_names(F.col("_apis"), F.col("_lexical")).alias("apis"),
        F.when(ok, F.lit(K.SOURCE_DATAFLOW)).otherwise(F.lit(K.SOURCE_LEXICAL)).alias("source_type"),
        F.when(ok, F.lit("hybrid")).otherwise(F.lit("ast_fallback")).alias("analysis_mode"),
        (~ok & (F.size("_lexical") > 0)).alias("lexical_hit"))


def encode_features(facts: DataFrame, name: str = "name") -> DataFrame:
    """Cache rows: task_name, source_type, analysis_mode and the facts as JSON."""
    payload = F.struct(F.col("has_data_flow").alias("has_flow"), F.col("complexity"), F.col("apis"))
    return facts.select(F.col(name).alias("task_name"), "source_type", "analysis_mode",
                        F.to_json(payload).alias("feature_json"))


def decode_features(tasks: DataFrame, json: str = "feature_json") -> DataFrame:
    """Add has_flow, complexity and apis from the cached JSON, with safe defaults.

    Lexical facts never claim a data flow.
    """
    f = F.from_json(F.coalesce(F.col(json), F.lit("{}")), FEATURE_SCHEMA)
    flow = F.when(F.col("source_type") == K.SOURCE_LEXICAL, F.lit(False)).otherwise(
        F.coalesce(F.col("_f.has_flow"), F.lit(False)))
    return tasks.withColumn("_f", f).withColumns({
        "has_flow": flow, "complexity": F.coalesce("_f.complexity", F.lit(0)),
        "apis": F.coalesce("_f.apis", S.empty_names())}).drop("_f")


def static_features(tasks: DataFrame, cache: DataFrame, facts: DataFrame, names=K.LEXICAL_API_NAMES) -> DataFrame:
    """Cache rows for the tasks that have none yet."""
    return encode_features(fuse_facts(uncached(tasks, cache), facts, names=names))


def crashed_batches(tasks: DataFrame, facts: DataFrame, batch: str, task_id: str = "id") -> DataFrame:
    """Batches of more than one task in which the tool got no result at all: to be sent one by one."""
    ok = facts.select(F.col("task_id").alias(task_id), F.lit(1).alias("_ok"))
    return tasks.join(ok, task_id, "left").groupBy(batch).agg(
        F.count("*").alias("tasks"), F.count("_ok").alias("succeeded")).where("tasks > 1 AND succeeded = 0")
