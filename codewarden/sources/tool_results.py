"""Results of the external data-flow tool."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.functions import loose
from codewarden.functions.static_facts import empty_names
from codewarden.sources.lists import list_items


def map_tool_results(rows: DataFrame) -> DataFrame:
    """One row of facts per task from (filename, apis, complexity, has_data_flow, error, pos).

    Error rows and files other than `<task id>.c` are skipped; the last row of a file wins.
    """
    task = F.regexp_extract(F.element_at(F.split("filename", "/"), -1), r"^(\d+)\.c$", 1).try_cast("bigint")
    facts = rows.where(F.col("error").isNull()).select(
        task.alias("task_id"), "pos",
        F.coalesce(F.col("complexity").cast("int"), F.lit(0)).alias("complexity"),
        F.coalesce("has_data_flow", F.lit(False)).alias("has_data_flow"),
        F.array_sort(F.array_distinct(F.coalesce("apis", empty_names()))).alias("apis"),
    ).where(F.col("task_id").isNotNull())
    last = F.max_by(F.struct("complexity", "has_data_flow", "apis"), F.col("pos"))
    return facts.groupBy("task_id").agg(last.alias("_f")).select("task_id", "_f.*")


def read_tool_results(spark: SparkSession, path: str) -> DataFrame:
    """Facts from result files, each a JSON list of rows."""
    items = list_items(spark, path).select(F.col("row_index").alias("pos"), F.col("record").alias("r"))
    items = items.withColumn("apis", F.try_variant_get("r", "$.apis", "array<string>"))
    items = loose.unpack(items, "r", "filename", "complexity", "has_data_flow", "error")
    return map_tool_results(items.select(
        "pos", "apis", loose.text("filename").alias("filename"), loose.whole_number("complexity").alias("complexity"),
        loose.truthy("has_data_flow").alias("has_data_flow"),
        F.when(~loose.missing("error"), F.lit("error")).alias("error")))
