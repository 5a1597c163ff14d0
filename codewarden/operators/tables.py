"""Task, result, cache and knowledge-base tables: selection, keyed replace, upsert, counts.

All functions take and return DataFrames; `sources.store` writes them.
"""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_split(tasks: DataFrame, split: str, parity_like: bool = False) -> DataFrame:
    """Rows of a split: by partition column, or by name prefix in parity mode, in which case is
    ignored and `_` in the split stands for any character."""
    if parity_like:
        return tasks.where(F.col("name").ilike(f"{split}%"))
    return tasks.where(F.col("split") == split)


def work_list(tasks: DataFrame, split: str, offset: int = 0, limit: int = 0, parity_like: bool = False) -> DataFrame:
    """Ids of pending and failed tasks, in id order; offset and limit count only when positive."""
    out = in_split(tasks, split, parity_like).where(F.col("status").isin("Pending", "Failed")).select("id")
    if offset > 0 or limit > 0:
        out = out.orderBy("id")
    if offset > 0:
        out = out.offset(offset)
    if limit > 0:
        out = out.limit(limit)
    return out


def with_static_cache(tasks: DataFrame, cache: DataFrame) -> DataFrame:
    """Tasks with their cached facts; source type 0 where there are none."""
    facts = cache.select(F.col("task_name").alias("name"), "source_type", "feature_json")
    return tasks.join(facts, "name", "left").withColumn(
        "source_type", F.coalesce("source_type", F.lit(0)))


def uncached(tasks: DataFrame, cache: DataFrame) -> DataFrame:
    """Tasks with text that have no cache row yet."""
    return tasks.where(F.coalesce("code", F.lit("")) != "").join(
        cache.select(F.col("task_name").alias("name")), "name", "left_anti")


def fetch_by_key(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def replace_keyed(existing: DataFrame, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Existing rows whose key does not come in, plus the incoming rows; doing it twice changes nothing.

    With `order` only the last incoming row of a key counts.
    """
    incoming = latest_per_key(incoming, key, order) if order else incoming
    kept = existing.join(incoming.select(key).distinct(), key, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def write_results(tasks: DataFrame, results: DataFrame, batch: DataFrame, payload: Iterable[str],
                  order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """New task and result tables after a batch of (vuln_id, outcome, status, payload columns).

    Results of every task in the batch go away, successful ones come back with new values; each
    task takes the status of the batch.  Where a task stands twice its last row by `order` counts.
    """
    if order:
        batch = latest_per_key(batch, "vuln_id", order)
    touched = batch.select("vuln_id").distinct()
    success = batch.where(F.col("outcome") == "success").select("vuln_id", *payload)
    kept = results.join(touched, "vuln_id", "left_anti")
    new_results = kept.unionByName(success, allowMissingColumns=True)
    status = batch.groupBy("vuln_id").agg(F.max("status").alias("_status"))
    new_tasks = tasks.join(status.withColumnRenamed("vuln_id", "id"), "id", "left").withColumn(
        "status", F.coalesce("_status", "status")).drop("_status")
    return new_tasks, new_results


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Full outer merge by key; incoming values win where a row comes in, the last by `order` of a key."""
    incoming = latest_per_key(incoming, key, order) if order else incoming
    columns = [c for c in existing.columns if c != key]
    old, new = existing.alias("old"), incoming.withColumn("_new", F.lit(True)).alias("new")
    merged = old.join(new, key, "full_outer")
    return merged.select(key, *[
        (F.when(F.col("new._new"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) if c in incoming.columns
         else F.col(f"old.{c}")).alias(c) for c in columns])


def write_back(results: DataFrame, scores: DataFrame, key: str, column: str) -> DataFrame:
    """Replace one column by key; rows without a new value keep the old one."""
    fresh = scores.select(key, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    return results.join(fresh, key, "left").withColumn(
        column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_hit")


def reset_tables(tables: dict[str, DataFrame], mode: str) -> dict[str, DataFrame]:
    """Clean up: results_only, results_and_static, all_tasks or recreate (all four tables empty)."""
    empty = {name: frame.limit(0) for name, frame in tables.items()}
    out = dict(tables)
    if mode == "recreate":
        return empty
    if mode not in ("results_only", "results_and_static", "all_tasks"):
        raise ValueError(f"unknown mode {mode!r}")
    out["results"] = empty["results"]
    if mode != "results_only":
        out["cache"] = empty["cache"]
    if mode == "all_tasks":
        out["tasks"] = empty["tasks"]
    else:
        out["tasks"] = tables["tasks"].withColumn("status", F.lit("Pending"))
    return out


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last by `order`.  Aggregates map-side, so a hot key stays cheap."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_r")).select(key, "_r.*")


def progress(tasks: DataFrame) -> DataFrame:
    """Total and completed tasks per split."""
    return tasks.groupBy("split").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "Success").alias("completed"))


def run_report(runs: DataFrame) -> DataFrame:
    """Counters of a run from its rows (status, source_type, reflected, final_decision), so that
    retried tasks are not counted twice."""
    success = F.col("status") == "Success"
    return runs.agg(
        F.count("*").alias("processed"), F.count_if(success).alias("succeeded"), F.count_if(~success).alias("failed"),
        F.count_if(success & F.col("reflected") & (F.col("final_decision") == "BENIGN")).alias("corrected"),
        F.count_if(success & F.col("reflected") & (F.col("final_decision") == "VULNERABLE")).alias("maintained"),
        F.count_if(F.col("source_type") == 2).alias("from_dataflow"),
        F.count_if(F.col("source_type") == 1).alias("from_lexical"),
        F.count_if(F.col("source_type") == 0).alias("from_none"))


def integrity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Do two index tables hold the same ids?  Order-free, so it needs no sort."""
    def digest(rows: DataFrame, side: str) -> DataFrame:
        return rows.agg(
            F.count("*").alias(f"rows_{side}"), F.count_distinct(key).alias(f"ids_{side}"),
            F.coalesce(F.sum(F.xxhash64(F.col(key).cast("string")).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
            .alias(f"digest_{side}"))
    both = digest(left, "left").join(digest(right, "right"), F.lit(True))
    return both.select(
        "rows_left", "rows_right", "ids_left", "ids_right",
        ((F.col("rows_left") == F.col("rows_right")) & (F.col("ids_left") == F.col("rows_left"))
         & (F.col("ids_right") == F.col("rows_right")) & (F.col("digest_left") == F.col("digest_right"))).alias("intact"))


def id_list_md5(rows: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """A digest of the ordered id list: the md5 over the md5 of each block of ids.

    Blocks are cut by the first hex digits of the id's own md5, so no task holds more than one of
    16**digits shares of the ids, and the last step sees 16**digits digests at most.
    """
    text = rows.select(F.col(key).alias("_id"), F.md5(F.col(key).cast("string")).alias("_h"))
    blocks = text.groupBy(F.substring("_h", 1, digits).alias("_b")).agg(
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("_id")), lambda i: i.cast("string")), "")).alias("_d"))
    ordered = F.array_sort(F.collect_list(F.struct("_b", "_d")))
    return blocks.agg(F.md5(F.array_join(F.transform(ordered, lambda x: x["_d"]), "")).alias("ids_md5"))
