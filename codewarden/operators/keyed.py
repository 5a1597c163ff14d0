"""Stored tables by key of which a batch rewrites only the buckets that it touches.

A table lies in one folder for each bucket, by the hash of its key.  A batch is folded into the buckets of its keys;
these are checkpointed and then take the place of the old ones, the files of all others stay as they are.  A batch of
non-null keys that is folded in twice leaves the same table.  Lost executors do no harm; but folders are replaced without
a transaction, so if the driver stops between the removal of a bucket and its return, that bucket's other rows are lost.

Nulls, ties and empty tables: a null key has a bucket like any other, but matches no key, so its rows stay and rows
that come in with one are added by `replace` and `merge`, each time they come.  Where a key comes in several times, the last by `order`
counts; without an order keys must be single.  An empty batch touches nothing.  `_bucket` can't be a column.  A key that
holds many rows makes its bucket large: such tables are for keys of few rows, like tasks, results and cached facts.
"""

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from codewarden.operators.tables import replace_keyed, upsert, write_back
from codewarden.session import cut_lineage

BUCKETS = 256


def _placed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def store(rows: DataFrame, key: str, folder: str, buckets: int = BUCKETS) -> None:
    """Write a new table; `buckets` is for good, about the final size over 128 MB."""
    rows.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(buckets).alias("buckets"), F.lit(
        rows.schema.json()).alias("columns")).coalesce(1).write.mode("overwrite").json(f"{folder}/meta")
    _placed(rows, key, buckets).repartition("_bucket").write.mode("overwrite").option(
        "partitionOverwriteMode", "static").partitionBy("_bucket").parquet(f"{folder}/rows")


def _meta(spark: SparkSession, folder: str) -> tuple[str, int, StructType]:
    row = spark.read.schema("key string, buckets int, columns string").json(f"{folder}/meta").first()
    return row["key"], row["buckets"], StructType.fromJson(json.loads(row["columns"]))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The stored table."""
    return _stored(spark, folder, _meta(spark, folder)[2]).drop("_bucket")


def _stored(spark: SparkSession, folder: str, columns: StructType) -> DataFrame:
    return spark.read.schema(StructType([*columns.fields, StructField("_bucket", IntegerType())])).parquet(f"{folder}/rows")


def _fold(spark: SparkSession, folder: str, batch: DataFrame, change: Callable[[DataFrame, DataFrame, str], DataFrame]) -> list[int]:
    """Replace the buckets of the batch by what `change` makes of them; returns their numbers, `buckets` at most."""
    key, buckets, columns = _meta(spark, folder)
    batch = cut_lineage(batch)
    touched = sorted(r[0] for r in _placed(batch.select(key), key, buckets).select("_bucket").distinct().collect())
    if touched:
        old = _stored(spark, folder, columns).where(F.col("_bucket").isin(touched)).drop("_bucket")
        new = change(old, batch, key).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns.fields])
        staged = cut_lineage(_placed(new, key, buckets).repartition("_bucket"))
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{folder}/rows")
    return touched


def replace(spark: SparkSession, folder: str, batch: DataFrame, order: str | None = None) -> list[int]:
    """Rows of the keys that come in go, the rows of the batch take their place."""
    return _fold(spark, folder, batch, lambda old, new, key: replace_keyed(old, new, key, order))


def merge(spark: SparkSession, folder: str, batch: DataFrame, order: str | None = None) -> list[int]:
    """Upsert: columns of the batch win where its key is met, new keys are added."""
    return _fold(spark, folder, batch, lambda old, new, key: upsert(old, new, key, order))


def set_column(spark: SparkSession, folder: str, values: DataFrame, column: str) -> list[int]:
    """Write one column back by key; keys that the table lacks are left out."""
    return _fold(spark, folder, values, lambda old, new, key: write_back(old, new, key, column))
