"""Pages of a long ordered list without one task that counts to the offset.

The list is stored once in ranges of its key.  Each stored key has its rank inside its range and how often
it stands there; a directory holds the first rank and least key of each range, one row for RANGE_ROWS keys.  A page reads
the ranges that its ranks fall into and no others, whatever the offset.

Nulls, ties and empty lists: a null key comes first.  Repeated keys are stored once with their number and
come back as often, so no key makes a range larger; a page may begin and end inside them.  An empty list has
no ranges and every page of it is empty.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE_ROWS = 1_000_000


def store_pages(rows: DataFrame, key: str, folder: str, range_rows: int = RANGE_ROWS) -> None:
    """Store the values of `key`, in order, below `folder`."""
    ranges = max(1, -(-rows.count() // range_rows))
    counted = rows.groupBy(key).agg(F.count("*").alias("_copies"))
    placed = counted.repartitionByRange(ranges, key).withColumn("_range", F.spark_partition_id())
    above = Window.partitionBy("_range").orderBy(F.col(key).asc_nulls_first())
    ranked = placed.withColumn("_rank", F.sum("_copies").over(above) - F.col("_copies"))
    ranked.write.mode("overwrite").partitionBy("_range").parquet(f"{folder}/keys")
    stored = _keys(rows.sparkSession, folder, key, rows.schema[key].dataType.simpleString())
    before = F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")  # one row for a range
    sizes = stored.groupBy("_range").agg(F.sum("_copies").alias("_size"), F.min(key).alias("_least")).withColumn("_base", before)
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{folder}/directory")


def _keys(spark: SparkSession, folder: str, key: str, kind: str) -> DataFrame:
    return spark.read.schema(f"`{key}` {kind}, _copies long, _rank long, _range int").parquet(f"{folder}/keys")


def page_total(spark: SparkSession, folder: str) -> int:
    """How many rows the stored list has, from the directory alone."""
    return spark.read.parquet(f"{folder}/directory").agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]


def read_page(spark: SparkSession, folder: str, key: str, offset: int = 0, limit: int = 0) -> DataFrame:
    """(key, place): the rows at places offset to offset + limit, places from 0; without a limit all from the offset."""
    directory = spark.read.parquet(f"{folder}/directory")
    met = F.col("_base") + F.col("_size") > offset
    if limit > 0:
        met &= F.col("_base") < offset + limit
    low, high = directory.where(met).agg(F.min("_range"), F.max("_range")).first()
    if low is None:
        low, high = 0, -1
    keys = _keys(spark, folder, key, directory.schema["_least"].dataType.simpleString()).where(F.col("_range").between(low, high))
    rows = keys.join(F.broadcast(directory.select("_range", "_base")), "_range")
    first = F.col("_base") + F.col("_rank")
    after = first + F.col("_copies")
    low_place, end = F.greatest(first, F.lit(offset)), F.least(after, F.lit(offset + limit)) if limit > 0 else after
    cut = rows.select(key, low_place.alias("_low"), end.alias("_end")).where("_low < _end")
    return cut.select(key, F.explode(F.sequence(F.col("_low"), F.col("_end") - 1)).alias("place"))
