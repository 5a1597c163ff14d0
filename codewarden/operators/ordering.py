"""Ranks and running totals that never send a whole table, or a whole hot group, to one task.

Both work in two levels: rows fall into ordered buckets, per-bucket totals give the offsets, and a
window only ever sees one bucket of one group.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codewarden.session import cut_lineage

HASH_PREFIX = 5  # hex digits: a million buckets per group; only those that hold rows are counted
BUCKET_ROWS = 1_000_000
SHIPPED_EDGES = 1 << 16  # edges of all groups up to which they and the totals of their buckets are broadcast, some 6 MB


def seeded_hash(seed: int | str, *keys: Column) -> Column:
    """A reproducible shuffle key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def lowest_hashes(rows: DataFrame, keys: Sequence[str], quotas: DataFrame, row_id: str, order: str) -> DataFrame:
    """Per group, the `take` rows of lowest hash, as (keys, row_id).

    `quotas` holds one row per group with a `take` column (no keys: a single row).  The hash is
    uniform, so its first digits cut each group into even buckets.  Buckets beyond the cut are
    dropped by a join on the bucket counts; ranks are only needed inside a bucket.
    """
    keys = list(keys)
    narrow = rows.select(*keys, row_id, order, F.substring(order, 1, HASH_PREFIX).alias("_bucket"))
    sizes = narrow.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # A quota table without keys is a single row.
    cuts = cuts.join(quotas, keys) if keys else cuts.join(F.broadcast(quotas), F.lit(True))
    cuts = cuts.where(F.col("_before") < F.col("take")).select(
        *keys, "_bucket", (F.col("take") - F.col("_before")).alias("_left"))
    rank = Window.partitionBy(*keys, "_bucket").orderBy(order, row_id)
    near = narrow.join(cuts, [*keys, "_bucket"]).withColumn("_rank", F.row_number().over(rank))
    return near.where(F.col("_rank") <= F.col("_left")).select(*keys, row_id)


def bucket_count(rows: DataFrame) -> int:
    """Ordered buckets of about BUCKET_ROWS rows each, and 32 at least."""
    return max(32, -(-rows.count() // BUCKET_ROWS))


def running_totals(rows: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str],
                   descending: bool = True, buckets: int | None = None) -> DataFrame:
    """Add `run_<c>`, the sum of c up to and including this row, and `all_<c>`, the sum over the keys.

    `rows` must hold each (keys, order) once, so the quantile edges of its group give even buckets and the
    largest window holds about 1/buckets of a group.  The rows are read three times, so they are written out
    first: they are the counts of much larger data.  What is broadcast is decided by counting the groups: the planner's
    size of written rows is that of what they were made from, which may be a few numbers.
    """
    keys = list(keys)
    rows = cut_lineage(rows)
    buckets = buckets or bucket_count(rows)
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(order, shares, F.lit(max(1000, 10 * buckets))).alias("_edges"))
    few = True  # one row without keys
    if keys:
        cuts = cut_lineage(cuts)
        few = cuts.count() * buckets <= SHIPPED_EDGES
    small = F.broadcast if few else lambda table: table.hint("merge")
    met = rows.join(small(cuts), keys) if keys else rows.join(small(cuts), F.lit(True))
    placed = met.withColumn("_bucket", F.size(F.filter("_edges", lambda e: e < F.col(order)))).drop("_edges")
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    within = Window.partitionBy(*keys, "_bucket").orderBy(direction(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # At most `buckets` rows per group from here to the join.
    totals = placed.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    every = Window.partitionBy(*keys)
    earlier = every.orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(every).alias(f"all_{c}") for c in sums])
    local = placed.withColumns({f"_run_{c}": F.sum(c).over(within) for c in sums})
    joined = local.join(small(offsets), [*keys, "_bucket"])
    return joined.withColumns({f"run_{c}": F.col(f"_run_{c}") + F.col(f"_off_{c}") for c in sums}).drop(
        "_bucket", *[f"_run_{c}" for c in sums], *[f"_off_{c}" for c in sums])
