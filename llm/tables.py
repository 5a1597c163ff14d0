"""Small helpers for joins: documents meet a table by id without a sort of their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEACH_ROWS = 1_000_000  # labelled rows that teach, about; 16 MB
SPAN = 1 << 30


def join_labels(docs: DataFrame, labels: DataFrame, value: str, how: str = "inner", limit: int = TEACH_ROWS) -> DataFrame:
    """`docs` (doc_id, ...) with the label `value` of its doc_id.

    One label for each id: the larger where labels are repeated, and null labels or ids are dropped.
    About `limit` labels teach at most: of n labels those whose id hashes into the first limit / n of all
    hashes, so which ones does not depend on order or partitions, and all of them up to `limit`.  They are
    broadcast at every size, and no text is shuffled for a label.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull()).select("doc_id", F.col(value).cast("int").alias("label"))
    share = int(SPAN * min(1.0, limit / max(1, known.count())))
    one = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(SPAN)) < share).groupBy("doc_id").agg(F.max("label").alias("label"))
    return docs.join(F.broadcast(one), "doc_id", how)


def id_blocks(rows: DataFrame, block: int = TEACH_ROWS) -> list[DataFrame]:
    """The different doc_ids of `rows`, all of them, in one or more tables of about `block` ids by hash, each fit to be broadcast."""
    ids = rows.where("doc_id IS NOT NULL").select("doc_id").distinct()
    blocks = max(1, -(-ids.count() // block))
    return [ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == k) for k in range(blocks)]


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
