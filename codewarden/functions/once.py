"""Compute an expression once.

The optimizer copies an expression into every place that mentions its column: into filters pushed
below its definition and into other expressions.  That is free for cheap ones; for a parsed record or
a split text it repeats the work of the whole row.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pin(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns computed once per row; filters on them stay above their definition."""
    values = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in rows.columns if c not in columns]
    return rows.withColumn("_pin", F.explode(F.array(values))).select(*kept, "_pin.*")
