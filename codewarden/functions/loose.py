"""Loosely typed JSON fields, read from a VARIANT column.

`unpack` looks each field up once; the other functions work on what it leaves.  A missing key gives
a NULL kind, a JSON null the kind VOID: the two differ in several importers.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.functions.once import pin
from codewarden.functions.text import strip


def unpack(records: DataFrame, record: str, *names: str) -> DataFrame:
    """Add one struct per field: its kind, its text and, for a list, the first item's text."""
    r = F.col(record)

    def parts(name: str) -> Column:
        return F.struct(
            F.schema_of_variant(F.try_variant_get(r, f"$.{name}", "variant")).alias("kind"),
            F.try_variant_get(r, f"$.{name}", "string").alias("text"),
            F.try_variant_get(r, f"$.{name}[0]", "string").alias("first"))

    return pin(records, {f"_f_{name}": parts(name) for name in names})


def kind(name: str) -> Column:
    return F.col(f"_f_{name}.kind")


def text(name: str) -> Column:
    """The field as text; arrays and objects as their JSON."""
    return F.col(f"_f_{name}.text")


def first_item(name: str) -> Column:
    return F.col(f"_f_{name}.first")


def missing(name: str) -> Column:
    return kind(name).isNull()


def is_list(name: str) -> Column:
    return F.coalesce(F.startswith(kind(name), F.lit("ARRAY")), F.lit(False))


def truthy(name: str) -> Column:
    """Filled in the scripting sense: not missing, null, false, zero, or empty."""
    value, shape = text(name), kind(name)
    return (
        F.when(missing(name) | (shape == "VOID"), F.lit(False))
        .when(shape == "BOOLEAN", value == "true")
        .when(shape == "STRING", value != "")
        .when(is_list(name), value != "[]")
        .when(F.startswith(shape, F.lit("OBJECT")), value != "{}")
        .otherwise(F.coalesce(value.try_cast("double") != 0.0, F.lit(True)))
    )


def truthy_text(*names: str) -> Column:
    """Text of the first filled field."""
    return F.coalesce(*[F.when(truthy(n), text(n)) for n in names])


def whole_number(name: str) -> Column:
    """Integer value; NULL for a missing key, a JSON null and anything that is no number."""
    value, shape = text(name), kind(name)
    return (
        F.when(shape == "BOOLEAN", (value == "true").cast("bigint"))
        .when(shape == "STRING", strip(value).try_cast("bigint"))
        .when(F.startswith(shape, F.lit("DECIMAL")) | shape.isin("DOUBLE", "FLOAT"),
              value.try_cast("double").try_cast("bigint"))
        .when(shape.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), value.try_cast("bigint"))
    )


def whole_number_or_zero_if_missing(name: str) -> Column:
    """Missing key is 0, a null or unreadable value stays NULL so that the row can be rejected."""
    return F.when(missing(name), F.lit(0).cast("bigint")).otherwise(whole_number(name))


def flag_label(name: str) -> Column:
    """0/1 label: text counts as 1 only as `1`, `true` or `True`; numbers keep their value."""
    from_text = strip(text(name)).isin("1", "true", "True").cast("bigint")
    return F.when(kind(name) == "STRING", from_text).otherwise(whole_number_or_zero_if_missing(name))


def scalar_or_first(name: str) -> Column:
    return F.when(is_list(name), first_item(name)).otherwise(text(name))
