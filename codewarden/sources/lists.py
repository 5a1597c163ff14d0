"""Files that hold one JSON list each, of any size, read by as many tasks as they have blocks.

A file is read as pieces between closing braces, which Spark's text reader finds in any block of it.  Whether a
piece begins inside a string, and how many brackets are open there, are running totals over the pieces of a file:
of quotes (escapes taken out) and of brackets outside strings.  They are taken in two levels, stretches of pieces
and pieces, over rows without text.  A piece after which one bracket is open ends an item, and the pieces up to
there form a part: the object that ends it, and any items before it that hold no object.  Parts are parsed alone.

A file counts only as a whole: one that is no list, or has a part that is no JSON, is bad and gives no rows.
Nulls and empty lists: an item `null` is a row, `[]` gives none.  An item lies in one task, whatever its size, and so
does a run of items that hold no object.  Text is shuffled twice and written once below the shared folder.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codewarden.session import cut_lineage

STRETCH = 10_000
END = "end of the part"  # parsed last, so a part that closes the list too early is seen
BLANKS = " \t\r\n"


def numbered_pieces(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """(path, file_name, line_index, line): lines, or what lies between separators, by their number in the file from 0.

    Lines are numbered inside each file split, splits by their start in the file; so the count per
    split is all that is gathered, and nothing is sorted.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("line"),
        F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("path", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lines.join(splits, ["path", "_start"]).select(
        "path", "file_name", (F.col("_base") + F.col("_id") - F.col("_first")).alias("line_index"), "line")


def total_before(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """Add `name`: the sum of `value` over the rows of the same path that come before by `order`."""
    spread = rows.withColumns({"_stretch": F.floor(F.col(order) / STRETCH), "_value": value})
    earlier = Window.partitionBy("path").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = spread.groupBy("path", "_stretch").agg(F.sum("_value").alias("_sum")).select(
        "path", "_stretch", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    above = Window.partitionBy("path", "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_value").over(above), F.lit(0))
    return spread.withColumn("_inside", inside).join(bases, ["path", "_stretch"]).withColumn(
        name, F.col("_carried") + F.col("_inside")).drop("_stretch", "_value", "_inside", "_carried")


def _count(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


def _opened(text: Column) -> Column:
    """Brackets opened less brackets closed outside strings; the text holds no escapes."""
    bare = F.regexp_replace(text, r'"[^"]*("|$)', "")
    return _count(bare, "[{") - _count(bare, "]}")


def _parts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, file_name, part, text): text between the ends of items, the closing brace of the last one left out."""
    pieces = numbered_pieces(spark, path, "}")
    plain = F.regexp_replace("line", r"(?s)\\.", "")
    marks = cut_lineage(pieces.select(
        "path", "line_index", _count(plain, '"').alias("quotes"), _opened(plain).alias("from_outside"),
        _opened(F.concat(F.lit('"'), plain)).alias("from_inside")))
    marks = total_before(marks, "line_index", F.col("quotes"), "_quotes")
    closes = ((F.col("_quotes") + F.col("quotes")) % 2 == 0).cast("int")
    step = F.when(F.col("_quotes") % 2 == 0, F.col("from_outside")).otherwise(F.col("from_inside")) - closes
    marks = marks.select("path", "line_index", closes.alias("closes"), step.alias("step"))
    marks = total_before(marks, "line_index", F.col("step"), "_depth")
    ends = (F.col("closes") == 1) & (F.col("_depth") + F.col("step") == 1)
    marks = total_before(marks, "line_index", ends.cast("int"), "part").select("path", "line_index", "part")
    ordered = F.array_sort(F.collect_list(F.struct("line_index", "line")))
    return pieces.join(marks, ["path", "line_index"]).groupBy("path", "file_name", "part").agg(
        F.array_join(F.transform(ordered, lambda piece: piece["line"]), "}").alias("text"))


def _parsed(parts: DataFrame) -> DataFrame:
    """(path, file_name, part, items, good): the items of each part; `good` says that it is a proper part of a list."""
    last = parts.groupBy("path").agg(F.max("part").alias("_last"))
    first, tail = F.col("part") == 0, F.col("part") == F.col("_last")
    text = F.btrim("text", F.lit(BLANKS))
    whole = F.when(tail, F.regexp_replace(text, r"\]$", "")).otherwise(F.concat(text, F.lit("}")))
    opener = F.when(first, F.lit("[")).otherwise(F.lit(","))
    body = F.when(F.startswith("_whole", opener), F.expr("substring(_whole, 2)")).otherwise(F.col("_whole"))
    closed = ~F.col("_tail") | F.endswith("text", F.lit("]"))
    empty = F.col("_tail") & F.when(first, F.btrim("_body", F.lit(BLANKS)) == "").otherwise(F.col("_whole") == "")
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), "_body", F.lit(f',"{END}"]'))), "$", "array<variant>")
    proper = F.startswith("_whole", opener) & F.coalesce(
        F.try_variant_get(F.element_at("_items", -1), "$", "string") == END, F.lit(False))
    return parts.join(last, "path").select("path", "file_name", "part", text.alias("text"), tail.alias("_tail"), whole.alias("_whole")).withColumn(
        "_body", body).withColumn("_items", items).withColumn("_empty", empty & F.startswith("_whole", F.when(first, "[").otherwise(""))).select(
        "path", "file_name", "part", (closed & (F.col("_empty") | proper)).alias("good"),
        F.when(~F.col("_empty"), F.slice("_items", 1, F.greatest(F.size("_items") - 1, F.lit(0)))).alias("items"))


def list_items(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """(file_name, row_index, record): the items of every list file; a bad file gives none, or stops the job if `strict`."""
    parsed = cut_lineage(_parsed(_parts(spark, path)))
    files = parsed.groupBy("path").agg(F.bool_and("good").alias("_good"), F.max("file_name").alias("_name"))
    if strict and (wrong := files.where("NOT _good").first()):
        raise ValueError(f"no JSON list: {wrong['_name']}")
    sizes = parsed.select("path", "part", F.greatest(F.size("items"), F.lit(0)).alias("size"))
    starts = total_before(sizes, "part", F.col("size"), "_base").select("path", "part", "_base")
    kept = parsed.join(files.where("_good").select("path"), "path").join(starts, ["path", "part"])
    return kept.select("file_name", "_base", F.posexplode("items").alias("_pos", "record")).select(
        "file_name", (F.col("_base") + F.col("_pos")).alias("row_index"), "record")
