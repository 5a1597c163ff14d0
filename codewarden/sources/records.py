"""Loose JSON inputs and JSON Lines output."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codewarden.functions.once import pin
from codewarden.sources.lists import list_items, numbered_pieces

LINES, ARRAY = "lines", "array"


def read_jsonl(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): records as (file_name, line, record VARIANT) and lines that are no JSON.

    Blank lines vanish.  Both sides are lazy views of one text scan.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("line"))
    parsed = pin(lines.where(F.trim("line") != ""), {"record": F.try_parse_json("line")})
    return parsed.where(F.col("record").isNotNull()), parsed.where(F.col("record").isNull()).drop("record")


def read_typed_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON Lines with an explicit schema; a malformed line is kept in `_corrupt_record`."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_json_array(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_name, row_index, record): the items of files that hold one JSON list each.

    A file that is no list fails here; `read_kb_folder` skips such files.
    """
    return list_items(spark, path, strict=True)


def read_tree(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """All matching files below a folder, as (file_path, line)."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("line")).where(F.trim("line") != "")


def read_lines_numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_name, line_index, line) with the physical line number from 0, blank lines counted."""
    return numbered_pieces(spark, path).select("file_name", "line_index", "line")


def number_records(lines: DataFrame, parsed: Column) -> DataFrame:
    """Add `row_index`: the place among the lines of the same file that parse.

    Two levels: counts per stretch of lines, then ranks inside a stretch, so a huge file is not
    ranked by one task.
    """
    good = pin(lines, {"record": parsed}).where(F.col("record").isNotNull()).withColumn(
        "_stretch", F.floor(F.col("line_index") / 100_000))
    counts = good.groupBy("file_name", "_stretch").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file_name").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = Window.partitionBy("file_name", "_stretch").orderBy("line_index")
    return good.withColumn("_rank", F.row_number().over(rank) - 1).join(bases, ["file_name", "_stretch"]).withColumn(
        "row_index", F.col("_base") + F.col("_rank")).drop("_stretch", "_rank", "_base")


def file_kinds(spark: SparkSession, patterns: list[str]) -> dict[str, str]:
    """Kind of every matching file: one whose first visible character is `[` is a list, else lines.

    Opens each file for a few bytes, next to the listing any read makes; no data is scanned.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    kinds = {}
    for pattern in patterns:
        path = hadoop.Path(pattern)
        files = path.getFileSystem(conf)
        for status in files.globStatus(path) or []:
            stream = files.open(status.getPath())
            mark = stream.read()
            while mark in (9, 10, 11, 12, 13, 32):
                mark = stream.read()
            stream.close()
            kinds[status.getPath().toString()] = ARRAY if mark == ord("[") else LINES
    return kinds


def read_kb_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, row_index, record) from every *.json and *.jsonl file of one folder.

    A malformed list gives no rows.
    """
    kinds = file_kinds(spark, [f"{folder}/*.json", f"{folder}/*.jsonl"])
    arrays = [path for path, kind in kinds.items() if kind == ARRAY]
    lines = [path for path, kind in kinds.items() if kind == LINES]
    parts = []
    if arrays:
        parts.append(list_items(spark, arrays))
    if lines:
        numbered = number_records(read_lines_numbered(spark, lines), F.try_parse_json("line"))
        parts.append(numbered.select("file_name", F.col("row_index").cast("bigint"), "record"))
    if not parts:
        return spark.createDataFrame([], "file_name string, row_index bigint, record variant")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, nulls kept, text unescaped; a folder of part files."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)
