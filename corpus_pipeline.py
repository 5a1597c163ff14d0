"""A corpus pipeline of five stages; each works on all that the one before kept, written and read again.

1. toxicity: documents that the segment scorer calls toxic go;
2. line dedup: lines that an earlier place holds, the same or one word apart, go; so do documents of which
   no word remains (those empty before stay);
3. Jaccard join: of each near-duplicate group the smallest doc_id stays;
4. decontamination: documents of which benchmark windows cover a twentieth or more go;
5. packing: pieces of sequences of 1024 tokens.

All but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from llm.queries import table


def as_one(docs: DataFrame) -> DataFrame:
    """doc_id, text and the rest of the row as one column, so that no name of an extra column can clash."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row"))


def as_rows(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` again, from text and _row."""
    return rows.select(*(F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    scored = toxicity.score_documents(as_one(docs), table(spark, folder, "labels"), keep=("text", "_row"))
    return as_rows(scored.where("predicted = 0"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    left = line_dedup.dedup_lines(as_one(docs)).where("size(removed) = 0 OR text rlike '[^\\\\x09-\\\\x0D\\\\x20]'")
    size = F.when(F.size("removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("_row.n_chars"))
    return as_rows(left.withColumn("_row", F.col("_row").withField("n_chars", size)), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows go by doc_id and text, as another row of that doc_id may hold a text of its own.

    Documents without words are in no group and stay; of rows that repeat a kept doc_id in its group all stay.
    """
    own = F.xxhash64("text").alias("text_hash")
    found = jaccard_join.near_duplicates(docs.select("doc_id", "text", own), keep=("text_hash",))
    copies = found.where("component_id <> doc_id").select("doc_id", "text_hash").distinct()
    rows = as_one(docs).select("*", own)
    return as_rows(rows.join(copies.hint("shuffle_hash"), ["doc_id", "text_hash"], "left_anti"), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    judged = decontaminate.decontaminate(as_one(docs), table(spark, folder, "benchmark"), keep=("text", "_row"))
    return as_rows(judged.where("NOT contaminated"), docs)


def pack_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_documents),
]

ORACLE_SQL = None  # trained scores, set joins and token ids are not SQL; tests hold each stage against brute force


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of this run, wherever the shared folder lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared checkpoint folder, and goes once the next is written."""
    from codewarden.session import shared_folder

    docs, base, last = table(spark, folder, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
