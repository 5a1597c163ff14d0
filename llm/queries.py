"""The registered queries of this package: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import (collocations, decontaminate, html_extraction, jaccard_join, language_model, license_scan, line_dedup, merkle, packing,
                 quality_classifier, quality_rules, toxicity, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Rules and vocabulary over the urls of all pages."""
    return url_filter.filter_urls(table(spark, folder, "pages"))


ORACLE["op1_url_filter"] = url_filter.oracle_sql()


@query
def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.near_duplicates(table(spark, folder, "documents"))


FOLDED = f"translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}')"

ORACLE["op2_jaccard_join"] = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
link AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
      JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, (SELECT min(b) FROM reach WHERE a = w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id"""


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and the likelihood ratio of all documents; documents labelled as of quality are the target."""
    return quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents; the fold 0 of 5 is held out."""
    scored = toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "evidence", F.size("passages").alias("n_passages"))


@query
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that an earlier place holds, the same or (from 20 words on) one word apart."""
    out = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return out.select("doc_id", F.size("removed").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
                      F.char_length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


@query
def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    return html_extraction.extract(table(spark, folder, "pages"))


@query
def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents; the fold 1 of 3 is held out."""
    return quality_classifier.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and templates in all documents."""
    return license_scan.scan(table(spark, folder, "documents"))


@query
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in all documents."""
    return decontaminate.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLE["op10_decontamination"] = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
v AS (SELECT item_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
known AS MATERIALIZED (SELECT DISTINCT item_id, size, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') AS g
          FROM (SELECT item_id, w, least({decontaminate.WINDOW}, len(w)) AS size, unnest(range(1, len(w) - least({decontaminate.WINDOW}, len(w)) + 2)) AS i FROM v WHERE len(w) > 0)),
seen AS (SELECT doc_id, size, i, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') AS g
         FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT DISTINCT size FROM known) WHERE len(w) >= size)),
hit AS MATERIALIZED (SELECT doc_id, item_id, size, i FROM seen JOIN known USING (size, g)),
marked AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM w LEFT JOIN marked ON marked.doc_id = w.doc_id LEFT JOIN items ON items.doc_id = w.doc_id"""


@query
def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first phrases of each language in all documents."""
    return collocations.collocations(table(spark, folder, "documents"))


ORACLE["op11_phrase_collocations"] = collocations.oracle_sql()


@query
def op12_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of all documents; the fold 1 of 5 does not teach."""
    return language_model.scored(table(spark, folder, "documents"))


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots, proof and verification of all documents."""
    return merkle.verify(merkle.proofs(table(spark, folder, "documents")))


ORACLE["op13_merkle_manifest"] = merkle.oracle_sql()
