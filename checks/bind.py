"""Logical tables over the given ones.  One text serves Spark and the checking engine."""

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

ROW_ID = ("concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), "
          "CAST(l_suppkey AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING))")

SAMPLES = """
SELECT d.doc_id AS id, d.text AS func, d.source AS project, d.lang AS cwe, CAST(l.toxic AS BIGINT) AS target
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""

EVERY_SAMPLE = SAMPLES.replace(" JOIN {labels}", " LEFT JOIN {labels}")

SCORED = f"""
SELECT {ROW_ID} AS id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
       CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS raw_pred, l_discount AS score,
       l_extendedprice / 110000 AS fine_score, p_brand AS grp, l_tax AS tax
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey"""

TASKS = """
SELECT o_orderkey AS id,
       concat('split', substr(o_orderpriority, 1, 1), '_', CAST(o_custkey AS STRING), '_', CAST(o_orderkey AS STRING)) AS name,
       concat('split', substr(o_orderpriority, 1, 1)) AS split,
       CASE o_orderstatus WHEN 'F' THEN 'Success' WHEN 'O' THEN 'Failed' ELSE 'Pending' END AS status,
       CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS ground_truth_label,
       CASE WHEN o_custkey % 5 = 0 THEN 'N/A' WHEN o_custkey % 5 = 1 THEN NULL
            ELSE concat('CWE-', CAST(o_custkey % 20 AS STRING)) END AS cwe_id
FROM {orders}"""

RESULTS = """
SELECT l_orderkey AS vuln_id,
       CASE WHEN max(l_quantity) > 40 THEN 'VULNERABLE' ELSE 'BENIGN' END AS final_decision,
       CASE WHEN min(l_linenumber) = 7 THEN NULL ELSE round(max(l_extendedprice) / 110000, 6) END AS calibrated_confidence,
       CASE WHEN max(l_linenumber) = 1 THEN NULL ELSE round(min(l_discount) * 10, 2) END AS native_confidence,
       max(l_tax) > 0.05 AS static_has_flow, count(*) AS static_complexity,
       CASE WHEN min(l_linenumber) > 3 THEN NULL ELSE CAST(max(l_linenumber) AS BIGINT) END AS feat_static_apis_count,
       round(max(l_tax), 2) AS feat_static_risk_density, round(min(l_tax), 2) AS feat_static_graph_density,
       min(l_linenumber) % 3 AS feat_static_source_type, CAST(max(l_quantity) * 300 AS BIGINT) AS feat_code_len,
       max(l_quantity) > 48 AS feat_is_compressed, round(min(l_discount), 2) AS feature_rag_similarity,
       round(max(l_extendedprice) / 110000, 6) AS feat_rag_top1_sim, round(max(l_discount), 2) AS feat_rag_sim_variance,
       CAST(min(l_linenumber) % 3 AS DOUBLE) AS feat_conflict_disagreement,
       CASE WHEN max(l_tax) > 0.05 AND max(l_quantity) <= 40 THEN 1 ELSE 0 END AS feat_conflict_static_yes_llm_no,
       round(min(l_quantity) / 50, 2) AS feat_llm_uncertainty
FROM {lineitem} GROUP BY l_orderkey"""

KB = """
SELECT d.doc_id, concat('kb_', CAST(d.doc_id AS STRING)) AS original_id, d.text AS code,
       CASE WHEN e.label % 2 = 1 THEN 'VULNERABLE' ELSE 'BENIGN' END AS label,
       CASE WHEN e.label = 0 THEN NULL ELSE d.source END AS cwe_id, e.embedding AS vec
FROM {documents} d LEFT JOIN {embeddings} e ON d.doc_id = e.vec_id"""

HITS = """
SELECT conv_id AS qid, CAST(turn + 1 AS INT) AS rank, concat('kb_', CAST(conv_id AS STRING), '_', CAST(turn AS STRING)) AS original_id,
       CASE WHEN role = 'assistant' THEN 'VULNERABLE' ELSE 'BENIGN' END AS label,
       CAST((length(text) * 7 + turn) % 1000 AS DOUBLE) / 1000 AS similarity
FROM {conversations}"""

DOC_TASKS = """
SELECT doc_id AS id, concat('docs_', CAST(doc_id AS STRING)) AS name, text AS code FROM {documents}"""

# Braces are written as chr(123) and chr(125): plain ones would be read as table names.
CACHE = """
SELECT concat('docs_', CAST(doc_id AS STRING)) AS task_name, CAST(quality + toxic AS INT) AS source_type,
       CASE WHEN doc_id % 9 = 0 THEN NULL
            ELSE concat(chr(123), '"has_flow":', CASE WHEN toxic = 1 THEN 'true' WHEN doc_id % 2 = 0 THEN 'null' ELSE 'false' END,
                        ',"complexity":', CASE WHEN doc_id % 7 = 0 THEN 'null' ELSE CAST(doc_id % 40 AS STRING) END,
                        ',"apis":', CASE WHEN doc_id % 5 = 0 THEN 'null' WHEN doc_id % 5 = 1 THEN '[]'
                                         ELSE '["open","read"]' END, chr(125)) END AS feature_json
FROM {labels}"""

RESPONSES = """
SELECT doc_id AS task_id, 1 AS round, lang, doc_id % 7 AS a, n_chars % 5 AS b,
  CASE doc_id % 10
    WHEN 3 THEN concat('no json: ', lang)
    WHEN 2 THEN concat(chr(123), '"thought_process":"', lang, '","confidence":0.9', chr(125))
    WHEN 4 THEN concat(chr(123), '"thought_process":"', lang, '","final_decision":"VULNERABLE","confidence":0.9,"static_analysis_review":"MAYBE"', chr(125))
    WHEN 6 THEN concat(chr(123), '"thought_process":"', lang, '","final_decision":"VULNERABLE","confidence":null', chr(125))
    WHEN 9 THEN concat(chr(123), '"thought_process":"', lang, '","final_decision":"MAYBE","confidence":0.9', chr(125))
    WHEN 0 THEN concat(chr(123), '"thought_process":"', lang, '","static_analysis_review":"DISAGREE_LOGIC_FOUND","evidence":', chr(123),
      '"a":true,"b":"TRUE","c":1,"d":null,"e":1.5,"f":"no","g":"true","h":[1],"i":0', chr(125), ',"final_decision":"VULNERABLE","confidence":85,"cwe_id":"CWE-1"', chr(125))
    WHEN 1 THEN concat(chr(123), '"thought_process":"', lang, '","final_decision":"BENIGN","confidence":"0.4","evidence":[]', chr(125))
    WHEN 5 THEN concat(chr(123), '"thought_process":"', lang, '","final_decision":"VULNERABLE","confidence":-0.2,"evidence":null,"cwe_id":"', source, '"', chr(125))
    WHEN 7 THEN concat(chr(123), '"thought_process":"', lang, '","final_decision":"VULNERABLE","confidence":1,"evidence":', chr(123),
      '"a":1,"b":1,"c":1,"d":0,"e":1,"f":"false"', chr(125), chr(125))
    ELSE concat(chr(123), '"thought_process":"', lang, '","final_decision":"VULNERABLE","confidence":250,"cwe_id":null,"static_analysis_review":"AGREE"', chr(125)) END AS content
FROM {documents} WHERE lang <> 'es'
UNION ALL
SELECT doc_id, 2, lang, doc_id % 5, 1,
  CASE WHEN doc_id % 4 = 0 THEN concat(chr(123), '"thought_process":"again","final_decision":"VULNERABLE","confidence":0.8,"cwe_id":"CWE-2"', chr(125))
       ELSE concat(chr(123), '"thought_process":"again","final_decision":"BENIGN","confidence":0.3', chr(125)) END
FROM {documents} WHERE lang <> 'fr'"""


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A given table.  Text tables are spread by their key, as heavy work follows for each row."""
    rows = spark.read.parquet(f"{folder}/{table}.parquet")
    return rows.repartition(TEXT_KEYS[table]) if table in TEXT_KEYS else rows


def _used(text: str) -> list[str]:
    return sorted({t for t in re.findall(r"\{(\w+)\}", text) if t in TABLES})


def bind(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """The logical table in Spark."""
    return spark.sql(text, **{t: load(spark, folder, t) for t in _used(text)})


def sql(text: str) -> str:
    """The same text for the checking engine."""
    for t in _used(text):
        text = text.replace("{" + t + "}", t)
    return text.replace("AS STRING)", "AS VARCHAR)")


class Registry:
    """Collects queries and their SQL."""

    def __init__(self):
        self.queries, self.oracle = {}, {}

    def add(self, name: str, oracle: str | None = None):
        def keep(fn):
            if name in self.queries:
                raise ValueError(name)
            self.queries[name] = fn
            if oracle is not None:
                self.oracle[name] = oracle
            return fn
        return keep
