"""Normalising, importing, splitting and sampling."""

import uuid

from pyspark.sql import functions as F

from checks import bind as B
from codewarden.functions import text as T
from codewarden.functions.once import pin
from codewarden.operators import normalize as N
from codewarden.operators import sampling as G
from codewarden.operators.ordering import seeded_hash
from codewarden.session import shared_folder
from codewarden.sources import records
from codewarden.sources.store import stored_threshold
from codewarden.sources.tool_results import map_tool_results

R = B.Registry()
S = B.sql(B.SAMPLES)


A = B.sql(B.EVERY_SAMPLE)  # with the documents that have no label


def every_sample(spark, folder):
    return B.bind(spark, folder, B.EVERY_SAMPLE)


def samples(spark, folder):
    return B.bind(spark, folder, B.SAMPLES)


def with_json(rows, base: dict, fragments: str):
    """Raw JSON text from columns plus loosely typed fragments, parsed as a reader would."""
    head = F.to_json(F.struct(*[F.expr(e).alias(n) for n, e in base.items()]))
    body = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.expr(fragments), F.lit("}"))
    return pin(rows, {"record": F.parse_json(body)})


# --- record normalisation ---------------------------------------------------------------------

DIVERSE_FRAGMENTS = """concat(
  CASE WHEN id % 6 = 4 THEN ',"target":null' WHEN target IS NULL THEN '' WHEN id % 6 = 0 THEN concat(',"target":', target)
    WHEN id % 6 = 1 THEN concat(',"target":"', target, '"') WHEN id % 6 = 2 THEN concat(',"target":', CASE WHEN target = 1 THEN 'true' ELSE 'false' END)
    WHEN id % 6 = 3 THEN CASE WHEN target = 1 THEN ',"target":" True "' ELSE ',"target":"yes"' END ELSE '' END,
  CASE id % 5 WHEN 0 THEN concat(',"cwe":["', cwe, '","x"]') WHEN 1 THEN concat(',"cwe":"', cwe, '"')
    WHEN 2 THEN ',"cwe":null' WHEN 3 THEN ',"cwe":[]' ELSE '' END,
  CASE WHEN id % 4 = 0 THEN ',"project":null' ELSE concat(',"project":"', project, '"') END)"""


@R.add("p1_normalize_diversevul", f"""
SELECT id, md5(func) AS func_md5,
  CAST(CASE id % 6 WHEN 4 THEN NULL WHEN 5 THEN 0 ELSE coalesce(target, 0) END AS BIGINT) AS target,
  CASE id % 5 WHEN 0 THEN cwe WHEN 1 THEN cwe WHEN 3 THEN '[]' ELSE 'None' END AS cwe,
  CASE WHEN id % 4 = 0 THEN NULL ELSE project END AS project, CAST(id AS VARCHAR) AS commit_id,
  'diversevul' AS dataset, length(func) AS size
FROM ({A})""")
def p1(spark, folder):
    raw = with_json(every_sample(spark, folder), {"func": "func", "commit_id": "id", "size": "length(func)"}, DIVERSE_FRAGMENTS)
    return N.normalize_diversevul(raw.select("id", "record")).select(
        "id", F.md5("func").alias("func_md5"), "target", "cwe", "project", "commit_id", "dataset", "size")


VCL_FRAGMENTS = """concat(
  CASE WHEN target IS NULL THEN '' WHEN id % 3 = 0 THEN concat(',"label":', target) WHEN id % 3 = 1 THEN concat(',"label":" ', target, ' "') ELSE '' END,
  CASE id % 6 WHEN 0 THEN concat(',"cwe_id":', length(func)) WHEN 1 THEN concat(',"cwe_id":" ', length(func), ' "')
    WHEN 2 THEN ',"cwe_id":"Null"' WHEN 3 THEN concat(',"cwe_id":"CWE-', id, '"') WHEN 4 THEN ',"cwe_id":null' ELSE '' END)"""


@R.add("p2_normalize_vcl", f"""
SELECT id, md5(func) AS func_md5, CAST(CASE id % 3 WHEN 2 THEN 0 ELSE coalesce(target, 0) END AS BIGINT) AS target,
  CASE id % 6 WHEN 0 THEN 'CWE-' || length(func) WHEN 1 THEN 'CWE-' || length(func) WHEN 3 THEN 'CWE-' || id ELSE 'None' END AS cwe,
  'vcldata' AS dataset, project AS name
FROM ({A})""")
def p2(spark, folder):
    raw = with_json(every_sample(spark, folder), {"func": "func", "name": "project"}, VCL_FRAGMENTS)
    return N.normalize_vcl(raw.select("id", "record")).select(
        "id", F.md5("func").alias("func_md5"), "target", "cwe", "dataset", "name")


@R.add("p3_cwe_from_digits", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'CWE-' || n_chars WHEN 1 THEN 'CWE-' || n_chars WHEN 2 THEN 'None' ELSE lang END AS cwe
FROM documents""")
def p3(spark, folder):
    raw = F.expr("""CASE doc_id % 4 WHEN 0 THEN CAST(n_chars AS STRING) WHEN 1 THEN concat('  ', n_chars, '\\t')
                    WHEN 2 THEN CASE WHEN doc_id % 8 = 2 THEN NULL ELSE ' NULL ' END ELSE concat(lang, '\\n') END""")
    return B.load(spark, folder, "documents").select("doc_id", T.cwe_from_digits(raw).alias("cwe"))


@R.add("p4_cwe_upper", """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN upper(source) WHEN 1 THEN upper(source) WHEN 2 THEN upper(source) ELSE 'N/A' END AS cwe
FROM documents""")
def p4(spark, folder):
    raw = F.expr("""CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN concat("['", source, "']") WHEN 2 THEN concat(' ["', source, '"] ')
                    WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'none' ELSE 'Null' END
                    ELSE CASE WHEN doc_id % 2 = 0 THEN NULL ELSE '' END END""")
    return B.load(spark, folder, "documents").select("doc_id", T.cwe_upper(raw).alias("cwe"))


@R.add("p5_commit_id_from_link", """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'c' || page_id
  WHEN 1 THEN list_extract(string_split(url, '/'), -1) ELSE 'unknown' END AS commit_id
FROM pages""")
def p5(spark, folder):
    link = F.expr("CASE page_id % 3 WHEN 0 THEN concat(url, '/commit/old/commit/c', page_id, '/x/y') WHEN 1 THEN url ELSE '' END")
    return B.load(spark, folder, "pages").select("page_id", T.commit_id_from_link(link).alias("commit_id"))


@R.add("p6_unpivot_fixes", """
WITH d AS (SELECT doc_id, text, source, lang FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'k' || doc_id ELSE 'unknown' END AS commit_id, md5(text) AS func_md5, CAST(1 AS BIGINT) AS target,
       upper(source) AS cwe, lang AS func_name, 'before' AS origin_source FROM d WHERE text <> ''
UNION ALL
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'k' || doc_id ELSE 'unknown' END, md5('fixed ' || text), CAST(0 AS BIGINT),
       upper(source), lang, 'after' FROM d WHERE doc_id % 3 > 0""")
def p6(spark, folder):
    docs = B.load(spark, folder, "documents")
    raw = with_json(docs, {
        "func_src_before": "text", "func_name": "lang",
        "func_src_after": "CASE doc_id % 3 WHEN 0 THEN '' ELSE concat('fixed ', text) END",
        "commit_link": "CASE WHEN doc_id % 2 = 0 THEN concat('https://h/o/r/commit/k', doc_id) ELSE '' END",
    }, """CASE WHEN doc_id % 2 = 0 THEN concat(',"vul_type":["', source, '"]') ELSE concat(',"vul_type":"', source, '"') END""")
    return N.unpivot_fixes(raw.select("doc_id", "record")).withColumn("func_md5", F.md5("func")).drop("func")


@R.add("p7_normalize_devign", f"""
SELECT id, CASE id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN NULL ELSE 'c' || id END AS commit_id, md5(func) AS code_md5,
  CAST(CASE id % 5 WHEN 4 THEN 0 ELSE coalesce(target, 0) END AS BIGINT) AS target, 'N/A' AS cwe, project
FROM ({A}) WHERE id % 7 > 0 AND id % 5 <> 3""")
def p7(spark, folder):
    raw = with_json(every_sample(spark, folder), {
        "func": "CASE WHEN id % 7 = 0 THEN '' ELSE func END", "project": "project",
    }, """concat(CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN ',"commit_id":null' ELSE concat(',"commit_id":"c', id, '"') END,
                 CASE WHEN id % 5 = 3 THEN ',"target":null' WHEN target IS NULL THEN '' WHEN id % 5 = 0 THEN concat(',"target":', target)
                   WHEN id % 5 = 1 THEN concat(',"target":"', target, '"') WHEN id % 5 = 2 THEN concat(',"target":', target, '.7') ELSE '' END)""")
    return N.normalize_devign(raw.select("id", "record")).withColumn("code_md5", F.md5("code")).drop("code")


@R.add("k2_import_tasks", f"""
SELECT 'val_' || CASE WHEN id % 4 = 0 THEN 'unk' ELSE 'c' || id END || '_' || id AS name,
  CASE WHEN id % 4 = 0 THEN 'unk' ELSE 'c' || id END AS commit_id, md5(func) AS code_md5,
  CAST(CASE WHEN id % 5 = 1 THEN 0 ELSE coalesce(target, 0) END AS BIGINT) AS ground_truth_label,
  CASE id % 6 WHEN 0 THEN cwe WHEN 1 THEN cwe WHEN 2 THEN project WHEN 3 THEN project ELSE 'N/A' END AS cwe_id,
  'Pending' AS status
FROM ({A}) WHERE id % 5 <> 2""")
def k2(spark, folder):
    tasks = N.import_tasks(task_records(spark, folder), "val")
    return tasks.select("name", "commit_id", F.md5("code").alias("code_md5"), "ground_truth_label", "cwe_id", "status")


def task_records(spark, folder):
    raw = with_json(every_sample(spark, folder), {
        "commit_id": "CASE WHEN id % 4 = 0 THEN '' ELSE concat('c', id) END",
        "func": "CASE WHEN id % 2 = 0 THEN func ELSE '' END", "code": "func",
    }, """concat(CASE WHEN id % 5 = 2 THEN ',"target":null' WHEN id % 5 = 1 OR target IS NULL THEN '' ELSE concat(',"target":', target) END,
                 CASE id % 6 WHEN 0 THEN concat(',"cwe":["', cwe, '"],"cwe_id":"no"') WHEN 1 THEN concat(',"cwe":"', cwe, '"')
                   WHEN 2 THEN concat(',"cwe":[],"cwe_id":"', project, '"') WHEN 3 THEN concat(',"cwe":"","cwe_id":["', project, '"]')
                   WHEN 4 THEN ',"cwe":null,"cwe_id":[]' ELSE '' END)""")
    return raw.withColumn("line_index", F.col("id"))


@R.add("k2_rejected_tasks", f"""
SELECT 'val_' || CASE WHEN id % 4 = 0 THEN 'unk' ELSE 'c' || id END || '_' || id AS name FROM ({A}) WHERE id % 5 = 2""")
def k2r(spark, folder):
    return N.import_with_rejects(task_records(spark, folder), "val")[1].select("name")


KB_FRAGMENTS = """concat(
  CASE doc_id % 5 WHEN 0 THEN concat(',"target":', doc_id % 3) WHEN 1 THEN concat(',"target":null,"label":" ', doc_id % 3, ' "')
    WHEN 2 THEN concat(',"vuln":', CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END) WHEN 3 THEN ',"target":"1.0","label":1' ELSE '' END,
  CASE doc_id % 7 WHEN 0 THEN concat(',"cwe_id":"', lang, '","cwe":"no"') WHEN 1 THEN concat(',"cwe":["', lang, '"]')
    WHEN 2 THEN ',"cwe_id":"NaN"' WHEN 3 THEN ',"cwe_id":[]' WHEN 4 THEN ',"cwe":"None"' ELSE '' END,
  CASE doc_id % 3 WHEN 0 THEN concat(',"commit_id":"', md5(CAST(doc_id AS STRING)), 'tail"') WHEN 1 THEN concat(',"id":', doc_id + 5) ELSE '' END)"""
KB_SQL = """
SELECT source || '.jsonl_' || doc_id || '_' || CASE doc_id % 3 WHEN 0 THEN md5(CAST(doc_id AS VARCHAR)) WHEN 1 THEN CAST(doc_id + 5 AS VARCHAR) ELSE 'unk' END AS original_id,
  md5(text) AS code_md5,
  CASE WHEN doc_id % 5 IN (0, 1) AND doc_id % 3 = 1 THEN 'VULNERABLE' WHEN doc_id % 5 = 2 AND doc_id % 2 = 0 THEN 'VULNERABLE' ELSE 'BENIGN' END AS label,
  CASE doc_id % 7 WHEN 0 THEN lang WHEN 1 THEN lang ELSE 'N/A' END AS cwe_id, source || '.jsonl' AS source_dataset,
  (doc_id % 5 IN (3, 4) OR text = '') AS skip, doc_id
FROM documents"""


def kb_records(spark, folder):
    docs = B.load(spark, folder, "documents")
    raw = with_json(docs, {"func": "CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END",
                           "code": "CASE WHEN doc_id % 4 = 1 THEN text ELSE '' END", "function": "text"}, KB_FRAGMENTS)
    return N.kb_candidates(raw.select("record", F.concat("source", F.lit(".jsonl")).alias("file_name"),
                                      F.col("doc_id").alias("row_index")))


@R.add("p10_p11_p12_kb_candidates", f"SELECT original_id, code_md5, label, cwe_id, source_dataset, skip FROM ({KB_SQL}) WHERE NOT skip")
def kb_cand(spark, folder):
    c = kb_records(spark, folder).where("NOT skip")
    return c.select("original_id", F.md5("code").alias("code_md5"), "label", "cwe_id", "source_dataset", "skip")


STORED_KEYS = """
SELECT concat(d.source, '.jsonl_', CAST(d.doc_id AS STRING), '_unk') AS original_id
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""
NEW_KB = f"""SELECT k.* FROM ({KB_SQL}) k WHERE NOT skip
  AND NOT EXISTS (SELECT 1 FROM ({B.sql(STORED_KEYS)}) s WHERE s.original_id = k.original_id)"""


@R.add("k3_j4_kb_import", f"SELECT original_id, code_md5, label FROM ({NEW_KB})")
def k3(spark, folder):
    new = N.kb_new_rows(kb_records(spark, folder), B.bind(spark, folder, STORED_KEYS))
    return new.select("original_id", F.md5("code").alias("code_md5"), "label")


@R.add("a9_kb_import_report", f"""
WITH per AS (SELECT source_dataset AS file, count(*) AS seen FROM ({KB_SQL}) GROUP BY 1),
     a AS (SELECT source_dataset AS file, count(*) AS added FROM ({NEW_KB}) GROUP BY 1),
     j AS (SELECT per.file, coalesce(added, 0) AS added, seen - coalesce(added, 0) AS skipped FROM per LEFT JOIN a ON per.file = a.file)
SELECT file, added, skipped FROM j
UNION ALL SELECT 'TOTAL', CAST(sum(added) AS BIGINT), CAST(sum(skipped) AS BIGINT) FROM j""")
def a9(spark, folder):
    candidates = kb_records(spark, folder)
    return N.kb_import_report(candidates, N.kb_new_rows(candidates, B.bind(spark, folder, STORED_KEYS)))


# --- small text keys and filters ---------------------------------------------------------------

@R.add("p8_task_name", "SELECT doc_id, 's_' || CASE WHEN doc_id % 3 = 0 THEN 'unk' ELSE source END || '_' || n_chars AS name FROM documents")
def p8(spark, folder):
    commit = F.expr("CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END")
    return B.load(spark, folder, "documents").select("doc_id", T.task_name(F.lit("s"), commit, F.col("n_chars")).alias("name"))


@R.add("q16_canonical_cwe", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'CWE-' || n_chars WHEN 1 THEN 'CWE-' || n_chars WHEN 2 THEN 'N/A' ELSE upper(lang) END AS cwe FROM documents""")
def canonical(spark, folder):
    raw = F.expr("""CASE doc_id % 4 WHEN 0 THEN CAST(n_chars AS STRING) WHEN 1 THEN concat('cwe-', n_chars)
                    WHEN 2 THEN ' null' ELSE lang END""")
    return B.load(spark, folder, "documents").select("doc_id", T.canonical_cwe(raw).alias("cwe"))


@R.add("p13_stable_ratio", """
SELECT doc_id, ('0x' || substr(md5(text), 1, 8))::BIGINT / 4294967296.0 AS ratio FROM documents""")
def p13(spark, folder):
    return B.load(spark, folder, "documents").select("doc_id", T.stable_ratio(F.col("text")).alias("ratio"))


@R.add("p14_content_md5", "SELECT doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS digest FROM documents")
def p14(spark, folder):
    padded = F.concat(F.lit(" \n\t"), F.col("text"), F.lit("\r\n "))
    return B.load(spark, folder, "documents").select("doc_id", T.content_md5(padded).alias("digest"))


@R.add("p15_drop_control_chars", "SELECT page_id, md5(html) AS digest, length(html) AS n FROM pages")
def p15(spark, folder):
    noisy = F.concat(F.lit("\x00\x07"), F.replace("html", F.lit("<"), F.lit("\x0b<\x1f")), F.lit("\x7f"))
    clean = T.drop_control_chars(noisy)
    return B.load(spark, folder, "pages").select("page_id", F.md5(clean).alias("digest"), F.length(clean).alias("n"))


@R.add("p40_words", """
SELECT doc_id, len(w) AS n, coalesce(list_extract(w, 1), 'void') AS first_word, md5(array_to_string(w, ' ')) AS digest
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)""")
def p40(spark, folder):
    docs = B.load(spark, folder, "documents").select("doc_id", T.words(F.col("text")).alias("w"), T.query_words(F.col("text")).alias("q"))
    return docs.select("doc_id", F.size("w").alias("n"), F.col("q")[0].alias("first_word"), F.md5(F.array_join("w", " ")).alias("digest"))


BLANKED = "(SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN ' \n\t ' WHEN doc_id % 10 = 1 THEN '' ELSE text END AS func, CASE WHEN doc_id % 20 = 1 THEN text ELSE ' ' END AS code FROM {documents})"


@R.add("f1_drop_blank_code", f"SELECT doc_id FROM {B.sql(BLANKED)} WHERE trim(CASE WHEN func <> '' THEN func ELSE code END, ' \n\t\r') <> ''")
def f1(spark, folder):
    return N.drop_blank_code(B.bind(spark, folder, f"SELECT * FROM {BLANKED}"), "func", "code").select("doc_id")


@R.add("f1_blank_code_report", f"""SELECT count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS dropped
FROM (SELECT trim(CASE WHEN func <> '' THEN func ELSE code END, ' \n\t\r') <> '' AS ok FROM {B.sql(BLANKED)})""")
def f1r(spark, folder):
    return N.blank_code_report(B.bind(spark, folder, f"SELECT * FROM {BLANKED}"), "func", "code")


@R.add("f2_a22_sample_report", f"SELECT project, target, count(*) AS n FROM ({S}) WHERE target IN (0, 1) GROUP BY ALL")
def f2(spark, folder):
    return G.sample_report(samples(spark, folder).where(F.col("target").isin(0, 1)), "project", "target")


@R.add("u1_union_sources", """
SELECT 'doc' AS kind, doc_id AS id, lang AS cwe, NULL AS role FROM documents
UNION ALL SELECT 'turn', conv_id, NULL, role FROM conversations""")
def u1(spark, folder):
    docs = B.load(spark, folder, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.col("lang").alias("cwe"))
    turns = B.load(spark, folder, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "role")
    return docs.unionByName(turns, allowMissingColumns=True)


TOOL_ROWS = """
SELECT concat('/work/src/', CAST(user_id AS STRING), CASE WHEN event_id % 11 = 0 THEN '.h' ELSE '.c' END) AS filename, event_id AS pos,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(floor(value) AS INT) END AS complexity,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type = 'purchase' END AS has_data_flow,
       CASE WHEN event_type = 'error' THEN 'failed' END AS error, event_type, props
FROM {events}"""


@R.add("s7_w6_tool_results", f"""
SELECT task_id, coalesce(arg_max(coalesce(complexity, 0), pos), 0) AS complexity, arg_max(coalesce(has_data_flow, false), pos) AS has_data_flow,
       arg_max(CASE WHEN event_type = 'view' THEN '' WHEN event_type < props THEN event_type || ',' || props ELSE props || ',' || event_type END, pos) AS apis
FROM (SELECT *, CAST(regexp_extract(filename, '(\\d+)\\.c$', 1) AS BIGINT) AS task_id FROM ({B.sql(TOOL_ROWS)}) WHERE error IS NULL AND filename LIKE '%.c')
GROUP BY task_id""")
def s7(spark, folder):
    rows = B.bind(spark, folder, TOOL_ROWS).withColumn(
        "apis", F.when(F.col("event_type") != "view", F.array("event_type", "props", "event_type")))
    return map_tool_results(rows).select("task_id", "complexity", "has_data_flow", F.array_join("apis", ",").alias("apis"))


@R.add("s8_stored_threshold", "SELECT coalesce(max(CASE WHEN l_returnflag = 'A' THEN l_discount END), 0.5) AS threshold FROM lineitem")
def s8(spark, folder):
    meta = B.load(spark, folder, "lineitem").select(F.expr("CASE WHEN l_returnflag = 'A' THEN l_discount END").alias("best_threshold"))
    return stored_threshold(meta)


# --- splits and samples ------------------------------------------------------------------------

CONV = "SELECT CASE WHEN conv_id % 6 = 0 THEN NULL ELSE CAST(conv_id AS STRING) END AS commit_id, conv_id, turn, text AS func FROM {conversations}"
RATIO = "('0x' || substr(md5(coalesce(commit_id, substr(func, 1, 128))), 1, 8))::BIGINT / 4294967296.0"


@R.add("g1_split_by_commit", f"SELECT conv_id, turn, CASE WHEN {RATIO} < 0.8 THEN 'train' ELSE 'test' END AS split FROM ({B.sql(CONV)})")
def g1(spark, folder):
    return G.split_by_commit(B.bind(spark, folder, CONV)).select("conv_id", "turn", "split")


@R.add("a3_split_leaks", f"""
SELECT count(*) AS commits, count(*) FILTER (WHERE sides > 1) AS leaks
FROM (SELECT commit_id, count(DISTINCT CASE WHEN {RATIO} < 0.8 THEN 1 ELSE 0 END) AS sides FROM ({B.sql(CONV)}) WHERE commit_id IS NOT NULL GROUP BY 1)""")
def a3(spark, folder):
    split = G.split_by_commit(B.bind(spark, folder, CONV))
    leaks = G.split_leaks(split).agg(F.count("*").alias("leaks"))
    return split.agg(F.count_distinct("commit_id").alias("commits")).join(leaks, F.lit(True))


@R.add("a1_stratum_sizes", f"SELECT cwe AS cwe_key, project AS project_key, count(*) AS n FROM ({S}) GROUP BY ALL")
def a1(spark, folder):
    return G.stratum_sizes(samples(spark, folder))


def quota_sql(pool: str, n: str) -> str:
    """Per stratum: n, total, quota, take."""
    return f"""(
  SELECT cwe_key, project_key, n, total, quota, CASE WHEN total <= target_n THEN n ELSE least(n, quota) END AS take, target_n FROM (
    SELECT *, greatest(0, q0 + sign(delta) * (abs(delta) // strata + CASE WHEN place < abs(delta) % strata THEN 1 ELSE 0 END)) AS quota FROM (
      SELECT *, count(*) OVER () AS strata,
        row_number() OVER (ORDER BY CASE WHEN delta > 0 THEN -n ELSE n END, md5(cwe_key || '|' || project_key)) - 1 AS place FROM (
        SELECT *, target_n - sum(q0) OVER () AS delta FROM (
          SELECT *, CAST(round_even(CAST(n AS DOUBLE) / total * target_n, 0) AS BIGINT) AS q0 FROM (
            SELECT *, sum(n) OVER () AS total, {n} AS target_n FROM (
              SELECT cwe AS cwe_key, project AS project_key, count(*) AS n FROM ({pool}) GROUP BY ALL)))))))"""


def sample_sql(pool: str, n: str, seed: str) -> str:
    """Ids of a stratified sample of the pool."""
    return f"""(
  WITH pool AS MATERIALIZED (SELECT *, md5('{seed}|' || id) AS h FROM ({pool})), quotas AS MATERIALIZED (SELECT * FROM {quota_sql(pool, n)}),
  ranked AS (SELECT pool.*, row_number() OVER (PARTITION BY cwe, project ORDER BY h, id) AS r FROM pool),
  first AS MATERIALIZED (SELECT ranked.* FROM ranked JOIN quotas ON cwe = cwe_key AND project = project_key WHERE r <= take),
  remaining AS (SELECT *, row_number() OVER (ORDER BY h, id) AS g FROM pool p WHERE NOT EXISTS (
    SELECT 1 FROM first f WHERE f.func = p.func AND f.cwe = p.cwe AND f.project = p.project AND f.target = p.target))
  SELECT id FROM (SELECT id, row_number() OVER (ORDER BY h, id) AS g FROM first) WHERE g <= (SELECT max(target_n) FROM quotas)
  UNION ALL
  SELECT id FROM remaining WHERE g <= (SELECT greatest(0, max(target_n) - sum(take)) FROM quotas))"""


CONTENT = ["func", "project", "cwe", "target"]
NEG = f"SELECT * FROM ({S}) WHERE target = 0"
POS = f"SELECT * FROM ({S}) WHERE target = 1"


@R.add("a2_w2_stratum_quotas", f"""
SELECT cwe_key, project_key, n, CAST(quota AS BIGINT) AS quota, CAST(take AS BIGINT) AS take FROM {quota_sql(S, '(SELECT count(*) // 3 FROM labels)')}""")
def a2(spark, folder):
    target = B.load(spark, folder, "labels").agg((F.floor(F.count("*") / 3)).cast("bigint").alias("target_n"))
    return G.stratum_quotas(G.stratum_sizes(samples(spark, folder)), target).select("cwe_key", "project_key", "n", "quota", "take")


@R.add("g2_w5_j12_stratified_sample", f"SELECT id FROM {sample_sql(S, '120', '42')}")
def g2(spark, folder):
    return G.stratified_sample(samples(spark, folder), 120, 42, "id", CONTENT).select("id")


def minus_sql(pool: str, ids: str) -> str:
    return f"""SELECT * FROM ({pool}) p WHERE NOT EXISTS (SELECT 1 FROM ({pool}) t JOIN {ids} i ON i.id = t.id
      WHERE t.func = p.func AND t.cwe = p.cwe AND t.project = p.project AND t.target = p.target)"""


@R.add("j7_exclude_by_content", f"SELECT id FROM ({minus_sql(S, sample_sql(S, '120', '42'))})")
def j7(spark, folder):
    rows = samples(spark, folder)
    taken = G.stratified_sample(rows, 120, 42, "id", CONTENT)
    return G.exclude_by_content(rows, taken, CONTENT).select("id")


TP, TN = sample_sql(POS, "20", "42-train"), sample_sql(NEG, "60", "42-train")


@R.add("g3_calibration_sets", f"""
SELECT id, 'train' AS part FROM {TP} UNION ALL SELECT id, 'train' FROM {TN}
UNION ALL SELECT id, 'val' FROM {sample_sql(minus_sql(POS, TP), '10', '42-val')}
UNION ALL SELECT id, 'val' FROM {sample_sql(minus_sql(NEG, TN), '40', '42-val')}""")
def g3(spark, folder):
    sizes = {"train_pos": 20, "train_neg": 60, "val_pos": 10, "val_neg": 40}
    return G.calibration_sets(samples(spark, folder), sizes, 42, "id", CONTENT).select("id", "part")


LANGS = ("de", "en", "es", "fr")


@R.add("g4_balanced_kb", "\nUNION ALL ".join(
    f"SELECT id, '{lang}' AS kb_source, CAST({label} AS BIGINT) AS target FROM {sample_sql(f'''SELECT * FROM ({S}) WHERE cwe = '{lang}' AND target = {label}''', str(size), '42')}"
    for lang in LANGS for label, size in ((1, 15), (0, 40))))
def g4(spark, folder):
    rows = samples(spark, folder)
    sources = {lang: rows.where(F.col("cwe") == lang) for lang in LANGS}
    return G.balanced_kb(sources, 15, 40, 42, "id", CONTENT).select("id", "kb_source", "target")


@R.add("g5_evaluation_set", f"""
SELECT id, target FROM ({POS})
UNION ALL SELECT id, CAST(0 AS BIGINT) FROM {sample_sql(NEG, f'(SELECT greatest(0, 150 - count(*)) FROM ({POS}))', '42')}""")
def g5(spark, folder):
    return G.evaluation_set(samples(spark, folder), 150, 42, "id", CONTENT).select("id", "target")


@R.add("g6_stratified_holdout", f"""
SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id)
  <= round_even(count(*) OVER (PARTITION BY label) * 0.2, 0) AS is_val FROM ({B.sql(B.SCORED)})""")
def g6(spark, folder):
    rows = B.bind(spark, folder, B.SCORED).select("id", "label")
    return G.stratified_holdout(rows, "label", "id", 0.2, 42)


@R.add("t8_shuffled", f"SELECT id, row_number() OVER (ORDER BY md5('7|' || id), id) AS place FROM ({S})")
def t8(spark, folder):
    # The sort itself is distributed; the place is read back through a two-level count.
    from codewarden.operators.ordering import HASH_PREFIX
    from pyspark.sql import Window
    rows = samples(spark, folder).select("id", seeded_hash(7, F.col("id")).alias("h"))
    rows = rows.withColumn("b", F.substring("h", 1, HASH_PREFIX))
    sizes = rows.groupBy("b").agg(F.count("*").alias("n"))
    before = sizes.withColumn("base", F.coalesce(F.sum("n").over(
        Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    local = rows.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("h", "id")))
    return G.shuffled(local.join(before, "b"), 7, "id").select("id", (F.col("r") + F.col("base")).alias("place"))


LIST_ROWS = 1_000  # documents in a list file


@R.add("s2_s3_k1_json_lists", f"""
SELECT doc_id, lang, text, row_number() OVER (PARTITION BY doc_id // {LIST_ROWS} ORDER BY doc_id) - 1 AS row_index FROM documents""")
def s2(spark, folder):
    """Documents written as JSON lists and read back by pieces."""
    place = f"{shared_folder(spark)}/lists-{uuid.uuid4().hex}"
    item = F.struct("doc_id", F.to_json(F.struct("doc_id", "lang", "text"), {"ignoreNullFields": "false"}).alias("json"))
    lists = B.load(spark, folder, "documents").groupBy(F.expr(f"doc_id div {LIST_ROWS}").alias("page")).agg(
        F.array_sort(F.collect_list(item)).alias("items"))
    written = F.concat(F.lit("[\n"), F.array_join(F.transform("items", lambda i: i["json"]), ",\n"), F.lit("\n]"))
    lists.select(written.alias("value")).write.option("maxRecordsPerFile", 1).text(place)
    found = records.read_json_array(spark, f"{place}/*.txt")
    return found.select(
        F.try_variant_get("record", "$.doc_id", "long").alias("doc_id"), F.try_variant_get("record", "$.lang", "string").alias("lang"),
        F.try_variant_get("record", "$.text", "string").alias("text"), "row_index")


@R.add("s1_k1_json_lines", "SELECT doc_id, lang, text, n_chars FROM documents")
def s1(spark, folder):
    """Documents written as JSON Lines and read back; lines that are no JSON would come as null ids."""
    place = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    records.write_jsonl(B.load(spark, folder, "documents").select("doc_id", "lang", "text", "n_chars"), place)
    good, bad = records.read_jsonl(spark, f"{place}/*.json")
    found = good.select(
        F.try_variant_get("record", "$.doc_id", "long").alias("doc_id"), F.try_variant_get("record", "$.lang", "string").alias("lang"),
        F.try_variant_get("record", "$.text", "string").alias("text"), F.try_variant_get("record", "$.n_chars", "long").alias("n_chars"))
    none = F.lit(None)
    return found.unionByName(bad.select(none.cast("long").alias("doc_id"), none.cast("string").alias("lang"), F.col("line").alias("text"),
                                        none.cast("long").alias("n_chars")))
