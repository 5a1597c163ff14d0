"""Static facts, responses, prompts, and the audit run."""

from pyspark.sql import functions as F

from checks import bind as B
from checks.preparation import TOOL_ROWS
from codewarden.functions import constants as K
from codewarden.functions import features as X
from codewarden.functions import prompts as P
from codewarden.functions import responses as RS
from codewarden.functions import static_facts as S
from codewarden.operators import retrieval as V
from codewarden.operators import static_facts as SF
from codewarden.operators import tables as T
from codewarden.plans import inference as I
from codewarden.sources.tool_results import map_tool_results

R = B.Registry()
NAMES = ("script", "style", "link", "href", "title", "div", "span", "lang")
NAME_LIST = "[" + ", ".join(f"'{n}'" for n in sorted(NAMES)) + "]"
WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
NOT_WORD = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"


def used_sql(code: str, after: str = "") -> str:
    """Sorted names that occur as whole words."""
    end = rf"({NOT_WORD}|$)" if not after else after
    return rf"list_filter({NAME_LIST}, lambda w: regexp_matches({code}, '(^|{NOT_WORD})' || w || '{end}'))"


def complexity_sql(code: str) -> str:
    return "least(1000, 1" + "".join(
        f" + (length({code}) - length(replace({code}, '{t}', ''))) // {len(t)}" for t in K.COMPLEXITY_TOKENS) + ")"


def pages(spark, folder):
    return B.load(spark, folder, "pages")


# --- lexical facts -----------------------------------------------------------------------------

@R.add("p16_lexical_complexity", f"SELECT page_id, {complexity_sql('html')} AS complexity FROM pages")
def p16(spark, folder):
    return pages(spark, folder).select("page_id", S.lexical_complexity(F.col("html")).alias("complexity"))


@R.add("p17_names_used", f"SELECT page_id, array_to_string({used_sql('html')}, ',') AS names FROM pages")
def p17(spark, folder):
    return pages(spark, folder).select("page_id", F.array_join(S.names_used(F.col("html"), NAMES), ",").alias("names"))


@R.add("p17_names_called", f"SELECT page_id, array_to_string({used_sql('code', after='[ ]*[(]')}, ',') AS names FROM (SELECT page_id, replace(html, 'href', 'href (') AS code FROM pages)")
def p17c(spark, folder):
    code = F.replace("html", F.lit("href"), F.lit("href ("))
    return pages(spark, folder).select("page_id", F.array_join(S.names_used(code, NAMES, calls_only=True), ",").alias("names"))


MIXED = "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(html, 'href', 'href (') ELSE html END AS code FROM {pages}"
CALLED = used_sql('code', after='\\s*[(]')


@R.add("p17_calls_else_words", f"SELECT page_id, array_to_string(CASE WHEN len({CALLED}) > 0 THEN {CALLED} ELSE {used_sql('code')} END, ',') AS names FROM ({B.sql(MIXED)})")
def p17m(spark, folder):
    return B.bind(spark, folder, MIXED).select("page_id", F.array_join(S.scan_names(F.col("code"), NAMES), ",").alias("names"))


@R.add("p17_api_names_in_documents", "SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(text, '" + WORD + "+')), lambda w: list_contains(["
       + ", ".join(f"'{n}'" for n in K.LEXICAL_API_NAMES) + "], w))), ',') AS names FROM documents")
def p17d(spark, folder):
    return B.load(spark, folder, "documents").select("doc_id", F.array_join(S.names_used(F.col("text")), ",").alias("names"))


@R.add("p18_sinks_called", "SELECT page_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(html, '[a-z]+')), lambda c: contains(c, 'scri') OR contains(c, 'tit'))), ',') AS calls FROM pages")
def p18(spark, folder):
    calls = F.regexp_extract_all("html", F.lit("([a-z]+)"), F.lit(1))
    return pages(spark, folder).select("page_id", F.array_join(F.array_sort(S.sinks_called(calls, ("scri", "tit"))), ",").alias("calls"))


@R.add("p19_u3_merge_names", f"SELECT page_id, array_to_string(list_sort(list_distinct(list_concat({used_sql('html')}, CASE WHEN page_id % 2 = 0 THEN ['open', 'div'] ELSE [] END))), ',') AS names FROM pages")
def p19(spark, folder):
    tool = F.expr("CASE WHEN page_id % 2 = 0 THEN array('open', 'div') END")
    return pages(spark, folder).select("page_id", F.array_join(S.merge_names(tool, S.names_used(F.col("html"), NAMES)), ",").alias("names"))


@R.add("p24_p26_f10_text_features", """
SELECT doc_id, round(2 / (length(text) + 1e-9), 12) AS density, round(ln(1 + length(text)), 9) AS length_feature, length(text) > 12000 AS long FROM documents""")
def p24(spark, folder):
    c = F.col("text")
    return B.load(spark, folder, "documents").select("doc_id", F.round(S.risk_density(F.lit(2), c), 12).alias("density"),
                                                     F.round(S.length_feature(c), 9).alias("length_feature"), S.is_long(c).alias("long"))


@R.add("p36_compress", r"""
SELECT doc_id, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, CASE WHEN length(text) <= 12000 THEN text
  WHEN length(text) > 12500 THEN text[:6000] || e'\n/* ... FORCE TRUNCATED ... */\n' || text[-6000:]
  ELSE text[:6000] || e'\n/* ... TRUNCATED ... */\n' || text[-6000:] END AS c FROM documents)""")
def p36(spark, folder):
    out = B.load(spark, folder, "documents").select("doc_id", S.compress(F.col("text")).alias("c"))
    return out.select("doc_id", F.length("c").alias("n"), F.md5("c").alias("digest"))


@R.add("p37_nesting", rf"""
WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '[{{}}()\[\]]')) AS ch, generate_subscripts(regexp_extract_all(html, '[{{}}()\[\]]'), 1) AS i FROM pages),
s AS (SELECT page_id, i, sum(CASE WHEN ch IN ('{{', '(', '[') THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS s FROM m),
n AS (SELECT page_id, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS now FROM s),
d AS (SELECT page_id, max(now)::INT AS depth FROM n GROUP BY 1),
t AS (SELECT page_id, len(regexp_extract_all(html, '{WORD}+|[^\s\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]')) AS tokens FROM pages)
SELECT t.page_id, coalesce(depth, 0) AS depth, tokens, round(coalesce(depth, 0) / tokens, 12) AS density FROM t LEFT JOIN d ON t.page_id = d.page_id""".replace("{{", "{").replace("}}", "}"))
def p37(spark, folder):
    out = pages(spark, folder).select("page_id", S.nesting(F.col("html")).alias("n"))
    return out.select("page_id", "n.depth", "n.tokens", F.round("n.density", 12).alias("density"))


# --- static facts of tasks ---------------------------------------------------------------------

TASKS = "SELECT page_id AS id, concat('page_', CAST(page_id AS STRING)) AS name, html AS code, CAST(floor(page_id / 8) AS BIGINT) AS batch FROM {pages}"
DONE = "SELECT concat('page_', CAST(page_id AS STRING)) AS task_name FROM {pages} WHERE url LIKE '%.org%'"
FACTS_SQL = f"""(SELECT task_id, coalesce(arg_max(coalesce(complexity, 0), pos), 0) AS complexity, arg_max(coalesce(has_data_flow, false), pos) AS flow,
  arg_max(CASE WHEN event_type = 'view' THEN [] ELSE [event_type] END, pos) AS apis
  FROM (SELECT *, CAST(regexp_extract(filename, '(\\d+)\\.c$', 1) AS BIGINT) AS task_id FROM ({B.sql(TOOL_ROWS)}) WHERE error IS NULL AND filename LIKE '%.c') GROUP BY task_id)"""
FUSED_SQL = f"""(SELECT id, name, batch, coalesce(flow, false) AS has_data_flow, CASE WHEN coalesce(complexity, 0) > 0 THEN complexity ELSE {complexity_sql('code')} END AS complexity,
  list_sort(list_distinct(list_concat(coalesce(apis, []), {used_sql('code')}))) AS apis, CASE WHEN task_id IS NULL THEN 1 ELSE 2 END AS source_type,
  CASE WHEN task_id IS NULL THEN 'ast_fallback' ELSE 'hybrid' END AS analysis_mode, task_id IS NULL AND len({used_sql('code')}) > 0 AS lexical_hit
  FROM ({B.sql(TASKS)}) LEFT JOIN {FACTS_SQL} ON task_id = id)"""


def facts(spark, folder):
    rows = B.bind(spark, folder, TOOL_ROWS).withColumn("apis", F.when(F.col("event_type") != "view", F.array("event_type", "event_type")))
    return map_tool_results(rows)


@R.add("p20_j11_fuse_facts", f"SELECT id, has_data_flow, complexity, array_to_string(apis, ',') AS apis, source_type, analysis_mode, lexical_hit FROM {FUSED_SQL}")
def p20(spark, folder):
    out = SF.fuse_facts(B.bind(spark, folder, TASKS), facts(spark, folder), names=NAMES)
    return out.select("id", "has_data_flow", "complexity", F.array_join("apis", ",").alias("apis"), "source_type", "analysis_mode", "lexical_hit")


@R.add("l1_p21_j3_static_features", f"""
SELECT name AS task_name, source_type, analysis_mode,
  '{{"has_flow":' || has_data_flow || ',"complexity":' || complexity || ',"apis":[' || array_to_string(list_transform(apis, lambda a: '"' || a || '"'), ',') || ']}}' AS feature_json
FROM {FUSED_SQL} f WHERE NOT EXISTS (SELECT 1 FROM ({B.sql(DONE)}) d WHERE d.task_name = f.name)""")
def l1(spark, folder):
    return SF.static_features(B.bind(spark, folder, TASKS), B.bind(spark, folder, DONE), facts(spark, folder), NAMES)


@R.add("l2_crashed_batches", f"SELECT batch, count(*) AS tasks, count(task_id) AS succeeded FROM ({B.sql(TASKS)}) LEFT JOIN {FACTS_SQL} ON task_id = id GROUP BY batch HAVING count(*) > 1 AND count(task_id) = 0")
def l2(spark, folder):
    return SF.crashed_batches(B.bind(spark, folder, TASKS), facts(spark, folder), "batch")


CACHE_SQL = B.sql(B.CACHE)
DECODED_SQL = f"""(SELECT t.id, t.name, t.code, coalesce(c.source_type, 0) AS source_type,
  CASE WHEN c.source_type = 1 OR c.feature_json IS NULL THEN false ELSE coalesce((c.feature_json::JSON->>'has_flow') = 'true', false) END AS has_flow,
  coalesce((c.feature_json::JSON->>'complexity')::INT, 0) AS complexity,
  coalesce(CASE WHEN (c.feature_json::JSON->>'apis') IS NULL THEN 0 ELSE json_array_length(c.feature_json::JSON, '$.apis') END, 0) AS api_count
  FROM ({B.sql(B.DOC_TASKS)}) t LEFT JOIN ({CACHE_SQL}) c ON c.task_name = t.name)"""


@R.add("p22_decode_features", f"SELECT id, source_type, has_flow, complexity, api_count FROM {DECODED_SQL}")
def p22(spark, folder):
    rows = SF.decode_features(T.with_static_cache(B.bind(spark, folder, B.DOC_TASKS), B.bind(spark, folder, B.CACHE)))
    return rows.select("id", "source_type", "has_flow", "complexity", F.size("apis").alias("api_count"))


EVIDENCE = "CASE WHEN source_type = 2 AND has_flow THEN 'CONFIRMED RISK (Traced by Joern)' WHEN source_type = 2 THEN 'CLEARED (No Flow Detected by Joern)' WHEN source_type = 1 THEN 'POTENTIAL HINT (Regex Only)' ELSE 'UNKNOWN' END"


@R.add("p23_evidence_text", f"SELECT id, {EVIDENCE} AS evidence FROM {DECODED_SQL}")
def p23(spark, folder):
    rows = SF.decode_features(T.with_static_cache(B.bind(spark, folder, B.DOC_TASKS), B.bind(spark, folder, B.CACHE)))
    return rows.select("id", P.evidence_text(F.col("source_type"), F.col("has_flow")).alias("evidence"))


@R.add("p25_conflicts", "SELECT doc_id, (quality + toxic) * abs(toxic - quality) * 1.0 AS weighted, CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END AS special FROM labels")
def p25(spark, folder):
    flow, decision, kind = F.col("toxic") == 1, F.col("quality"), F.col("quality") + F.col("toxic")
    return B.load(spark, folder, "labels").select(
        "doc_id", X.weighted_conflict(kind, flow, decision).alias("weighted"), X.flow_but_benign(flow, decision).alias("special"))


# --- responses ---------------------------------------------------------------------------------

RESP_SQL = B.sql(B.RESPONSES)


def responses(spark, folder):
    rows = B.bind(spark, folder, B.RESPONSES)
    lp = F.expr("array(named_struct('logprob', -a / 10D), named_struct('logprob', CAST(NULL AS DOUBLE)), named_struct('logprob', -b / 4D))")
    return rows.withColumn("logprobs", F.when(F.col("a") == 6, F.expr("CAST(array() AS array<struct<logprob:double>>)")).otherwise(lp)).drop("lang", "a", "b")


CONF_SQL = "CASE WHEN a = 6 THEN 0.5 ELSE (exp(-a / 10.0) + exp(-b / 4.0)) / 2 END"
ENT_SQL = "CASE WHEN a = 6 THEN 0.0 ELSE -exp(-a / 10.0) * ln(exp(-a / 10.0) + 1e-10) - exp(-b / 4.0) * ln(exp(-b / 4.0) + 1e-10) END"
SHAPE = "CASE WHEN round = 2 THEN CASE WHEN task_id % 4 = 0 THEN 20 ELSE 21 END ELSE task_id % 10 END"
PARSED_SQL = f"""(SELECT task_id, round, k NOT IN (2, 3, 4, 6, 9) AS valid,
  CASE k WHEN 2 THEN '[SYSTEM FALLBACK] JSON Parse Failure: final_decision missing or unknown...' WHEN 3 THEN '[SYSTEM FALLBACK] JSON Parse Failure: not valid JSON...'
    WHEN 4 THEN '[SYSTEM FALLBACK] JSON Parse Failure: static_analysis_review unknown...' WHEN 6 THEN '[SYSTEM FALLBACK] JSON Parse Failure: confidence missing or no number...'
    WHEN 9 THEN '[SYSTEM FALLBACK] JSON Parse Failure: final_decision missing or unknown...' WHEN 20 THEN 'again' WHEN 21 THEN 'again' ELSE lang END AS thought_process,
  CASE WHEN k IN (2, 3, 4, 6, 9) THEN 'UNCERTAIN' WHEN k = 0 THEN 'DISAGREE_LOGIC_FOUND' ELSE 'AGREE' END AS static_analysis_review,
  CASE k WHEN 0 THEN 'a=true,b=true,c=true,f=false,g=true,i=false' WHEN 7 THEN 'a=true,b=true,c=true,d=false,e=true,f=false' ELSE '' END AS evidence,
  CASE WHEN k IN (0, 5, 7, 8, 20) THEN 'VULNERABLE' ELSE 'BENIGN' END AS final_decision,
  CASE k WHEN 0 THEN 0.85 WHEN 1 THEN 0.4 WHEN 7 THEN 1.0 WHEN 8 THEN 1.0 WHEN 20 THEN 0.8 WHEN 21 THEN 0.3 ELSE 0.0 END AS confidence,
  CASE WHEN k IN (2, 3, 4, 6, 9) THEN 'Unknown' WHEN k = 0 THEN 'CWE-1' WHEN k = 5 THEN source WHEN k = 20 THEN 'CWE-2' END AS cwe_id,
  k IN (0, 7) AS many_evidence, {CONF_SQL} AS conf, {ENT_SQL} AS ent
  FROM (SELECT r.*, d.source, {SHAPE} AS k FROM ({RESP_SQL}) r JOIN documents d ON d.doc_id = r.task_id))"""


@R.add("p27_p28_p29_f11_parse_responses", f"SELECT task_id, round, valid, thought_process, static_analysis_review, evidence, final_decision, confidence, cwe_id, many_evidence FROM {PARSED_SQL}")
def p27(spark, folder):
    out = RS.parse_responses(responses(spark, folder).drop("logprobs"))
    return out.select("task_id", "round", "response.*").withColumn(
        "evidence", F.array_join(F.array_sort(F.transform(F.map_entries("evidence"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ","))


@R.add("p29_clamp_confidence", "SELECT event_id, greatest(0, least(1, CASE WHEN value - 1 > 1 THEN (value - 1) / 100 ELSE value - 1 END)) AS c FROM events")
def p29(spark, folder):
    return B.load(spark, folder, "events").select("event_id", RS.clamp_confidence(F.col("value") - 1).alias("c"))


@R.add("p30_p31_certainty", f"SELECT task_id, round, round({CONF_SQL}, 9) AS native_confidence, round({ENT_SQL}, 9) AS entropy FROM ({RESP_SQL})")
def p30(spark, folder):
    return responses(spark, folder).select("task_id", "round", F.round(RS.native_confidence(F.col("logprobs")), 9).alias("native_confidence"),
                                           F.round(RS.entropy(F.col("logprobs")), 9).alias("entropy"))


# --- prompts and the run -----------------------------------------------------------------------

HITS_SQL = B.sql(B.HITS)
STATS_SQL = f"(SELECT qid, avg(similarity) AS sim_avg, max(similarity) AS sim_max, CASE WHEN count(*) > 1 THEN var_pop(similarity) ELSE 0 END AS sim_var FROM ({HITS_SQL}) GROUP BY qid)"
TEXT_SQL = f"""(SELECT qid, substr(string_agg('[Ref:' || original_id || ' | Sim:' || trunc(similarity * 100)::INT || '%] ' || label || e'\\n', '' ORDER BY rank), 1, 2000) AS hits
  FROM ({HITS_SQL}) GROUP BY qid)"""
DENS = "(api_count / (length(code) + 1e-9))"
RULES = f"""coalesce(nullif(concat_ws(e'\\n    ', CASE WHEN source_type = 2 AND NOT has_flow THEN '{K.RULE_NO_FLOW}' END,
  CASE WHEN {DENS} < 0.3 THEN '{K.RULE_LOW_DENSITY}' END, CASE WHEN source_type <> 2 THEN '{K.RULE_NO_GRAPH}' END), ''), '{K.RULE_DEFAULT}')"""
PROMPT = rf"""e'\n    **SEC 1: SYSTEM METRICS**\n    - Complexity: ' || complexity || e'\n    - API Density: ' || printf('%.4f', {DENS}) || e'\n    - **Static Data Flow**: **' || {EVIDENCE}
  || e'**\n    \n\n    **SEC 2: CONTEXTUAL RAG SAMPLES**\n    ' || coalesce(hits, '{K.NO_HITS_TEXT}') || e'\n\n    **SEC 3: METHODOLOGY & CONSTRAINTS**\n    ' || 'few' || e'\n    ' || {RULES}
  || e'\n\n    **SEC 4: TARGET CODE FOR AUDIT**\n    ' || CASE WHEN length(code) > 17054 THEN code[:17054] || e'\n/* ...TRUNCATED... */' ELSE code END
  || e'\n\n    Apply the protocol step-by-step. Output JSON with traced evidence.\n    '"""
FEAT_SQL = f"""(SELECT d.*, coalesce(sim_avg, 0) AS sim_avg, coalesce(sim_max, 0) AS sim_max, coalesce(sim_var, 0) AS sim_var, h.hits
  FROM {DECODED_SQL} d LEFT JOIN {STATS_SQL} s ON s.qid = d.id LEFT JOIN {TEXT_SQL} h ON h.qid = d.id)"""


def features(spark, folder):
    return I.task_features(B.bind(spark, folder, B.DOC_TASKS), B.bind(spark, folder, B.CACHE), B.bind(spark, folder, B.HITS))


@R.add("a7_hit_stats", f"SELECT id AS qid, round(coalesce(sim_avg, 0), 9) AS sim_avg, coalesce(sim_max, 0) AS sim_max, round(coalesce(sim_var, 0), 13) AS sim_var FROM ({B.sql(B.DOC_TASKS)}) LEFT JOIN {STATS_SQL} ON qid = id")
def a7(spark, folder):
    queries = B.bind(spark, folder, B.DOC_TASKS).select(F.col("id").alias("qid"))
    return V.hit_stats(queries, B.bind(spark, folder, B.HITS)).withColumns({"sim_avg": F.round("sim_avg", 9), "sim_var": F.round("sim_var", 13)})


@R.add("p32_constraint_text", f"SELECT id, {RULES} AS rules FROM {DECODED_SQL}")
def p32(spark, folder):
    return features(spark, folder).select("id", P.constraint_text(F.col("source_type"), F.col("has_flow"), F.col("density")).alias("rules"))


@R.add("p33_hits_text", f"SELECT id, coalesce(hits, '{K.NO_HITS_TEXT}') AS hits FROM {FEAT_SQL}")
def p33(spark, folder):
    return features(spark, folder).select("id", P.hits_text(F.col("hits")).alias("hits"))


@R.add("p34_l3_make_prompts", f"SELECT id, length({PROMPT}) AS n, md5({PROMPT}) AS digest FROM {FEAT_SQL}")
def p34(spark, folder):
    out = I.make_prompts(features(spark, folder), few_shot="few")
    return out.select("id", F.length("prompt").alias("n"), F.md5("prompt").alias("digest"))


ROUND1_SQL = f"""(SELECT f.*, p.final_decision, p.conf, p.ent, p.thought_process, p.cwe_id, p.round IS NULL AS failed, coalesce(conf, 0.0) AS score,
  CASE WHEN final_decision = 'VULNERABLE' AND source_type = 2 AND NOT has_flow THEN 'Conflict' WHEN final_decision = 'VULNERABLE' AND coalesce(conf, 0) < 0.75 THEN 'WeakCalibration' END AS reason
  FROM {FEAT_SQL} f LEFT JOIN (SELECT * FROM {PARSED_SQL} WHERE round = 1) p ON p.task_id = f.id)"""


@R.add("f9_l3_score_round1", f"SELECT id, final_decision, round(score, 9) AS score, reason FROM {ROUND1_SQL}")
def f9(spark, folder):
    out = I.score_round1(features(spark, folder), responses(spark, folder), weak_below=0.75)
    return out.select("id", F.col("response.final_decision").alias("final_decision"), F.round("score", 9).alias("score"), "reason")


@R.add("p35_make_rebuttals", rf"""
SELECT id, reason, md5({PROMPT} || e'\n\n**[SYSTEM AUDIT INTERVENTION]**\nYour analysis predicted VULNERABLE, but detected conflicting evidence:\n- Static Analysis: ' || {EVIDENCE}
  || e'\n- Calibrated Probability: ' || printf('%.2f', score) || e' (Low Confidence)\n\n**REFLECTION REQUIRED**:\n1. If you cannot identify a decisive LOGIC/RACE/INTEGER flaw -> **CORRECT to BENIGN**.\n2. If flaw is strictly independent of data flow -> **MAINTAIN VULNERABLE**.\n\nWait: If you are uncertain (< 30% confidence), strictly Default to Safe.') AS digest
FROM {ROUND1_SQL} WHERE reason IS NOT NULL""")
def p35(spark, folder):
    rows = features(spark, folder)
    out = I.make_rebuttals(I.score_round1(rows, responses(spark, folder), weak_below=0.75), I.make_prompts(rows, few_shot="few"))
    return out.select("id", "reason", F.md5("prompt").alias("digest"))


FINAL_SQL = f"""(SELECT a.id, a.failed, a.reason, a.score AS first_score, a.source_type, a.has_flow, a.complexity, a.api_count, a.code, a.sim_avg, a.sim_max, a.sim_var,
  a.reason IS NOT NULL AND b.round IS NOT NULL AS reflected,
  CASE WHEN a.reason IS NOT NULL AND b.round IS NOT NULL THEN b.final_decision ELSE a.final_decision END AS final_decision,
  CASE WHEN a.reason IS NOT NULL AND b.round IS NOT NULL THEN b.cwe_id ELSE a.cwe_id END AS cwe_id,
  CASE WHEN a.reason IS NOT NULL AND b.round IS NOT NULL THEN b.conf ELSE a.conf END AS conf,
  CASE WHEN a.reason IS NOT NULL AND b.round IS NOT NULL THEN b.ent ELSE a.ent END AS ent
  FROM {ROUND1_SQL} a LEFT JOIN (SELECT * FROM {PARSED_SQL} WHERE round = 2) b ON b.task_id = a.id)"""


@R.add("j10_l3_l4_finalise", f"""
SELECT id AS vuln_id, CASE WHEN failed THEN 'Failed' ELSE 'Success' END AS status, final_decision, cwe_id, round(conf, 9) AS native_confidence,
  CASE WHEN NOT failed THEN round(conf, 9) END AS calibrated_confidence, reason, reflected,
  reflected AND final_decision = 'VULNERABLE' AND conf < 0.3 AS unreliable, has_flow AS static_has_flow, complexity AS static_complexity,
  api_count AS feat_static_apis_count, round({DENS}, 12) AS feat_static_risk_density, source_type AS feat_static_source_type, length(code) AS feat_code_len,
  length(code) > 12000 AS feat_is_compressed, round(sim_avg, 9) AS feature_rag_similarity, sim_max AS feat_rag_top1_sim, round(sim_var, 13) AS feat_rag_sim_variance,
  source_type * abs(has_flow::INT - CASE WHEN final_decision = 'VULNERABLE' THEN 1 ELSE 0 END) * 1.0 AS feat_conflict_disagreement,
  CASE WHEN has_flow AND coalesce(final_decision, '') <> 'VULNERABLE' THEN 1 ELSE 0 END AS feat_conflict_static_yes_llm_no, round(ent, 9) AS feat_llm_uncertainty
FROM {FINAL_SQL}""")
def j10(spark, folder):
    out = I.finalise(features(spark, folder), responses(spark, folder), weak_below=0.75)
    nine = ("native_confidence", "calibrated_confidence", "feature_rag_similarity", "feat_llm_uncertainty")
    return out.drop("raw_json", "first_score", "source_type", "feat_static_graph_density").withColumns(
        {**{c: F.round(c, 9) for c in nine}, "feat_static_risk_density": F.round("feat_static_risk_density", 12),
         "feat_rag_sim_variance": F.round("feat_rag_sim_variance", 13)})
