"""Schemas of the stored tables, as DDL.  Readers pass them; nothing is inferred."""

KNOWLEDGE_BASE = (
    "id bigint, original_id string, code string, label string, cwe_id string, source_dataset string, code_md5 string")

TASKS = (
    "id bigint, name string, commit_id string, code string, ground_truth_label bigint, cwe_id string, "
    "status string, split string")

STATIC_CACHE = "task_name string, source_type int, analysis_mode string, feature_json string, created_at timestamp"

RESULTS = (
    "vuln_id bigint, raw_json string, final_decision string, cwe_id string, native_confidence double, "
    "calibrated_confidence double, static_has_flow boolean, static_complexity int, feat_static_apis_count int, "
    "feat_static_risk_density double, feat_static_graph_density double, feat_static_source_type int, "
    "feat_code_len int, feat_is_compressed boolean, feature_rag_similarity double, feat_rag_top1_sim double, "
    "feat_rag_sim_variance double, feat_conflict_disagreement double, feat_conflict_static_yes_llm_no int, "
    "feat_llm_uncertainty double, split string, created_at timestamp")

RESPONSES = "task_id bigint, round int, content string, logprobs array<struct<logprob: double>>"

KB_VECTORS = "doc_id bigint, vec array<float>"
KB_POSTINGS = "term string, doc_id bigint, tf bigint"
KB_DOC_STATS = "doc_id bigint, dl int"
KB_TERMS = "term string, df bigint, idf double"
KB_DIGESTS = "doc_id bigint, original_id string, label string, cwe_id string, code_md5 string"
