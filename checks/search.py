"""Retrieval, calibration and streaming."""

import uuid

from pyspark.sql import functions as F

from checks import bind as B
from checks import scoring
from codewarden.functions import features as X
from codewarden.functions.constants import FEATURE_NAMES
from codewarden.functions.text import clip_for_embedding, is_blank, unit_vector
from codewarden.operators import retrieval as V
from codewarden.operators import tables as T
from codewarden.operators.cells import build_cells, search_cells
from codewarden.operators.postings import postings_read, search_postings
from codewarden.plans import calibration as C
from codewarden.session import shared_folder
from codewarden.sources.store import read_kb_tables, write_kb_tables
from codewarden.streaming import attempts as AT
from codewarden.streaming import results as ST

R = B.Registry()


def new_folder(spark, name):
    """A folder of its own below the one that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def documents(spark, folder):
    return B.load(spark, folder, "documents")


def vectors(spark, folder, name):
    return B.load(spark, folder, "embeddings").select(F.col("vec_id").alias(name), F.col("embedding").alias("vec"))


# --- dense -------------------------------------------------------------------------------------

def dense_sql(k: int, extra: str = "q.vec_id <> c.vec_id") -> str:
    return f"""(SELECT * FROM (SELECT q.vec_id AS qid, c.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) DESC, c.vec_id) AS rank
  FROM embeddings q, embeddings c WHERE {extra}) WHERE rank <= {k})"""


@R.add("r1_j8_t1_w1_dense_topk", f"SELECT qid, doc_id, rank, score FROM {dense_sql(30)}")
def r1(spark, folder):
    return V.dense_topk(vectors(spark, folder, "qid"), vectors(spark, folder, "doc_id"), 30, skip_self=True)


@R.add("r1_dense_topk_grid", f"SELECT qid, doc_id, rank, score FROM {dense_sql(30)}")
def r1g(spark, folder):
    limits = V.BlockLimits(query_block_rows=200)
    return V.dense_topk(vectors(spark, folder, "qid"), vectors(spark, folder, "doc_id"), 30, skip_self=True, limits=limits)


@R.add("r1_cells_topk", f"SELECT qid, doc_id, rank, score FROM {dense_sql(30)}")
def r1c(spark, folder):
    """The same through stored cells; those below a query's floor are not read."""
    place = new_folder(spark, "cells")
    write_kb_tables(build_cells(vectors(spark, folder, "doc_id")), place)
    stored = read_kb_tables(spark, place, ("kb_cells", "kb_cell_vectors"))
    return search_cells(vectors(spark, folder, "qid"), stored["kb_cells"], stored["kb_cell_vectors"], 30, skip_self=True)[0]


@R.add("f7_w4_gate", f"SELECT qid, doc_id, rank FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM {dense_sql(30)}) WHERE best >= 0.40")
def f7(spark, folder):
    hits = V.dense_topk(vectors(spark, folder, "qid"), vectors(spark, folder, "doc_id"), 30, skip_self=True)
    return V.gate(hits, 0.40).select("qid", "doc_id", "rank")


@R.add("p39_unit_vector", """
SELECT vec_id, round(list_extract(v, 1), 6) AS first_value, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM (
  SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: 0.0) ELSE list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) END AS v FROM embeddings)""")
def p39(spark, folder):
    factor = F.expr("CASE WHEN vec_id % 9 = 0 THEN 0D ELSE 3D END")
    v = unit_vector(F.transform("embedding", lambda x: x.cast("double") * factor))
    out = B.load(spark, folder, "embeddings").select("vec_id", v.alias("v"))
    return out.select("vec_id", F.round(F.col("v")[0], 6).alias("first_value"),
                      F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


@R.add("p39_embedding_text", "SELECT doc_id, length(text[:8000]) AS n, md5(text[:8000]) AS digest, trim(text) = '' AS blank FROM documents")
def p39t(spark, folder):
    c = clip_for_embedding(F.col("text"), 8000)
    return B.load(spark, folder, "documents").select("doc_id", F.length(c).alias("n"), F.md5(c).alias("digest"), is_blank(F.col("text")).alias("blank"))


@R.add("r6_hashed_text_vectors", r"""SELECT doc_id, CASE WHEN regexp_matches(text[:8000], '\S') THEN 1.0 ELSE 0.0 END AS norm2 FROM documents""")
def r6(spark, folder):
    out = V.hashed_text_vectors(documents(spark, folder), "doc_id", "text", 768)
    return out.select("doc_id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x), 4).alias("norm2"))


# --- BM25 --------------------------------------------------------------------------------------

def bm25_ctes(corpus: str, queries: str) -> str:
    """tok(doc_id, term, tf), len(doc_id, dl), idf(term, df, idf), hits(qid, doc_id, score)."""
    split = lambda c: f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"
    return f"""
raw AS MATERIALIZED (SELECT doc_id, {split('code')} AS w FROM ({corpus})),
len AS MATERIALIZED (SELECT doc_id, len(w) AS dl FROM raw),
tok AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM raw) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tok GROUP BY term),
raw_idf AS MATERIALIZED (SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) AS i FROM df, (SELECT count(*) AS n FROM len)),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN i < 0 THEN 0.25 * m ELSE i END AS idf FROM raw_idf, (SELECT round(avg(i), 9) AS m FROM raw_idf)),
qt AS MATERIALIZED (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({split('code')}) AS term FROM ({queries})) GROUP BY ALL),
part AS MATERIALIZED (SELECT tok.doc_id, tok.term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM len))) AS p
  FROM tok JOIN idf ON idf.term = tok.term JOIN len ON len.doc_id = tok.doc_id),
hits AS MATERIALIZED (SELECT qid, doc_id, round(sum(qtf * p), 9) AS score FROM qt JOIN part ON part.term = qt.term GROUP BY ALL HAVING sum(qtf * p) > 0)"""


CORPUS = "SELECT doc_id, text AS code FROM documents"
QUERIES = "SELECT item_id AS qid, text AS code FROM benchmark"


def corpus_tokens(spark, folder):
    return V.tokenized(documents(spark, folder), "doc_id", "text")


def benchmark_queries(spark, folder):
    return V.asked_words(B.load(spark, folder, "benchmark"), "item_id", "text")


def text_index(spark, folder):
    """The text index of all documents, stored and read again."""
    return V.store_text_index(corpus_tokens(spark, folder), new_folder(spark, "text-index"))


def six_digits(hits):
    """Rounded by plain arithmetic, which gives the same bits in every engine."""
    return hits.withColumn("score", F.floor(F.col("score") * 1e6 + 0.5) / 1e6)


@R.add("a21_corpus_stats", f"WITH {bm25_ctes(CORPUS, QUERIES)} SELECT count(*) AS docs, round(avg(dl), 6) AS mean_dl FROM len")
def a21(spark, folder):
    return V.corpus_stats(corpus_tokens(spark, folder)).withColumn("mean_dl", F.round("mean_dl", 6))


@R.add("a21_term_stats", f"WITH {bm25_ctes(CORPUS, QUERIES)} SELECT md5(term) AS term, df, round(idf, 6) AS idf FROM idf")
def a21t(spark, folder):
    return V.term_stats(corpus_tokens(spark, folder)).select(F.md5("term").alias("term"), "df", F.round("idf", 6).alias("idf"))


@R.add("r5_postings", f"WITH {bm25_ctes(CORPUS, QUERIES)} SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS tokens, max(tf) AS top FROM tok GROUP BY doc_id")
def r5(spark, folder):
    rows = V.postings(corpus_tokens(spark, folder))
    return rows.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"), F.max("tf").alias("top"))


@R.add("r2_j9_t2_bm25_topk", f"""WITH {bm25_ctes(CORPUS, QUERIES)}
SELECT qid, doc_id, rank, floor(score * 1e6 + 0.5) / 1e6 AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM hits) WHERE rank <= 30""")
def r2(spark, folder):
    return six_digits(V.bm25_topk(benchmark_queries(spark, folder), corpus_tokens(spark, folder)))


@R.add("r2_postings_read", f"""WITH {bm25_ctes(CORPUS, QUERIES)}
SELECT q.qid, coalesce(sum(df), 0)::BIGINT AS every, true AS within FROM ({QUERIES}) q LEFT JOIN qt ON qt.qid = q.qid LEFT JOIN df ON df.term = qt.term GROUP BY q.qid""")
def r2p(spark, folder):
    stored, asked = text_index(spark, folder), benchmark_queries(spark, folder)
    counts = postings_read(asked, stored["kb_segments"], stored["kb_terms"], 30)
    return asked.select("qid").join(counts, "qid", "left").select(
        "qid", F.coalesce("every", F.lit(0)).cast("long").alias("every"), (F.coalesce("read", F.lit(0)) <= F.coalesce("every", F.lit(0))).alias("within"))


@R.add("r2_stored_postings", f"""WITH {bm25_ctes(CORPUS, QUERIES)}
SELECT qid, doc_id, rank, floor(score * 1e6 + 0.5) / 1e6 AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM hits) WHERE rank <= 30""")
def r2m(spark, folder):
    stored = text_index(spark, folder)
    return six_digits(search_postings(benchmark_queries(spark, folder), stored["kb_segments"], stored["kb_terms"], 30))


@R.add("r2_bm25_topk_grid", f"""WITH {bm25_ctes(CORPUS, QUERIES)}
SELECT qid, doc_id, rank, floor(score * 1e6 + 0.5) / 1e6 AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM hits) WHERE rank <= 30""")
def r2g(spark, folder):
    limits = V.BlockLimits(query_block_rows=30)
    return six_digits(V.bm25_topk(benchmark_queries(spark, folder), corpus_tokens(spark, folder), limits=limits))


LEAK = "md5(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"


@R.add("f8_leak_filter", f"""
SELECT qid, doc_id FROM (SELECT e.qid, e.doc_id FROM {dense_sql(30, 'true')} e JOIN documents a ON a.doc_id = e.qid JOIN documents b ON b.doc_id = e.doc_id
  WHERE {LEAK.format(c='a.text')} <> {LEAK.format(c='b.text')})""")
def f8(spark, folder):
    kb = B.bind(spark, folder, B.KB)
    hits = V.dense_topk(vectors(spark, folder, "qid"), vectors(spark, folder, "doc_id"), 30)
    asked = kb.select(F.col("doc_id").alias("qid"), "code")
    wide = hits.withColumns({"similarity": F.col("score"), "rrf": F.lit(0.0)})
    return V.resolve(wide, asked, kb, 30).select("qid", "doc_id")


# --- fusion ------------------------------------------------------------------------------------

KB_SQL = B.sql(B.KB)
SQUEEZED = r"""CASE WHEN length(code) <= 12000 THEN code WHEN length(code) > 12500 THEN code[:6000] || e'\n/* ... FORCE TRUNCATED ... */\n' || code[-6000:]
  ELSE code[:6000] || e'\n/* ... TRUNCATED ... */\n' || code[-6000:] END"""


def hybrid_ctes(where: str = "true", gate: str = "true") -> str:
    """dense, passed, sparse, fused over the documents that have a vector."""
    kb = f"SELECT doc_id, {SQUEEZED} AS code FROM ({KB_SQL})"
    asked = f"SELECT doc_id AS qid, {SQUEEZED} AS code FROM ({KB_SQL}) WHERE doc_id IN (SELECT qid FROM passed)"
    return f"""
dense AS MATERIALIZED (SELECT * FROM {dense_sql(30, "q.vec_id IN (SELECT doc_id FROM documents) AND c.vec_id IN (SELECT doc_id FROM documents)")}),
kbm AS MATERIALIZED (SELECT *, {LEAK.format(c='code')} AS digest FROM ({KB_SQL})),
passed AS MATERIALIZED ({gate}),
{bm25_ctes(kb, asked)},
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM hits) WHERE rank <= 30),
merged AS (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.doc_id, s.doc_id) AS doc_id, d.rank AS dense_rank, s.rank AS sparse_rank, d.score AS similarity,
  coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + s.rank), 0) AS rrf
  FROM (SELECT * FROM dense WHERE qid IN (SELECT qid FROM passed)) d FULL JOIN sparse s ON s.qid = d.qid AND s.doc_id = d.doc_id),
fused AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS rank FROM merged) WHERE rank <= 15),
final AS (SELECT * FROM (SELECT f.*, b.original_id, b.label, coalesce(nullif(b.cwe_id, ''), 'N/A') AS cwe_id, row_number() OVER (PARTITION BY f.qid ORDER BY f.rank) AS hit
  FROM fused f JOIN kbm a ON a.doc_id = f.qid JOIN kbm b ON b.doc_id = f.doc_id WHERE a.digest <> b.digest) WHERE hit <= 5)"""


PARITY_GATE = "SELECT qid FROM dense WHERE rank = 1 AND score >= 0.6"
LEAK_GATE = "SELECT DISTINCT qid FROM dense e JOIN kbm a ON a.doc_id = e.qid JOIN kbm b ON b.doc_id = e.doc_id WHERE a.digest <> b.digest AND e.score >= 0.40"


def kb_frame(spark, folder):
    return B.bind(spark, folder, B.KB).repartition("doc_id")


@R.add("r3_a8_j6_t3_fusion", f"""WITH {hybrid_ctes(gate=PARITY_GATE)} SELECT qid, doc_id, rank, round(rrf, 9) AS rrf FROM fused""")
def r3(spark, folder):
    kb = kb_frame(spark, folder)
    asked = kb.select(F.col("doc_id").alias("qid"), "code", "vec")
    dense = V.gate(V.dense_topk(asked, kb, 30))
    asked = asked.join(dense.select("qid").distinct(), "qid", "left_semi")
    sparse = V.bm25_topk(V.asked_words(V.shortened(asked, "qid")), V.tokenized(V.shortened(kb, "doc_id")))
    return V.fused_topk(V.fuse(dense, sparse), 15).select("qid", "doc_id", "rank", F.round("rrf", 9).alias("rrf"))


@R.add("r4_t4_j5_hybrid_search", f"""WITH {hybrid_ctes(gate=PARITY_GATE)}
SELECT qid, hit AS rank, doc_id, original_id, label, cwe_id, coalesce(similarity, 0.5) AS similarity, round(rrf, 9) AS rrf FROM final""")
def r4(spark, folder):
    kb = kb_frame(spark, folder)
    hits = V.hybrid_search(kb.select(F.col("doc_id").alias("qid"), "code", "vec"), kb)
    return hits.withColumn("rrf", F.round("rrf", 9))


@R.add("r4_stored_index", f"""WITH {hybrid_ctes(gate=PARITY_GATE)}
SELECT qid, hit AS rank, doc_id, original_id, label, cwe_id, coalesce(similarity, 0.5) AS similarity, round(rrf, 9) AS rrf FROM final""")
def r4s(spark, folder):
    """The same from the stored tables: vectors, postings and digests; only the queries' texts are read."""
    kb, place = kb_frame(spark, folder), new_folder(spark, "knowledge-base")
    write_kb_tables(V.build_kb_tables(kb), place)
    hits = V.hybrid_search(kb.select(F.col("doc_id").alias("qid"), "code", "vec"), kb, index=read_kb_tables(spark, place))
    return hits.withColumn("rrf", F.round("rrf", 9))


@R.add("r4_gate_after_leak", f"""WITH {hybrid_ctes(gate=LEAK_GATE)}
SELECT qid, hit AS rank, doc_id, coalesce(similarity, 0.5) AS similarity FROM final""")
def r4g(spark, folder):
    kb = kb_frame(spark, folder)
    hits = V.hybrid_search(kb.select(F.col("doc_id").alias("qid"), "code", "vec"), kb, threshold=0.40, gate_after_leak=True)
    return hits.select("qid", "rank", "doc_id", "similarity")


@R.add("a20_kb_tables_agree", f"SELECT count(*) AS rows_left, count(*) AS rows_right, count(*) AS ids_left, count(*) AS ids_right, true AS intact FROM ({KB_SQL})")
def a20k(spark, folder):
    tables = V.build_kb_tables(kb_frame(spark, folder))
    return T.integrity(tables["kb_vectors"], tables["kb_doc_stats"], "doc_id")


# --- calibration -------------------------------------------------------------------------------

FEATURE_SQL = """SELECT vuln_id, CASE WHEN coalesce(native_confidence, 0) = 0 THEN 0.5 ELSE native_confidence END AS llm_native_conf,
  CASE WHEN static_has_flow THEN 1.0 ELSE 0.0 END AS static_has_flow, static_complexity * 1.0 AS static_complexity, coalesce(feat_static_apis_count, 0) * 1.0 AS static_apis_count,
  coalesce(feat_static_risk_density, 0) AS static_risk_density, coalesce(feat_static_graph_density, 0) AS static_graph_density, feat_static_source_type * 1.0 AS source_type,
  ln(1 + feat_code_len) AS code_len_log, CASE WHEN feat_is_compressed THEN 1.0 ELSE 0.0 END AS is_compressed, feature_rag_similarity AS rag_sim_avg,
  feat_rag_top1_sim AS rag_top1_sim, feat_rag_sim_variance AS rag_var, feat_conflict_disagreement AS conflict_disagree_weighted,
  feat_conflict_static_yes_llm_no * 1.0 AS conflict_special, feat_llm_uncertainty AS llm_entropy FROM (""" + scoring.RS + ")"


@R.add("p41_p42_feature_frame", "SELECT * REPLACE (round(code_len_log, 9) AS code_len_log) FROM (" + FEATURE_SQL + ")")
def p41(spark, folder):
    return C.feature_frame(scoring.results(spark, folder), "vuln_id").withColumn("code_len_log", F.round("code_len_log", 9))


@R.add("p41_online_variant", "SELECT vuln_id, coalesce(native_confidence, 0) AS llm_native_conf FROM (" + scoring.RS + ")")
def p41o(spark, folder):
    return C.feature_frame(scoring.results(spark, folder), "vuln_id", online=True).select("vuln_id", "llm_native_conf")


@R.add("p42_finite", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN -1.0 ELSE value END AS v FROM events")
def p42(spark, folder):
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN double('-Infinity') ELSE value END")
    return B.load(spark, folder, "events").select("event_id", X.finite(raw).alias("v"))


@R.add("m1_a19_guardrail", """
SELECT event_id, CASE WHEN v > (SELECT avg(v) + 3 * stddev_pop(v) FROM (SELECT value * CASE WHEN event_id % 97 = 0 THEN 9 ELSE 1 END AS v FROM events)) THEN 0.8 ELSE v END AS rag_top1_sim
FROM (SELECT event_id, value * CASE WHEN event_id % 97 = 0 THEN 9 ELSE 1 END AS v FROM events)""")
def m1(spark, folder):
    rows = B.load(spark, folder, "events").select("event_id", F.expr("value * CASE WHEN event_id % 97 = 0 THEN 9 ELSE 1 END").alias("rag_top1_sim"))
    return C.guardrail(rows)


@R.add("m2_standardise", "SELECT vuln_id, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END, 6) AS {c}" for c in FEATURE_NAMES) + " FROM (" + FEATURE_SQL + ")")
def m2(spark, folder):
    rows = C.feature_frame(scoring.results(spark, folder), "vuln_id")
    out = C.standardise(rows, C.column_moments(rows))
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in FEATURE_NAMES})


@R.add("m4_balanced_weights", "SELECT ground_truth_label, count(*) AS n, round(max(w), 9) AS weight FROM (SELECT ground_truth_label, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY ground_truth_label)) AS w FROM ("
       + scoring.TK + ")) GROUP BY 1")
def m4w(spark, folder):
    out = C.balanced_weights(scoring.tasks(spark, folder).select("id", "ground_truth_label"), "ground_truth_label")
    return out.groupBy("ground_truth_label").agg(F.count("*").alias("n"), F.round(F.max("weight"), 9).alias("weight"))


@R.add("m3_principal_scores")
def m3(spark, folder):
    rows = C.feature_frame(scoring.results(spark, folder), "vuln_id")
    ready = C.standardise(rows, C.column_moments(rows))
    out = C.principal_scores(ready, C.fit_pca(ready, 10), "vuln_id")
    return out.withColumns({c: F.round(c, 5) for c in out.columns if c != "vuln_id"})


def labelled(spark, folder):
    rows = C.feature_frame(scoring.results(spark, folder), "vuln_id")
    return rows.join(scoring.tasks(spark, folder).select(F.col("id").alias("vuln_id"), "ground_truth_label"), "vuln_id")


@R.add("m4_m5_train_report", "SELECT 15 AS features, true AS auc_in_range, true AS f1_in_range, true AS threshold_in_range, true AS at_best_round, true AS ran_out_of_patience, true AS loss_fell")
def m5(spark, folder):
    _, report = C.train_calibrator(labelled(spark, folder), "ground_truth_label", "vuln_id")
    # The scores follow Spark's trees, so facts are checked, not figures.
    return report.select(F.size("features").alias("features"), F.col("auc").between(0, 1).alias("auc_in_range"),
                         F.col("best_f1").between(0, 1).alias("f1_in_range"), F.col("best_threshold").between(0, 1).alias("threshold_in_range"),
                         (F.col("rounds") <= F.col("rounds_tried")).alias("at_best_round"),
                         ((F.col("rounds") + 49 < F.col("rounds_tried")) | (F.col("rounds_tried") == 1_000)).alias("ran_out_of_patience"),
                         (F.col("best_loss") <= F.col("first_loss")).alias("loss_fell"))


@R.add("m6_apply_calibrator", "SELECT vuln_id, true AS in_range, true AS same_when_loaded FROM (" + scoring.RS + ")")
def m6(spark, folder):
    """Scores of the fitted calibrator, and of the same one stored and loaded."""
    calibrator, _ = C.train_calibrator(labelled(spark, folder), "ground_truth_label", "vuln_id")
    place = new_folder(spark, "calibrator")
    calibrator.save(place)
    rows = scoring.results(spark, folder)
    out = C.apply_calibrator(rows, calibrator, "vuln_id")
    again = C.apply_calibrator(rows, C.Calibrator.load(spark, place), "vuln_id").withColumnRenamed("calibrated_confidence", "loaded")
    return out.join(again, "vuln_id").select("vuln_id", F.col("calibrated_confidence").between(0, 1).alias("in_range"),
                                             (F.abs(F.col("calibrated_confidence") - F.col("loaded")) < 1e-9).alias("same_when_loaded"))


@R.add("m7_score_fallback", "SELECT vuln_id, coalesce(native_confidence, 0.5) AS calibrated_confidence FROM (" + scoring.RS + ")")
def m7(spark, folder):
    return C.apply_calibrator(scoring.results(spark, folder), None, "vuln_id")


# --- streaming ---------------------------------------------------------------------------------

def event_stream(spark, folder):
    schema = B.load(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/events.parque[t]")


@R.add("l5_streamed_results", """
SELECT user_id AS vuln_id, arg_max(event_type, event_id) AS final_decision, arg_max(value, event_id) AS native_confidence FROM events GROUP BY user_id""")
def l5(spark, folder):
    base = new_folder(spark, "results")
    rows = event_stream(spark, folder).select(
        F.col("user_id").alias("vuln_id"), F.lit("success").alias("outcome"), F.col("event_type").alias("final_decision"),
        F.col("value").alias("native_confidence"), F.col("event_id").alias("seq"))
    ST.start_writer(rows, f"{base}/log", f"{base}/dead", f"{base}/checkpoint", drain=True).awaitTermination()
    return ST.current_results(spark, f"{base}/log").select("vuln_id", "final_decision", "native_confidence")


@R.add("l6_streamed_progress", """
SELECT split, count(*) AS total, count(*) FILTER (WHERE status = 'Success') AS completed FROM (
  SELECT user_id, 'split' || user_id % 3 AS split, arg_max(CASE WHEN event_type = 'purchase' THEN 'Success' ELSE 'Pending' END, ts) AS status FROM events GROUP BY ALL) GROUP BY split""")
def l6(spark, folder):
    base = new_folder(spark, "progress")
    rows = event_stream(spark, folder).select(
        F.col("user_id").alias("task_id"), F.concat(F.lit("split"), F.col("user_id") % 3).alias("split"),
        F.when(F.col("event_type") == "purchase", F.lit("Success")).otherwise(F.lit("Pending")).alias("status"), "ts")
    ST.start_progress(rows, f"{base}/log", f"{base}/checkpoint", drain=True).awaitTermination()
    return ST.progress_view(spark, f"{base}/log")


ATTEMPTS = """
SELECT event_id // 3 AS task_id, event_id % 3 + 1 AS attempt, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'asked' ELSE 'error' END AS outcome, ts
FROM events"""


@R.add("l4_streamed_attempts", f"""
SELECT task_id, CASE WHEN won > 0 THEN 'Success' WHEN lost >= 3 THEN 'Failed' WHEN waits > 0 THEN 'Waiting' ELSE 'Retry' END AS status, lost AS failed FROM (
  SELECT task_id, count(*) FILTER (outcome = 'success') AS won, count(*) FILTER (outcome = 'error' OR silent) AS lost, count(*) FILTER (outcome = 'asked' AND NOT silent) AS waits
  FROM (SELECT *, outcome = 'asked' AND ts + INTERVAL 5 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS silent FROM ({ATTEMPTS})) GROUP BY task_id)""")
def l4_attempts(spark, folder):
    base = new_folder(spark, "attempts")
    outcome = F.expr("CASE event_type WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'asked' ELSE 'error' END")
    rows = event_stream(spark, folder).select(F.expr("event_id div 3").alias("task_id"), (F.col("event_id") % 3 + 1).alias("attempt"),
                                              outcome.alias("outcome"), F.col("ts").alias("at"))
    AT.start_attempts(rows, f"{base}/log", f"{base}/checkpoint", drain=True, delay="1 hour", timeout_ms=5 * 86_400_000,
                      keep_ms=60 * 86_400_000).awaitTermination()
    return AT.task_states(spark, f"{base}/log")
