"""Metrics, thresholds, evaluation, table maintenance."""

import uuid
from functools import reduce

from pyspark.sql import functions as F

from checks import bind as B
from codewarden.functions import features as X
from codewarden.operators import metrics as M
from codewarden.operators import pages as G
from codewarden.operators import keyed as K
from codewarden.operators import tables as T
from codewarden.plans import evaluation as E
from codewarden.session import shared_folder

R = B.Registry()
SC, TK, RS = B.sql(B.SCORED), B.sql(B.TASKS), B.sql(B.RESULTS)


def scored(spark, folder):
    return B.bind(spark, folder, B.SCORED)


def tasks(spark, folder):
    return B.bind(spark, folder, B.TASKS)


def results(spark, folder):
    return B.bind(spark, folder, B.RESULTS)


# --- selection and joins -----------------------------------------------------------------------

@R.add("s9_t7_work_list", f"SELECT id FROM ({TK}) WHERE split = 'split1' AND status IN ('Pending', 'Failed') ORDER BY id LIMIT 400 OFFSET 50")
def s9(spark, folder):
    return T.work_list(tasks(spark, folder), "split1", offset=50, limit=400)


PAGES = 8


@R.add("s9_t7_work_pages", f"""
SELECT id, place, place // size AS page FROM (
  SELECT id, row_number() OVER (ORDER BY id) - 1 AS place, CAST(ceil(count(*) OVER () / {PAGES}.0) AS BIGINT) AS size
  FROM ({TK}) WHERE split = 'split1' AND status IN ('Pending', 'Failed'))""")
def s9_pages(spark, folder):
    stored = f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
    G.store_pages(T.work_list(tasks(spark, folder), "split1"), "id", stored)
    size = max(1, -(-G.page_total(spark, stored) // PAGES))
    read = [G.read_page(spark, stored, "id", n * size, size).withColumn("page", F.lit(n).cast("long")) for n in range(PAGES)]
    return reduce(lambda a, b: a.unionByName(b), read)


@R.add("f3_f4_l7_resume", f"SELECT id FROM ({TK}) WHERE split = 'split2' AND status IN ('Pending', 'Failed')")
def f4(spark, folder):
    return T.work_list(tasks(spark, folder), "split2")


@R.add("f3_prefix_parity", f"SELECT split, count(*) AS n FROM ({TK}) WHERE name ILIKE 'SPLIT__1%' GROUP BY 1")
def f3(spark, folder):
    return T.in_split(tasks(spark, folder), "SPLIT__1", parity_like=True).groupBy("split").agg(F.count("*").alias("n"))


@R.add("s11_fetch_by_key", f"SELECT id, name FROM ({TK}) WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def s11(spark, folder):
    keys = B.load(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return T.fetch_by_key(tasks(spark, folder), keys, "id").select("id", "name")


CACHED = "SELECT concat('split', substr(o_orderpriority, 1, 1), '_', CAST(o_custkey AS STRING), '_', CAST(o_orderkey AS STRING)) AS task_name, CAST(o_custkey % 2 + 1 AS INT) AS source_type, o_orderstatus AS feature_json FROM {orders} WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} WHERE l_returnflag = 'A')"
CQ = B.sql(CACHED)


@R.add("j2_tasks_with_cache", f"SELECT t.id, coalesce(c.source_type, 0) AS source_type, c.feature_json FROM ({TK}) t LEFT JOIN ({CQ}) c ON c.task_name = t.name")
def j2(spark, folder):
    return T.with_static_cache(tasks(spark, folder), B.bind(spark, folder, CACHED)).select("id", "source_type", "feature_json")


@R.add("j3_f6_uncached_tasks", f"SELECT id FROM (SELECT *, CASE WHEN id % 10 = 0 THEN '' ELSE name END AS code FROM ({TK})) t WHERE code <> '' AND NOT EXISTS (SELECT 1 FROM ({CQ}) c WHERE c.task_name = t.name)")
def j3(spark, folder):
    rows = tasks(spark, folder).withColumn("code", F.expr("CASE WHEN id % 10 = 0 THEN '' ELSE name END"))
    return T.uncached(rows, B.bind(spark, folder, CACHED)).select("id")


@R.add("j1_finished_results", f"SELECT r.vuln_id, t.ground_truth_label, t.cwe_id AS task_cwe, r.final_decision, r.calibrated_confidence FROM ({RS}) r JOIN ({TK}) t ON r.vuln_id = t.id WHERE t.split = 'split1' AND t.status = 'Success'")
def j1(spark, folder):
    return E.finished(tasks(spark, folder), results(spark, folder), "split1").select(
        "vuln_id", "ground_truth_label", "task_cwe", "final_decision", "calibrated_confidence")


# --- writes ------------------------------------------------------------------------------------

BATCH = """
SELECT l_orderkey AS vuln_id, CASE WHEN min(l_tax) < 0.03 THEN 'success' ELSE 'fail' END AS outcome,
       CASE WHEN min(l_tax) < 0.03 THEN 'Success' ELSE 'Failed' END AS status, 'BENIGN' AS final_decision,
       round(max(l_tax), 2) AS native_confidence
FROM {lineitem} WHERE l_returnflag = 'N' GROUP BY l_orderkey"""
BQ = B.sql(BATCH)
OLD = f"(SELECT vuln_id, final_decision, native_confidence FROM ({B.RESULTS}) WHERE final_decision = 'VULNERABLE')"
OQ = B.sql(OLD)


@R.add("k4_write_results", f"""
SELECT * FROM {OQ} o WHERE NOT EXISTS (SELECT 1 FROM ({BQ}) b WHERE b.vuln_id = o.vuln_id)
UNION ALL SELECT vuln_id, final_decision, native_confidence FROM ({BQ}) WHERE outcome = 'success'""")
def k4(spark, folder):
    _, out = T.write_results(tasks(spark, folder), B.bind(spark, folder, f"SELECT * FROM {OLD}"), B.bind(spark, folder, BATCH),
                             ["final_decision", "native_confidence"])
    return out


@R.add("k4_task_status", f"SELECT t.id, coalesce(b.status, t.status) AS status FROM ({TK}) t LEFT JOIN ({BQ}) b ON b.vuln_id = t.id")
def k4s(spark, folder):
    out, _ = T.write_results(tasks(spark, folder), B.bind(spark, folder, f"SELECT * FROM {OLD}"), B.bind(spark, folder, BATCH),
                             ["final_decision", "native_confidence"])
    return out.select("id", "status")


BATCH_MANY = f"""
SELECT l_orderkey AS vuln_id, {B.ROW_ID} AS seq, CASE WHEN l_tax < 0.03 THEN 'success' ELSE 'fail' END AS outcome,
       CASE WHEN l_tax < 0.03 THEN 'Success' ELSE 'Failed' END AS status, l_linestatus AS final_decision, l_tax AS native_confidence
FROM {{lineitem}} WHERE l_returnflag = 'N'"""
LAST = f"(SELECT vuln_id, max(seq) AS seq, arg_max(outcome, seq) AS outcome, arg_max(final_decision, seq) AS final_decision, arg_max(native_confidence, seq) AS native_confidence FROM ({B.sql(BATCH_MANY)}) GROUP BY vuln_id)"


@R.add("k4_last_result_of_a_task", f"""
SELECT * FROM {OQ} o WHERE NOT EXISTS (SELECT 1 FROM {LAST} b WHERE b.vuln_id = o.vuln_id)
UNION ALL SELECT vuln_id, final_decision, native_confidence FROM {LAST} WHERE outcome = 'success'""")
def k4l(spark, folder):
    _, out = T.write_results(tasks(spark, folder), B.bind(spark, folder, f"SELECT * FROM {OLD}"), B.bind(spark, folder, BATCH_MANY),
                             ["final_decision", "native_confidence"], order="seq")
    return out


@R.add("k4_replace_twice", f"""
SELECT * FROM {OQ} o WHERE NOT EXISTS (SELECT 1 FROM ({BQ}) b WHERE b.vuln_id = o.vuln_id)
UNION ALL SELECT vuln_id, final_decision, native_confidence FROM ({BQ})""")
def k4t(spark, folder):
    new = B.bind(spark, folder, BATCH).select("vuln_id", "final_decision", "native_confidence")
    once = T.replace_keyed(B.bind(spark, folder, f"SELECT * FROM {OLD}"), new, "vuln_id")
    return T.replace_keyed(once, new, "vuln_id")


@R.add("k6_cache_upsert", f"""
SELECT coalesce(o.vuln_id, b.vuln_id) AS vuln_id, CASE WHEN b.vuln_id IS NOT NULL THEN b.native_confidence ELSE o.native_confidence END AS native_confidence,
  o.final_decision
FROM {OQ} o FULL JOIN ({BQ}) b ON o.vuln_id = b.vuln_id""")
def k6(spark, folder):
    new = B.bind(spark, folder, BATCH).select("vuln_id", "native_confidence")
    return T.upsert(B.bind(spark, folder, f"SELECT * FROM {OLD}"), new, "vuln_id")


@R.add("k7_j13_write_back", f"SELECT o.vuln_id, o.final_decision, CASE WHEN b.vuln_id IS NULL THEN o.native_confidence ELSE b.native_confidence END AS native_confidence FROM {OQ} o LEFT JOIN ({BQ}) b USING (vuln_id)")
def k7(spark, folder):
    return T.write_back(B.bind(spark, folder, f"SELECT * FROM {OLD}"), B.bind(spark, folder, BATCH), "vuln_id", "native_confidence")


def stored_old(spark, folder):
    place = f"{shared_folder(spark)}/keyed-{uuid.uuid4().hex}"
    K.store(B.bind(spark, folder, f"SELECT * FROM {OLD}"), "vuln_id", place)
    return place


@R.add("k4_keyed_replace", f"""
SELECT * FROM {OQ} o WHERE NOT EXISTS (SELECT 1 FROM ({BQ}) b WHERE b.vuln_id = o.vuln_id)
UNION ALL SELECT vuln_id, final_decision, native_confidence FROM ({BQ})""")
def k4_keyed(spark, folder):
    """Folded in twice, as after a restart."""
    place, new = stored_old(spark, folder), B.bind(spark, folder, BATCH).select("vuln_id", "final_decision", "native_confidence")
    K.replace(spark, place, new)
    K.replace(spark, place, new)
    return K.read(spark, place)


@R.add("k6_keyed_merge", f"""
SELECT coalesce(o.vuln_id, b.vuln_id) AS vuln_id, CASE WHEN b.vuln_id IS NOT NULL THEN b.native_confidence ELSE o.native_confidence END AS native_confidence,
  o.final_decision
FROM {OQ} o FULL JOIN ({BQ}) b ON o.vuln_id = b.vuln_id""")
def k6_keyed(spark, folder):
    place = stored_old(spark, folder)
    K.merge(spark, place, B.bind(spark, folder, BATCH).select("vuln_id", "native_confidence"))
    return K.read(spark, place)


@R.add("k7_keyed_column", f"SELECT o.vuln_id, o.final_decision, CASE WHEN b.vuln_id IS NULL THEN o.native_confidence ELSE b.native_confidence END AS native_confidence FROM {OQ} o LEFT JOIN ({BQ}) b USING (vuln_id)")
def k7_keyed(spark, folder):
    place = stored_old(spark, folder)
    K.set_column(spark, place, B.bind(spark, folder, BATCH), "native_confidence")
    return K.read(spark, place)


@R.add("k8_reset_tables", f"SELECT 'tasks' AS name, status, count(*) AS n FROM (SELECT 'Pending' AS status FROM ({TK})) GROUP BY ALL UNION ALL SELECT 'cache', 'kept', count(*) FROM ({CQ})")
def k8(spark, folder):
    out = T.reset_tables({"tasks": tasks(spark, folder), "results": results(spark, folder), "cache": B.bind(spark, folder, CACHED),
                          "kb": B.load(spark, folder, "documents")}, "results_only")
    counted = out["tasks"].groupBy("status").agg(F.count("*").alias("n")).select(F.lit("tasks").alias("name"), "status", "n")
    cache = out["cache"].agg(F.count("*").alias("n")).select(F.lit("cache").alias("name"), F.lit("kept").alias("status"), "n")
    gone = out["results"].groupBy().agg(F.count("*").alias("n")).where("n > 0").select(F.lit("results").alias("name"), F.lit("left").alias("status"), "n")
    return counted.unionByName(cache).unionByName(gone)


@R.add("u2_set_difference", "SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def u2(spark, folder):
    used = B.load(spark, folder, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("id"))
    return B.load(spark, folder, "orders").select(F.col("o_orderkey").alias("id")).join(used, "id", "left_anti").distinct()


@R.add("w6_latest_per_key", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def w6(spark, folder):
    rows = B.load(spark, folder, "events").select("user_id", "event_id", "event_type", "value")
    return T.latest_per_key(rows, "user_id", "event_id").select("user_id", "event_type", "value")


# --- counts ------------------------------------------------------------------------------------

@R.add("a4_l6_progress", f"SELECT split, count(*) AS total, count(*) FILTER (WHERE status = 'Success') AS completed FROM ({TK}) GROUP BY split")
def a4(spark, folder):
    return T.progress(tasks(spark, folder))


RUNS = f"SELECT t.status, t.id % 3 AS source_type, t.id % 4 = 1 AS reflected, r.final_decision FROM ({B.TASKS}) t JOIN ({B.RESULTS}) r ON r.vuln_id = t.id"


@R.add("a5_run_report", f"""
SELECT count(*) AS processed, count(*) FILTER (WHERE status = 'Success') AS succeeded, count(*) FILTER (WHERE status <> 'Success') AS failed,
  count(*) FILTER (WHERE status = 'Success' AND reflected AND final_decision = 'BENIGN') AS corrected,
  count(*) FILTER (WHERE status = 'Success' AND reflected AND final_decision = 'VULNERABLE') AS maintained,
  count(*) FILTER (WHERE source_type = 2) AS from_dataflow, count(*) FILTER (WHERE source_type = 1) AS from_lexical,
  count(*) FILTER (WHERE source_type = 0) AS from_none FROM ({B.sql(RUNS)})""")
def a5(spark, folder):
    return T.run_report(B.bind(spark, folder, RUNS))


@R.add("a6_class_distribution", f"SELECT count(*) AS total, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg, avg(label) AS pos_ratio FROM ({SC})")
def a6(spark, folder):
    return M.class_distribution(scored(spark, folder), "label")


@R.add("a20_integrity", """
SELECT (SELECT count(*) FROM documents) AS rows_left, (SELECT count(*) FROM labels) AS rows_right,
  (SELECT count(DISTINCT doc_id) FROM documents) AS ids_left, (SELECT count(DISTINCT doc_id) FROM labels) AS ids_right,
  NOT EXISTS ((SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS intact""")
def a20(spark, folder):
    return T.integrity(B.load(spark, folder, "documents"), B.load(spark, folder, "labels"), "doc_id")


@R.add("a20_id_list_md5", """
SELECT md5(string_agg(d, '' ORDER BY b)) AS ids_md5 FROM (
  SELECT substr(md5(vec_id::VARCHAR), 1, 3) AS b, md5(string_agg(vec_id, '' ORDER BY vec_id)) AS d FROM embeddings GROUP BY 1)""")
def a20m(spark, folder):
    return T.id_list_md5(B.load(spark, folder, "embeddings"), "vec_id")


@R.add("a23_distinct_counts", f"SELECT count(DISTINCT grp) AS groups, count(DISTINCT label) AS classes FROM ({SC})")
def a23(spark, folder):
    return scored(spark, folder).agg(F.count_distinct("grp").alias("groups"), F.count_distinct("label").alias("classes"))


# --- metrics -----------------------------------------------------------------------------------

@R.add("p43_decision_encode", f"""
SELECT vuln_id, CASE WHEN final_decision = 'VULNERABLE' THEN 1 ELSE 0 END AS raw_pred, coalesce(calibrated_confidence, 0) AS score,
  CASE WHEN coalesce(calibrated_confidence, 0) >= 0.5 THEN 1 ELSE 0 END AS cal_pred,
  CASE WHEN t.cwe_id IS NULL OR upper(t.cwe_id) = 'N/A' THEN 'Other' ELSE t.cwe_id END AS cwe
FROM ({RS}) r JOIN ({TK}) t ON r.vuln_id = t.id""")
def p43(spark, folder):
    joined = results(spark, folder).join(tasks(spark, folder).select(F.col("id").alias("vuln_id"), F.col("cwe_id").alias("c")), "vuln_id")
    score = F.coalesce("calibrated_confidence", F.lit(0.0))
    return joined.select("vuln_id", X.decision_flag(F.col("final_decision")).alias("raw_pred"), score.alias("score"),
                         X.predicted(score, 0.5).alias("cal_pred"), X.cwe_or_other(F.col("c")).alias("cwe"))


COUNTS = "count(*) FILTER (WHERE label = 0 AND {p} = 0) AS tn, count(*) FILTER (WHERE label = 0 AND {p} = 1) AS fp, count(*) FILTER (WHERE label = 1 AND {p} = 0) AS fn, count(*) FILTER (WHERE label = 1 AND {p} = 1) AS tp"
RATES = "(tp + tn) / (tn + fp + fn + tp) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"


@R.add("a10_a11_confusion_by_group", f"SELECT *, {RATES} FROM (SELECT grp, {COUNTS.format(p='raw_pred')} FROM ({SC}) GROUP BY grp)")
def a10(spark, folder):
    return M.with_rates(M.confusion(scored(spark, folder), "label", "raw_pred", ["grp"]))


def auc_sql(score: str, source: str = SC, label: str = "label") -> str:
    return f"""(WITH g AS (SELECT {score} AS s, count(*) FILTER (WHERE {label} = 1) AS p, count(*) FILTER (WHERE {label} = 0) AS n FROM ({source}) GROUP BY 1),
  r AS (SELECT *, sum(n) OVER (ORDER BY s) - n AS below FROM g)
  SELECT sum(p * (below + n / 2.0)) / (sum(p) * 1.0 * sum(n)) AS auc FROM r)"""


@R.add("a12_roc_auc_ties", f"SELECT round(auc, 9) AS auc FROM {auc_sql('score')}")
def a12(spark, folder):
    return M.roc_auc(scored(spark, folder), "label", "score").select(F.round("auc", 9).alias("auc"))


@R.add("a12_roc_auc_fine", f"SELECT round(auc, 9) AS auc FROM {auc_sql('fine_score')}")
def a12f(spark, folder):
    return M.roc_auc(scored(spark, folder), "label", "fine_score").select(F.round("auc", 9).alias("auc"))


@R.add("a12_one_class", f"SELECT CASE WHEN count(DISTINCT label) < 2 THEN 0.5 END AS auc FROM ({SC}) WHERE label = 1")
def a12o(spark, folder):
    return M.roc_auc(scored(spark, folder).where("label = 1"), "label", "score")


def curve_sql(score: str, source: str = SC, label: str = "label") -> str:
    return f"""(WITH g AS (SELECT {score} AS s, count(*) FILTER (WHERE {label} = 1) AS p, count(*) FILTER (WHERE {label} = 0) AS n FROM ({source}) GROUP BY 1),
  r AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS pp FROM g)
  SELECT s AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, tp / (tp + fp) AS precision, coalesce(tp / nullif(pp, 0), 0) AS recall FROM r)"""


@R.add("a13_w3_precision_recall", f"SELECT threshold, tp, fp, round(precision, 9) AS precision, round(recall, 9) AS recall FROM {curve_sql('fine_score')}")
def a13(spark, folder):
    curve = M.precision_recall(M.score_counts(scored(spark, folder), "label", "fine_score"))
    return curve.withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)})


def best_sql(curve: str, padded: bool, by: str = "") -> str:
    f1 = "2 * precision * recall / (precision + recall + 1e-10)" if padded else "coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)"
    part = f"PARTITION BY {by} " if by else ""
    return f"""(SELECT * FROM (SELECT *, {f1} AS f1, row_number() OVER ({part}ORDER BY round({f1}, 12) DESC, threshold) AS k FROM {curve}) WHERE k = 1)"""


@R.add("a14_best_f1_report", f"SELECT threshold, round(f1, 9) AS f1 FROM {best_sql(curve_sql('fine_score'), True)}")
def a14(spark, folder):
    curve = M.precision_recall(M.score_counts(scored(spark, folder), "label", "fine_score"))
    return M.best_f1(curve, padded=True).select("threshold", F.round("f1", 9).alias("f1"))


@R.add("a14_best_f1_tuner", f"SELECT threshold, round(f1, 9) AS f1 FROM {best_sql(curve_sql('score'), False)}")
def a14t(spark, folder):
    curve = M.precision_recall(M.score_counts(scored(spark, folder), "label", "score"))
    return M.best_f1(curve).select("threshold", F.round("f1", 9).alias("f1"))


def draws_sql(source: str, label: str, score: str, rounds: int, seed: int) -> str:
    """Best threshold per round from hashed draws (more than five positives)."""
    return f"""(
  WITH base AS (SELECT CASE WHEN {label} = 1 THEN 1 ELSE 0 END AS y, {score} AS s FROM ({source})),
  ranked AS MATERIALIZED (SELECT y, s, row_number() OVER (PARTITION BY y ORDER BY s) - 1 AS slot, count(*) OVER (PARTITION BY y) AS size FROM base),
  draws AS (SELECT b.r AS round, y, ('0x' || substr(md5('{seed}|' || b.r || '|' || y || '|' || slot), 1, 15))::BIGINT % size AS slot
            FROM ranked, (SELECT unnest(range(1, {rounds} + 1)) AS r) b),
  g AS (SELECT d.round, k.s, count(*) FILTER (WHERE k.y = 1) AS p, count(*) FILTER (WHERE k.y = 0) AS n
        FROM draws d JOIN ranked k ON k.y = d.y AND k.slot = d.slot GROUP BY ALL),
  c AS (SELECT round, s AS threshold, sum(p) OVER (PARTITION BY round ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY round ORDER BY s DESC) AS fp,
               sum(p) OVER (PARTITION BY round) AS pp FROM g),
  pr AS (SELECT round, threshold, tp / (tp + fp) AS precision, tp / pp AS recall FROM c)
  SELECT round, threshold, f1 FROM {best_sql('pr', False, 'round')})"""


JOINED = f"SELECT t.ground_truth_label, r.* FROM ({RS}) r JOIN ({TK}) t ON r.vuln_id = t.id WHERE t.split = 'split1' AND t.status = 'Success'"
ROUNDS = 100


@R.add("a15_g7_bootstrap_rounds", f"SELECT round, threshold, round(f1, 9) AS f1 FROM {draws_sql(SC, 'label', 'score', 100, 42)}")
def a15(spark, folder):
    return M.bootstrap_thresholds(scored(spark, folder), "label", "score", 100, 42, "rows").withColumn("f1", F.round("f1", 9))


@R.add("m8_bootstrap_threshold", f"""
WITH b AS (SELECT * FROM {draws_sql(JOINED, 'ground_truth_label', 'coalesce(calibrated_confidence, 0)', ROUNDS, 42)}),
s AS (SELECT count(*) AS rounds, avg(threshold) AS threshold, stddev_pop(threshold) AS deviation,
             quantile_cont(threshold, 0.025) AS ci_low, quantile_cont(threshold, 0.975) AS ci_high FROM b),
c AS (SELECT {COUNTS.format(p='pred')} FROM (SELECT ground_truth_label AS label, CASE WHEN coalesce(calibrated_confidence, 0) >= s.threshold THEN 1 ELSE 0 END AS pred FROM ({JOINED}), s))
SELECT rounds, round(threshold, 9) AS threshold, round(deviation, 9) AS deviation, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high,
       tn, fp, fn, tp, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1
FROM s, (SELECT *, {RATES} FROM c)""")
def m8(spark, folder):
    out = E.tune(tasks(spark, folder), results(spark, folder), "split1", ROUNDS, 42, "rows")
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.withColumns({c: F.round(c, 9) for c in doubles})


@R.add("m8_bootstrap_threshold_counts")
def m8c(spark, folder):
    return E.tune(tasks(spark, folder), results(spark, folder), "split1", 100, 42, "counts")


@R.add("f5_a16_m9_tp_confidence", f"""
SELECT count(*) AS n, min(x) AS min, max(x) AS max, round(avg(x), 9) AS mean, quantile_cont(x, 0.5) AS median, round(quantile_cont(x, 0.1), 9) AS pk
FROM (SELECT native_confidence AS x FROM ({JOINED}) WHERE ground_truth_label = 1 AND final_decision = 'VULNERABLE' AND native_confidence IS NOT NULL)""")
def m9(spark, folder):
    return E.tp_confidence_percentile(tasks(spark, folder), results(spark, folder), "split1").withColumns(
        {"mean": F.round("mean", 9), "pk": F.round("pk", 9)})


@R.add("a16_exact_quantiles_fine", f"SELECT round(quantile_cont(fine_score, 0.25), 9) AS q25, round(quantile_cont(fine_score, 0.5), 9) AS q50, round(quantile_cont(fine_score, 0.9), 9) AS q90 FROM ({SC})")
def a16(spark, folder):
    out = M.exact_quantiles(scored(spark, folder), "fine_score", {"q25": 0.25, "q50": 0.5, "q90": 0.9})
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


CAL = f"SELECT *, CASE WHEN score >= 0.05 THEN 1 ELSE 0 END AS cal_pred FROM ({SC})"


@R.add("a17_top_groups", f"SELECT grp, count(*) AS n, round(avg(raw_pred), 9) AS raw_recall, round(avg(cal_pred), 9) AS calibrated_recall FROM ({CAL}) WHERE label = 1 GROUP BY grp ORDER BY n DESC, grp LIMIT 10")
def a17(spark, folder):
    rows = scored(spark, folder).withColumn("cal_pred", X.predicted(F.col("score"), 0.05))
    return M.top_groups(rows, "label", "grp", "raw_pred", "cal_pred").withColumns(
        {c: F.round(c, 9) for c in ("raw_recall", "calibrated_recall")})


def comparison_sql(source: str, raw: str, cal: str) -> str:
    one = lambda side, p: f"(SELECT '{side}' AS side, {RATES} FROM (SELECT {COUNTS.format(p=p)} FROM ({source})))"
    return f"""(SELECT metric, max(value) FILTER (WHERE side = 'baseline') AS baseline, max(value) FILTER (WHERE side = 'calibrated') AS calibrated
  FROM (UNPIVOT (SELECT * FROM {one('baseline', raw)} UNION ALL SELECT * FROM {one('calibrated', cal)}) ON accuracy, precision, recall, f1 INTO NAME metric VALUE value) GROUP BY metric)"""


@R.add("a18_comparison", f"SELECT metric, round(baseline, 9) AS baseline, round(calibrated, 9) AS calibrated, round(calibrated - baseline, 9) AS delta FROM {comparison_sql(CAL, 'raw_pred', 'cal_pred')}")
def a18(spark, folder):
    rows = scored(spark, folder).withColumn("cal_pred", X.predicted(F.col("score"), 0.05))
    return M.comparison(rows, "label", "raw_pred", "cal_pred").withColumns(
        {c: F.round(c, 9) for c in ("baseline", "calibrated", "delta")})


EVAL = f"""SELECT ground_truth_label AS label, CASE WHEN final_decision = 'VULNERABLE' THEN 1 ELSE 0 END AS raw_pred, coalesce(calibrated_confidence, 0) AS score,
  CASE WHEN coalesce(calibrated_confidence, 0) >= 0.6 THEN 1 ELSE 0 END AS cal_pred,
  CASE WHEN cwe_id IS NULL OR upper(cwe_id) = 'N/A' THEN 'Other' ELSE cwe_id END AS cwe
FROM (SELECT t.ground_truth_label, t.cwe_id, r.final_decision, r.calibrated_confidence FROM ({RS}) r JOIN ({TK}) t ON r.vuln_id = t.id WHERE t.status = 'Success' AND t.split = 'split1')"""


@R.add("m10_evaluation_report", f"""
WITH rows_ AS MATERIALIZED ({EVAL})
SELECT 'metric' AS section, metric AS item, round(baseline, 9) AS baseline, round(calibrated, 9) AS calibrated FROM {comparison_sql('SELECT * FROM rows_', 'raw_pred', 'cal_pred')}
UNION ALL SELECT 'metric', 'auc', NULL, round(auc, 9) FROM {auc_sql('score', 'SELECT * FROM rows_')}
UNION ALL SELECT 'confusion', item, NULL, n FROM (UNPIVOT (SELECT {COUNTS.format(p='cal_pred')} FROM rows_) ON tn, fp, fn, tp INTO NAME item VALUE n)
UNION ALL SELECT * FROM (SELECT 'group', cwe || ':' || count(*), round(avg(raw_pred), 9), round(avg(cal_pred), 9) FROM rows_ WHERE label = 1 GROUP BY cwe ORDER BY count(*) DESC, cwe LIMIT 10)""")
def m10(spark, folder):
    rows = E.scored_rows(E.finished(tasks(spark, folder), results(spark, folder), "split1"), 0.6)
    return E.evaluation_report(rows).withColumns({c: F.round(c, 9) for c in ("baseline", "calibrated")})
