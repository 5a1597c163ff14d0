"""The audit run, calibration, and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from codewarden.functions.constants import FEATURE_NAMES
from codewarden.operators import metrics as M
from codewarden.plans import calibration as C
from codewarden.plans import evaluation as E
from codewarden.plans import inference as I
from codewarden.streaming import results as ST


def answer(decision, confidence=0.9):
    return json.dumps({"thought_process": "t", "final_decision": decision, "confidence": confidence})


@pytest.fixture(scope="module")
def run(spark):
    tasks = spark.createDataFrame([(1, "t1", "memcpy(a, b)"), (2, "t2", "x"), (3, "t3", "y"), (4, "t4", "z" * 13_000), (5, "t5", "w")], "id int, name string, code string")
    cache = spark.createDataFrame([("t1", 2, '{"has_flow":false,"complexity":3,"apis":["memcpy"]}'), ("t2", 1, '{"has_flow":true}')],
                                  "task_name string, source_type int, feature_json string")
    hits = spark.createDataFrame([(1, 1, "o1", "BENIGN", 0.8), (1, 2, "o2", "VULNERABLE", 0.6)], "qid int, rank int, original_id string, label string, similarity double")
    lp = [(-0.1,), (None,), (-0.2,)]
    low = [(-3.0,)]
    responses = spark.createDataFrame([
        (1, 1, answer("VULNERABLE"), lp), (1, 2, answer("BENIGN"), low),       # conflict, corrected
        (2, 1, answer("VULNERABLE"), low), (2, 2, answer("VULNERABLE"), low),  # weak, maintained, unreliable
        (3, 1, "garbage", lp), (4, 1, answer("VULNERABLE"), lp), (4, 2, answer("BENIGN"), lp)],
        "task_id int, round int, content string, logprobs array<struct<logprob:double>>")
    features = I.task_features(tasks, cache, hits)
    return features, responses, {r.vuln_id: r for r in I.finalise(features, responses).collect()}


def test_finalise(run):
    _, _, out = run
    assert (out[1].reason, out[1].reflected, out[1].final_decision) == ("Conflict", True, "BENIGN")
    assert (out[2].reason, out[2].final_decision, out[2].unreliable) == ("WeakCalibration", "VULNERABLE", True)
    assert (out[3].status, out[3].final_decision, out[3].cwe_id) == ("Success", "BENIGN", "Unknown")
    assert (out[4].reason, out[4].reflected, out[4].final_decision, out[4].feat_is_compressed) == (None, False, "VULNERABLE", True)
    assert (out[5].status, out[5].final_decision, out[5].calibrated_confidence) == ("Failed", None, None)
    assert out[1].feature_rag_similarity == pytest.approx(0.7) and out[1].feat_rag_sim_variance == pytest.approx(0.01)
    assert out[2].static_has_flow is False and out[1].feat_conflict_disagreement == 0.0
    assert out[1].native_confidence == pytest.approx(0.049787068)


def test_prompts_and_rebuttals(run):
    features, responses, _ = run
    prompts = I.make_prompts(features, few_shot="EXAMPLES")
    text = {r.id: r.prompt for r in prompts.collect()}
    assert "**CLEARED (No Flow Detected by Joern)**" in text[1] and "[Ref:o1 | Sim:80%] BENIGN\n[Ref:o2 | Sim:60%] VULNERABLE" in text[1]
    assert "STRONG CONSTRAINT" in text[1] and "No similar vulnerable samples" in text[2] and "EXAMPLES" in text[2]
    rebuttals = {r.id: r.prompt for r in I.make_rebuttals(I.score_round1(features, responses), prompts).collect()}
    assert set(rebuttals) == {1, 2} and rebuttals[1].startswith(text[1]) and "Probability: 0.86 (Low" in rebuttals[1]


def test_scorer_hook(run):
    features, responses, _ = run
    out = I.finalise(features, responses, scorer=lambda rows: rows.withColumn("score", F.lit(0.1))).where("vuln_id = 4").first()
    assert out.reason == "WeakCalibration" and out.final_decision == "BENIGN" and out.calibrated_confidence == 0.1


@pytest.fixture(scope="module")
def labelled(spark):
    rows = spark.range(1500).withColumn("label", (F.pmod(F.xxhash64("id"), F.lit(100)) < 30).cast("int"))
    noise = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0
    columns = {n: noise(i) + (F.col("label") * 0.6 if i % 3 == 0 else F.lit(0.0)) for i, n in enumerate(FEATURE_NAMES)}
    return rows.withColumns({**columns, "is_compressed": F.lit(0.0)})


def test_train_and_apply(spark, labelled, tmp_path):
    calibrator, report = C.train_calibrator(labelled, "label", "id", rounds=8)
    r = report.first()
    assert r.auc > 0.85 and 0 < r.best_threshold < 1 and len(r.features) == 15
    calibrator.save(str(tmp_path / "model"))
    again = C.Calibrator.load(spark, str(tmp_path / "model"))
    a, b = (c.score(labelled).select("id", "score").orderBy("id").collect() for c in (calibrator, again))
    assert [x.score for x in a] == pytest.approx([x.score for x in b])
    assert calibrator.score(labelled).columns == [*labelled.columns, "score"]


def test_train_needs_rows(labelled):
    with pytest.raises(ValueError):
        C.train_calibrator(labelled.limit(99), "label", "id")


def test_standardise_constant_column(labelled):
    out = C.standardise(labelled, C.column_moments(labelled))
    r = out.agg(F.avg("rag_var").alias("m"), F.stddev_pop("rag_var").alias("s"), F.max("is_compressed").alias("c")).first()
    assert r.m == pytest.approx(0, abs=1e-9) and r.s == pytest.approx(1) and r.c == 0.0


def test_principal_scores_have_fixed_signs(labelled):
    ready = C.standardise(labelled, C.column_moments(labelled))
    a = C.principal_scores(ready, C.fit_pca(ready, 3), "id").orderBy("id").limit(20).collect()
    b = C.principal_scores(ready.repartition(5), C.fit_pca(ready.repartition(5), 3), "id").orderBy("id").limit(20).collect()
    assert [r.pc_0 for r in a] == pytest.approx([r.pc_0 for r in b], abs=1e-6)


def test_guardrail_options(spark):
    rows = spark.createDataFrame([(0.1,)] * 50 + [(9.0,)], "rag_top1_sim double")
    assert C.guardrail(rows).agg(F.max("rag_top1_sim")).first()[0] == 0.8
    assert C.guardrail(rows, fit_on=rows.where("rag_top1_sim > 1")).agg(F.max("rag_top1_sim")).first()[0] == 9.0


def test_evaluate(spark):
    tasks = spark.createDataFrame([(1, "s_1", "s", 1, "CWE-1", "Success"), (2, "s_2", "s", 0, "N/A", "Success"), (3, "s_3", "s", 1, None, "Pending")],
                                  "id int, name string, split string, ground_truth_label int, cwe_id string, status string")
    results = spark.createDataFrame([(1, "VULNERABLE", 0.9), (2, "VULNERABLE", 0.2), (3, "BENIGN", 0.1)], "vuln_id int, final_decision string, calibrated_confidence double")
    out = E.evaluate(tasks, results, "s")
    assert tuple(out["confusion"].first()) == (1, 0, 0, 1) and out["auc"].first().auc == 1.0
    assert {r.metric: (r.baseline, r.calibrated) for r in out["comparison"].collect()}["accuracy"] == (0.5, 1.0)
    assert [(r.cwe, r.n) for r in out["groups"].collect()] == [("CWE-1", 1)]
    assert M.with_rates(E.evaluate(tasks, results, "s", threshold=0.95)["confusion"]).first().f1 == 0.0


SCHEMA = "vuln_id int, outcome string, status string, final_decision string, seq bigint"


def drop(folder, name, rows):
    (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r))) for r in rows))


def test_stream_equals_batch_after_restart(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    log, dead, check = (str(tmp_path / n) for n in ("log", "dead", "check"))

    def drain():
        ST.start_writer(ST.result_stream(spark, str(inbox), SCHEMA, 1), log, dead, check, drain=True).awaitTermination()

    drop(inbox, "a", [(1, "success", "Success", "BENIGN", 1), (2, "success", "Success", "BENIGN", 2)])
    drain()
    drop(inbox, "b", [(2, "success", "Success", "VULNERABLE", 3), (3, "success", "Success", "BENIGN", 4)])
    drop(inbox, "c", [(1, "fail", "Failed", None, 5)])
    drain()
    drain()  # nothing new
    got = {r.vuln_id: r.final_decision for r in ST.current_results(spark, log).collect()}
    assert got == {2: "VULNERABLE", 3: "BENIGN"}
    assert spark.read.parquet(log).count() == 5
    tasks = spark.createDataFrame([(i, "Pending") for i in (1, 2, 3, 4)], "id int, status string")
    results = spark.createDataFrame([(1, "BENIGN"), (4, "BENIGN")], "vuln_id int, final_decision string")
    new_tasks, new_results = ST.fold_log(tasks, results, spark.read.parquet(log), ["final_decision"])
    assert {r.vuln_id: r.final_decision for r in new_results.collect()} == {2: "VULNERABLE", 3: "BENIGN", 4: "BENIGN"}
    assert {r.id: r.status for r in new_tasks.collect()} == {1: "Failed", 2: "Success", 3: "Success", 4: "Pending"}


def test_dead_letters(spark, tmp_path):
    (tmp_path / "log").write_text("a file where the log should be")
    batch = spark.createDataFrame([(1, "success", "Success", "BENIGN", 1), (2, "fail", "Failed", None, 2)], SCHEMA)
    sink = ST.write_batch(str(tmp_path / "log"), str(tmp_path / "dead"))
    sink(batch, 7)
    sink(batch, 7)
    kept = spark.read.schema(SCHEMA).json(f"{tmp_path}/dead/batch_id=7")
    assert [r.vuln_id for r in kept.collect()] == [1]


def test_batch_written_twice_stays_once(spark, tmp_path):
    batch = spark.createDataFrame([(1, "success", "Success", "BENIGN", 1)], SCHEMA)
    sink = ST.write_batch(str(tmp_path / "log"), str(tmp_path / "dead"))
    sink(batch, 3)
    sink(batch, 3)
    sink(batch, 4)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2 and ST.current_results(spark, str(tmp_path / "log")).count() == 1


def test_stored_threshold_is_used_unless_one_is_given(spark):
    from codewarden.plans import evaluation as E

    joined = spark.createDataFrame([(1, "BENIGN", 0.4, "x")], "ground_truth_label int, final_decision string, calibrated_confidence double, task_cwe string")
    meta = spark.createDataFrame([(0.3,)], "best_threshold double")
    assert [E.scored_rows(joined, t, m).first().cal_pred for t, m in ((None, None), (None, meta), (0.5, meta))] == [0, 1, 0]


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    import pytest

    from codewarden.session import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(fake)


def test_batch_is_evaluated_once_though_its_write_fails(spark, tmp_path):
    """The second evaluation of this plan would fail; the dead letters still get every successful row."""
    (tmp_path / "log").write_text("a file where the log should be")
    mark = str(tmp_path / "evaluated")

    def once(batches):
        import os

        if os.path.exists(mark):
            raise RuntimeError("evaluated again")
        open(mark, "w").close()
        yield from batches

    rows = spark.createDataFrame([(1, "success", "Success", "BENIGN", 1), (2, "fail", "Failed", None, 2), (3, "success", "Success", None, 3)], SCHEMA)
    batch = rows.coalesce(1).mapInPandas(once, SCHEMA)
    ST.write_batch(str(tmp_path / "log"), str(tmp_path / "dead"))(batch, 0)
    kept = spark.read.schema(SCHEMA).json(f"{tmp_path}/dead/batch_id=0")
    assert sorted(r.vuln_id for r in kept.collect()) == [1, 3]
    assert not (tmp_path / "log.staged" / "batch_id=0").exists()


def test_batch_that_comes_again_is_kept_once(spark, tmp_path):
    """First the log fails and the letters hold the batch; after the restart the log has it and the letters go."""
    log = tmp_path / "log"
    log.write_text("a file where the log should be")
    batch = spark.createDataFrame([(1, "success", "Success", "BENIGN", 1), (2, "fail", "Failed", None, 2)], SCHEMA)
    sink = ST.write_batch(str(log), str(tmp_path / "dead"))
    sink(batch, 4)
    assert (tmp_path / "dead" / "batch_id=4").exists()
    log.unlink()
    sink(batch, 4)
    sink(batch, 4)
    assert sorted(r.vuln_id for r in spark.read.parquet(str(log)).collect()) == [1, 2]
    assert not (tmp_path / "dead" / "batch_id=4").exists()
