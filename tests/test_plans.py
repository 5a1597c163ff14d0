"""What the planner makes of the operators."""

import re

from pyspark.sql import functions as F

from codewarden.functions import static_facts as S
from codewarden.operators import metrics as M
from codewarden.operators import normalize as N
from codewarden.operators import sampling as G
from codewarden.operators import tables as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_splits_and_records_need_no_shuffle(spark):
    rows = spark.createDataFrame([("c", "f")], "commit_id string, func string")
    assert "Exchange" not in plan(G.split_by_commit(rows))
    raw = spark.createDataFrame([('{"func":"f"}',)], "t string").select(F.parse_json("t").alias("record"))
    for job in (N.normalize_diversevul, N.normalize_vcl, N.normalize_devign, N.unpivot_fixes):
        assert "Exchange" not in plan(job(raw))


def test_a_record_is_parsed_once(spark):
    raw = spark.createDataFrame([('{"func":"f","target":1}', 0)], "t string, line_index int")
    from codewarden.functions.once import pin
    tasks = N.import_tasks(pin(raw, {"record": F.try_parse_json("t")}), "s").where("ground_truth_label = 1")
    assert len(re.findall("parseJson", plan(tasks))) == 1 and tasks.count() == 1


def test_work_list_is_pushed_into_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s_1", "s", "Failed", "code"), (2, "s_2", "t", "Success", "code")],
                                 "id int, name string, split string, status string, code string")
    rows.write.parquet(str(tmp_path / "tasks"))
    text = plan(T.work_list(spark.read.parquet(str(tmp_path / "tasks")), "s"))
    assert "EqualTo(split,s)" in text and "In(status" in text
    assert "code" not in re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)


def test_partitions_are_pruned(spark, tmp_path):
    rows = spark.createDataFrame([(1, "n", "s", "Failed"), (2, "n", "t", "Failed")], "id int, name string, split string, status string")
    rows.write.partitionBy("split").parquet(str(tmp_path / "tasks"))
    assert "PartitionFilters: [isnotnull(split" in plan(T.work_list(spark.read.parquet(str(tmp_path / "tasks")), "s"))


def test_no_window_over_one_partition_of_rows(spark):
    scored = spark.range(5000).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") / 5000).alias("score"))
    text = plan(M.precision_recall(M.score_counts(scored, "label", "score")))
    local = [line for line in text.splitlines() if "Window [" in line and "score" in line]
    assert local and all("_bucket" in line for line in local)


def test_lexical_scan_is_one_projection(spark):
    rows = spark.createDataFrame([("memcpy(x)",)], "code string").select(S.names_used(F.col("code")))
    assert "Exchange" not in plan(rows) and "Python" not in plan(rows)


def test_hot_stratum_is_ranked_in_many_buckets(spark):
    rows = spark.range(60_000).select("id", F.lit("same").alias("func"), F.lit("p").alias("project"), F.lit("hot").alias("cwe"))
    sample = G.stratified_sample(rows, 5000, 1, "id", ["id", "func", "project", "cwe"])
    assert sample.count() == 5000
    from codewarden.operators.ordering import lowest_hashes, seeded_hash
    keyed = rows.withColumn("h", seeded_hash(1, F.col("id")))
    quota = spark.createDataFrame([("hot", 5000)], "cwe string, take bigint")
    text = plan(lowest_hashes(keyed, ["cwe"], quota, "id", "h"))
    ranks = [line for line in text.splitlines() if "Window [row_number()" in line]
    assert ranks and all("_bucket" in line for line in ranks)


def test_boosting_stops_by_patience_and_keeps_its_best_round(spark):
    """Labels with noise: the hold-out loss turns, the run goes on for the patience, and the trees after the best round go."""
    import random

    from pyspark.ml.linalg import Vectors

    from codewarden.plans import calibration as C

    rng = random.Random(5)
    rows = []
    for i in range(400):
        x = [rng.gauss(0, 1) for _ in range(3)]
        rows.append((Vectors.dense(x), float((x[0] > 0) != (rng.random() < 0.3)), 1.0, i % 5 == 0))
    ready = spark.createDataFrame(rows, ["pca", "label", "weight", "is_val"])
    model, losses = C.boost(ready, rounds=40, patience=4)
    best = min(range(len(losses)), key=losses.__getitem__)
    assert model.getNumTrees == best + 1 and (best + 4 < len(losses) or len(losses) == 40)
    assert losses[best] < losses[0]
    again = model.evaluateEachIteration(ready.where("is_val"))
    assert len(again) == best + 1 and abs(again[-1] - losses[best]) < 1e-9
    scored = model.transform(ready.where("is_val")).select("label", "prediction").collect()
    assert sum(r.label == r.prediction for r in scored) > 0.55 * len(scored)


def test_boosting_goes_on_while_it_gains(spark):
    """Labels that the features decide: a run cut at a few rounds is taken up again with twice as many."""
    from pyspark.ml.linalg import Vectors

    from codewarden.plans import calibration as C

    rows = [(Vectors.dense([float(i % 17), float(i % 5)]), float(i % 17 > 8), 1.0, i % 4 == 0) for i in range(200)]
    model, losses = C.boost(spark.createDataFrame(rows, ["pca", "label", "weight", "is_val"]), rounds=18, patience=1)
    assert len(losses) == 18 == model.getNumTrees and losses == sorted(losses, reverse=True)


def test_losses_of_all_rounds_take_one_pass(spark, monkeypatch):
    """The losses are Spark's own, weights counted, without a pass over the hold-out for each round."""
    import random

    from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
    from pyspark.ml.linalg import Vectors

    from codewarden.plans import calibration as C

    rng = random.Random(7)
    rows = [(Vectors.dense([rng.gauss(0, 1) for _ in range(3)]), float(rng.random() < 0.4), 0.5 + i % 3, i % 4 == 0) for i in range(300)]
    ready = spark.createDataFrame(rows, ["pca", "label", "weight", "is_val"])
    held = ready.where("is_val")
    model = GBTClassifier(featuresCol="pca", weightCol="weight", maxIter=12, stepSize=0.1, maxDepth=4, seed=3).fit(ready)
    want = model.evaluateEachIteration(held)
    monkeypatch.setattr(GBTClassificationModel, "evaluateEachIteration", lambda *_: 1 / 0)
    assert max(abs(a - b) for a, b in zip(C.round_losses(model, held), want, strict=True)) < 1e-9
    assert C.boost(ready, rounds=6, patience=2)[0].getLeafCol() == ""


def test_training_computes_its_rows_once(spark):
    from codewarden.functions.constants import FEATURE_NAMES
    from codewarden.plans import calibration as C

    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(200, numPartitions=2).selectExpr("id", "CAST(id % 3 = 0 AS INT) AS label", *[f"rand({k}) AS {c}" for k, c in enumerate(FEATURE_NAMES)])
    C.train_calibrator(rows.mapInArrow(run, rows.schema), "label", "id", rounds=2)
    assert seen.value == 200
