"""Keyed tables by bucket."""

import os

from codewarden.operators import keyed as K


def files(folder):
    return {os.path.join(at, f) for at, _, names in os.walk(f"{folder}/rows") for f in names if f.endswith(".parquet")}


def rows(spark, folder):
    return sorted((tuple(r) for r in K.read(spark, folder).collect()), key=str)


def stored(spark, tmp_path, n=500):
    K.store(spark.range(n).selectExpr("id", "concat('v', id) AS v", "CAST(id AS double) AS w"), "id", str(tmp_path), buckets=16)
    return str(tmp_path)


def test_only_touched_buckets_are_written(spark, tmp_path):
    folder = stored(spark, tmp_path)
    before = files(folder)
    touched = K.replace(spark, folder, spark.createDataFrame([(3, "new", 0.0), (700, "more", 1.0)], "id long, v string, w double"))
    after = files(folder)
    changed = {p.split("_bucket=")[1].split("/")[0] for p in before ^ after}
    assert 1 <= len(touched) <= 2 and changed == {str(b) for b in touched} and len(before & after) >= 14
    found = dict((r[0], r[1]) for r in rows(spark, folder))
    assert len(found) == 501 and found[3] == "new" and found[700] == "more" and found[4] == "v4"


def test_folding_twice_changes_nothing(spark, tmp_path):
    folder = stored(spark, tmp_path, 50)
    batch = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 2.0, 2), (60, None, None, 1)], "id long, v string, w double, seq int")
    K.merge(spark, folder, batch, "seq")
    once = rows(spark, folder)
    K.merge(spark, folder, batch, "seq")
    assert rows(spark, folder) == once and (1, "b", 2.0) in once and (60, None, None) in once and len(once) == 51


def test_columns_that_do_not_come_in_stay(spark, tmp_path):
    folder = stored(spark, tmp_path, 20)
    K.merge(spark, folder, spark.createDataFrame([(2, "x")], "id long, v string"))
    K.set_column(spark, folder, spark.createDataFrame([(5, 9.5), (99, 1.0)], "id long, w double"), "w")
    found = rows(spark, folder)
    assert (2, "x", 2.0) in found and (5, "v5", 9.5) in found and len(found) == 20


def test_null_keys_empty_tables_and_batches(spark, tmp_path):
    none = spark.createDataFrame([], "id long, v string")
    K.store(none, "id", str(tmp_path), buckets=4)
    assert rows(spark, str(tmp_path)) == [] and K.replace(spark, str(tmp_path), none) == []
    K.replace(spark, str(tmp_path), spark.createDataFrame([(None, "n"), (1, "a"), (1, "b")], "id long, v string"))
    assert rows(spark, str(tmp_path)) == [(1, "a"), (1, "b"), (None, "n")]
    K.replace(spark, str(tmp_path), spark.createDataFrame([(1, "c")], "id long, v string"))
    assert rows(spark, str(tmp_path)) == [(1, "c"), (None, "n")]
