"""Table maintenance."""

import pytest

from codewarden.operators import static_facts as SF
from codewarden.operators import tables as T


def test_replace_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    once = T.replace_keyed(old, new, "id")
    twice = T.replace_keyed(once, new, "id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "B"), (3, "C")]


def test_write_results(spark):
    tasks = spark.createDataFrame([(1, "Pending"), (2, "Pending"), (3, "Failed")], "id int, status string")
    results = spark.createDataFrame([(1, "BENIGN"), (3, "BENIGN")], "vuln_id int, final_decision string")
    batch = spark.createDataFrame([(1, "fail", "Failed", None), (2, "success", "Success", "VULNERABLE")],
                                  "vuln_id int, outcome string, status string, final_decision string")
    new_tasks, new_results = T.write_results(tasks, results, batch, ["final_decision"])
    assert sorted(map(tuple, new_results.collect())) == [(2, "VULNERABLE"), (3, "BENIGN")]
    assert {r.id: r.status for r in new_tasks.collect()} == {1: "Failed", 2: "Success", 3: "Failed"}


def test_upsert_and_write_back_keep_nulls(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, v string, w int")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, v string")
    assert sorted(map(str, T.upsert(old, new, "id").collect())) == sorted(map(str, spark.createDataFrame(
        [(1, "a", 1), (2, None, 2), (3, "c", None)], "id int, v string, w int").collect()))
    back = {r.id: r.v for r in T.write_back(old, new, "id", "v").collect()}
    assert back == {1: "a", 2: None}


@pytest.mark.parametrize("mode, left", [("results_only", {"tasks": 2, "results": 0, "cache": 1, "kb": 1}),
                                        ("results_and_static", {"tasks": 2, "results": 0, "cache": 0, "kb": 1}),
                                        ("all_tasks", {"tasks": 0, "results": 0, "cache": 0, "kb": 1}),
                                        ("recreate", {"tasks": 0, "results": 0, "cache": 0, "kb": 0})])
def test_reset(spark, mode, left):
    tables = {"tasks": spark.createDataFrame([(1, "Success"), (2, "Failed")], "id int, status string"),
              "results": spark.range(1), "cache": spark.range(1), "kb": spark.range(1)}
    out = T.reset_tables(tables, mode)
    assert {n: f.count() for n, f in out.items()} == left
    assert {r.status for r in out["tasks"].collect()} <= {"Pending"}


def test_reset_unknown_mode(spark):
    with pytest.raises(ValueError):
        T.reset_tables({"tasks": spark.range(1), "results": spark.range(1), "cache": spark.range(1)}, "other")


def test_prefix_parity(spark):
    tasks = spark.createDataFrame([(1, "x_test_1", "x_test"), (2, "x_test2_1", "x_test2"), (3, "XAtest_9", "XAtest")], "id int, name string, split string")
    assert {r.id for r in T.in_split(tasks, "x_test").collect()} == {1}
    assert {r.id for r in T.in_split(tasks, "x_test", parity_like=True).collect()} == {1, 2, 3}


def test_work_list_order(spark):
    tasks = spark.createDataFrame([(i, f"s_{i}", "s", "Success" if i % 3 == 0 else "Failed") for i in range(20, 0, -1)], "id int, name string, split string, status string")
    ids = [i for i in range(1, 21) if i % 3]
    assert [r.id for r in T.work_list(tasks, "s", offset=3, limit=4).collect()] == ids[3:7]
    assert T.work_list(tasks, "s").count() == len(ids)


def test_static_facts_fuse(spark):
    tasks = spark.createDataFrame([(1, "t1", "memcpy(a)"), (2, "t2", "if (x) {}"), (3, "t3", ""), (4, "t4", "strcpy(q)")], "id int, name string, code string")
    facts = spark.createDataFrame([(1, 0, True, ["zz"]), (4, 9, False, None)], "task_id int, complexity int, has_data_flow boolean, apis array<string>")
    out = {r.id: r for r in SF.fuse_facts(tasks, facts).collect()}
    assert (out[1].source_type, out[1].has_data_flow, out[1].apis, out[1].complexity) == (2, True, ["memcpy", "zz"], 1)
    assert (out[2].source_type, out[2].analysis_mode, out[2].complexity, out[2].lexical_hit) == (1, "ast_fallback", 2, False)
    assert (out[4].analysis_mode, out[4].complexity, out[4].apis) == ("hybrid", 9, ["strcpy"])
    cache = SF.static_features(tasks, spark.createDataFrame([("t1",)], "task_name string"), facts)
    assert {r.task_name for r in cache.collect()} == {"t2", "t4"}  # t1 is cached, t3 has no text
    again = SF.decode_features(T.with_static_cache(tasks, cache))
    assert {r.id: (r.source_type, r.has_flow, r.complexity) for r in again.collect()}[4] == (2, False, 9)


def test_crashed_batches(spark):
    tasks = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")], "id int, batch string")
    facts = spark.createDataFrame([(3,)], "task_id int")
    assert [(r.batch, r.tasks) for r in SF.crashed_batches(tasks, facts, "batch").collect()] == [("a", 2)]
