"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from codewarden.operators import normalize as N
from codewarden.sources import records as S
from codewarden.sources import store
from codewarden.sources.tool_results import read_tool_results


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.jsonl").write_text('\n{"func":"x","target":1,"commit_id":"c1"}\n\nnot json\n{"func":"y","target":0}\n{"func":"  ","target":1}\n')
    (tmp_path / "b.json").write_text('  [{"code":"z","label":"1","cwe":["CWE-9"]},{"code":"w"}]')
    (tmp_path / "c.json").write_text('[{"code":"broken"')
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "d.jsonl").write_text('{"k":1}\n\n{"k":2}\n')
    return str(tmp_path)


def test_read_jsonl_splits_good_and_bad(spark, folder):
    good, bad = S.read_jsonl(spark, f"{folder}/a.jsonl")
    assert good.count() == 3 and [r.line for r in bad.collect()] == ["not json"]


def test_read_typed_jsonl_keeps_corrupt_lines(spark, folder):
    rows = S.read_typed_jsonl(spark, f"{folder}/a.jsonl", "func string, target string").collect()
    assert len(rows) == 4 and [r._corrupt_record for r in rows if r._corrupt_record] == ["not json"]


def test_physical_line_numbers_count_blanks(spark, folder):
    rows = S.read_lines_numbered(spark, f"{folder}/a.jsonl").orderBy("line_index").collect()
    assert [r.line_index for r in rows] == list(range(6)) and rows[3].line == "not json"


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} {i} {'x' * (i % 50)}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = S.read_lines_numbered(spark, str(tmp_path))
        assert rows.where(F.split("line", " ")[1].cast("bigint") != F.col("line_index")).count() == 0
        assert rows.count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_record_numbers_skip_bad_lines(spark, folder):
    lines = S.read_lines_numbered(spark, f"{folder}/a.jsonl")
    rows = S.number_records(lines, F.try_parse_json("line")).orderBy("row_index").collect()
    assert [(r.row_index, r.line_index) for r in rows] == [(0, 1), (1, 4), (2, 5)]


def test_json_array_and_error(spark, folder, tmp_path):
    assert [r.row_index for r in S.read_json_array(spark, f"{folder}/b.json").orderBy("row_index").collect()] == [0, 1]
    (tmp_path / "o.json").write_text('{"a":1}')
    with pytest.raises(Exception, match="no JSON list"):
        S.read_json_array(spark, str(tmp_path / "o.json")).collect()


def test_kb_folder_sniffs_kinds(spark, folder):
    rows = {(r.file_name, r.row_index) for r in S.read_kb_folder(spark, folder).collect()}
    assert rows == {("a.jsonl", 0), ("a.jsonl", 1), ("a.jsonl", 2), ("b.json", 0), ("b.json", 1)}
    out = N.kb_candidates(S.read_kb_folder(spark, folder))
    kept = {r.original_id: (r.label, r.cwe_id) for r in out.where("NOT skip").collect()}
    assert kept["a.jsonl_0_c1"] == ("VULNERABLE", "N/A") and kept["b.json_0_unk"] == ("VULNERABLE", "CWE-9") and "b.json_1_unk" not in kept


def test_read_tree(spark, folder):
    assert S.read_tree(spark, folder).where(F.col("file_path").endswith("d.jsonl")).count() == 2


def test_write_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("é", None)], "a string, b int")
    S.write_jsonl(rows, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert json.loads(text) == {"a": "é", "b": None} and "é" in text


def test_import_is_idempotent(spark, folder):
    lines = S.read_lines_numbered(spark, f"{folder}/a.jsonl")
    records = lines.select("line_index", F.try_parse_json("line").alias("record")).where("record IS NOT NULL")
    tasks = N.import_tasks(records, "val")
    assert {r.name for r in tasks.collect()} == {"val_c1_1", "val_unk_4", "val_unk_5"}
    assert N.new_tasks(tasks, tasks).count() == 0


def test_tool_results_last_row_wins(spark, tmp_path):
    rows = [{"filename": "/s/7.c", "apis": ["b", "a", "a"], "complexity": 3, "has_data_flow": True},
            {"filename": "/s/7.c", "apis": None, "complexity": None}, {"error": "x"}, {"filename": "/s/8.h", "apis": []},
            {"filename": "/s/9.c", "apis": ["q", "q"], "complexity": "5", "has_data_flow": 1}]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    got = {r.task_id: (r.complexity, r.has_data_flow, r.apis) for r in read_tool_results(spark, str(tmp_path / "r.json")).collect()}
    assert got == {7: (0, False, []), 9: (5, True, ["q"])}


def test_meta(spark, tmp_path):
    path = str(tmp_path / "meta")
    assert store.stored_threshold(store.read_meta(spark, path)).first().threshold == 0.5
    store.write_meta(spark.createDataFrame([(0.37, 0.8, 0.9)], "best_threshold double, best_f1 double, auc double"), path)
    assert store.stored_threshold(store.read_meta(spark, path)).first().threshold == 0.37
    merged = store.merge_meta(store.read_meta(spark, path), agent_threshold_p10=0.2)
    store.write_meta(merged, str(tmp_path / "meta2"))
    row = store.read_meta(spark, str(tmp_path / "meta2")).first()
    assert (row.best_threshold, row.agent_threshold_p10) == (0.37, 0.2)


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, split string")
    store.write_partitions(rows, path, "split")
    store.write_partitions(spark.createDataFrame([(3, "b")], "id int, split string"), path, "split")
    assert {(r.id, r.split) for r in store.read_table(spark, path).collect()} == {(1, "a"), (3, "b")}
    assert store.read_table(spark, str(tmp_path / "none"), "id int").count() == 0
