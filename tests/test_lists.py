"""JSON lists cut into pieces, against the standard parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from codewarden.sources.lists import list_items

BAD = ["", "[", "]", "{}", '{"a":1}', '[{"a":1}', '[{"a":1},]', '[,{"a":1}]', '[{"a":1}] {"b":2}', '[{"a":1} {"b":2}]', '[{"a":1}, [1]], {"b":2}',
       '[{"a":"]}', '[{"a":[1]}', '[{"a":1}]]', '[{"a":1}},{"b":2}]', '[{"a":1}, \\" {"b":2}]', '[{"a":}]', "[ , ]"]
GOOD = ["[]", " [ ]\n", "[null]", '[1,"}",[2,{"x":"]"}],{"a":{"b":{}}},"\\"}{",3]', '[{"a":"\\\\"},{"b":"\\\\\\"}"}]',
        '[\r\n {"a": "x\\ny"} ,\n {"b": [{"c": "}"}]}\n]\n', '[[{"a":1},{"b":2}],[[]],{}]', '[{}, {}, {}, []]']


def expected(text):
    try:
        value = json.loads(text)
    except ValueError:
        return []
    return value if isinstance(value, list) else []


def read(spark, folder):
    rows = list_items(spark, str(folder)).select("file_name", "row_index", F.to_json("record").alias("record")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r.row_index):
        out.setdefault(r.file_name, []).append((r.row_index, json.loads(r.record)))
    return out


def check(spark, folder, texts):
    for i, text in enumerate(texts):
        (folder / f"{i}.json").write_bytes(text.encode())
    want = {f"{i}.json": list(enumerate(expected(t))) for i, t in enumerate(texts) if expected(t)}
    assert read(spark, folder) == want


def test_good_and_bad_lists(spark, tmp_path):
    check(spark, tmp_path, GOOD + BAD)


def any_value(dice, depth):
    kind = dice.randrange(7 if depth else 4)
    if kind < 4:
        return [dice.randrange(100), None, True, "".join(dice.choice('ab{}[]",:\\\n\té') for _ in range(dice.randrange(12)))][kind]
    if kind == 4:
        return [any_value(dice, depth - 1) for _ in range(dice.randrange(4))]
    return {dice.choice('k{"]}') + str(i): any_value(dice, depth - 1) for i in range(dice.randrange(4))}


def test_random_lists_over_many_splits(spark, tmp_path):
    dice, old = random.Random(7), spark.conf.get("spark.sql.files.maxPartitionBytes")
    texts = [json.dumps([any_value(dice, 3) for _ in range(n)], indent=dice.choice([None, 1]), ensure_ascii=dice.random() < 0.5)
             for n in (1, 5, 40, 300, 2_000)]
    texts += [texts[3][:-1], texts[3].replace('"', "", 1)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        check(spark, tmp_path, texts)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_one_list_is_read_by_many_tasks(spark, tmp_path):
    rows = [{"id": i, "text": "} { \" \\ " * (i % 9)} for i in range(30_000)]
    (tmp_path / "one.json").write_text(json.dumps(rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        found = list_items(spark, str(tmp_path)).select(
            "row_index", F.try_variant_get("record", "$.id", "long").alias("id"), F.try_variant_get("record", "$.text", "string").alias("text"))
        assert found.count() == 30_000 and found.where("row_index <> id").count() == 0
        assert found.where("length(text) <> 8 * (id % 9)").count() == 0
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_strict(spark, tmp_path):
    (tmp_path / "o.json").write_text('[{"a":1}')
    with pytest.raises(Exception, match="no JSON list: o.json"):
        list_items(spark, str(tmp_path), strict=True).collect()
