"""Draws of the row bootstrap, made a column at a time, against one by one."""

import hashlib
from collections import Counter

import pytest

from codewarden.functions.draws import decimal_blocks, hashed_numbers
from codewarden.operators import metrics as M


def drawn(prefix, number):
    return int(hashlib.md5(f"{prefix}{number}".encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("low, high", [(0, 1_203), (99_990, 100_020), (10 ** 9 - 3, 10 ** 9 + 3)])
@pytest.mark.parametrize("prefix", ["42|7|1|", "42|100|-1|", "-9000000000|13|0|"])
def test_hashes_of_a_range(low, high, prefix):
    met = 0
    for first, digits in decimal_blocks(low, high):
        values = hashed_numbers(prefix, digits).tolist()
        assert values == [drawn(prefix, first + k) for k in range(len(values))]
        met += len(values)
    assert met == high - low


@pytest.mark.parametrize("positives", [70, 6, 5, 0])
def test_draws_are_counted_where_they_are_made(spark, monkeypatch, positives):
    monkeypatch.setattr(M, "CHUNK", 64)
    rows = [(int(i < positives), (i * 37 % 23) / 23) for i in range(400)]
    counts = M.score_counts(spark.createDataFrame(rows, "label int, score double"), "label", "score")
    made = M.bootstrap_by_rows(counts, 4, 11)
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()  # a draw is no row that is shuffled
    ordered = sorted(rows, key=lambda r: r[1])
    classes = {y: [r for r in ordered if r[0] == y] for y in (0, 1)}
    groups = {1: classes[1], 0: classes[0]} if positives > 5 else {-1: classes[0] + classes[1]}
    want = Counter()
    for g, members in groups.items():
        for r in range(1, 5):
            for slot in range(len(members)):
                y, s = members[drawn(f"11|{r}|{g}|", slot) % len(members)]
                want[r, s, y] += 1
    found = {(r["round"], r.score, y): r.pos if y else r.neg for r in made.collect() for y in (0, 1)}
    assert {k: n for k, n in found.items() if n} == dict(want)
    monkeypatch.setattr(M, "SHIPPED_SCORES", 0)
    joined = {(r["round"], r.score, y): r.pos if y else r.neg for r in M.bootstrap_by_rows(counts, 4, 11).collect() for y in (0, 1)}
    assert joined == found


def test_rounds_are_held_a_few_at_a_time(spark, monkeypatch):
    counts = M.score_counts(spark.createDataFrame([(i % 3 % 2, i / 90) for i in range(90)], "label int, score double"), "label", "score")
    every = M.bootstrap_by_rows(counts, 7, 5).collect()
    monkeypatch.setattr(M, "ROUNDS_HELD", 2)
    assert sorted(M.bootstrap_by_rows(counts, 7, 5).collect()) == sorted(every) and {r["round"] for r in every} == set(range(1, 8))


def test_no_rows_give_no_draws(spark):
    counts = M.score_counts(spark.createDataFrame([], "label int, score double"), "label", "score")
    assert M.bootstrap_by_rows(counts, 3, 1).collect() == []
