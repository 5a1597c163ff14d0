"""Task states from streamed attempts, against a plain reading of the whole set of events."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row

from codewarden.streaming import attempts as A

SCHEMA = "task_id long, attempt int, outcome string, at timestamp"
START = dt.datetime(2024, 1, 1)


def feed(spark, folder, number, events):
    rows = [(t, a, o, None if m is None else START + dt.timedelta(minutes=m)) for t, a, o, m in events]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{number}")


def states(spark, folder, **settings):
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    A.start_attempts(stream, f"{folder}/log", f"{folder}/checkpoint", drain=True, timeout_ms=600_000, **settings).awaitTermination()
    return {r.task_id: (r.status, r.failed) for r in A.task_states(spark, f"{folder}/log").collect()}


def plain(events, watermark, timeout=10):
    """Outcome by attempt, the strongest counts; times in minutes."""
    tasks = {}
    for task, attempt, outcome, at in events:
        best = tasks.setdefault(task, {})
        best[attempt] = max(best.get(attempt, (-1, 0)), (A.RANKS[outcome], at))
    out = {}
    for task, found in tasks.items():
        ranks = [1 if rank == 0 and at + timeout <= watermark else rank for rank, at in found.values()]
        lost = sum(r in (1, 2) for r in ranks)
        out[task] = ("Success" if 3 in ranks else "Failed" if lost >= 3 else "Waiting" if 0 in ranks else "Retry", lost)
    return out


def test_each_way_a_task_can_end(spark, tmp_path):
    feed(spark, tmp_path, 0, [(1, 1, "asked", 0), (1, 1, "success", 1), (2, 1, "error", 0), (3, 1, "error", 0), (3, 2, "error", 1),
                              (3, 3, "error", 2), (4, 1, "asked", 0), (5, 1, "error", 0), (5, 2, "error", 0), (5, 3, "asked", 1),
                              (6, 1, "asked", 299), (7, 1, "other", 1), (None, 1, "error", 1), (8, None, "error", 1), (9, 1, "error", None),
                              (2, 1, "error", 0), (10, 1, "asked", 300)])
    assert states(spark, str(tmp_path)) == {1: ("Success", 0), 2: ("Retry", 1), 3: ("Failed", 3), 4: ("Retry", 1), 5: ("Failed", 3),
                                          6: ("Waiting", 0), 10: ("Waiting", 0)}


def test_a_late_answer_and_a_restart(spark, tmp_path):
    feed(spark, tmp_path, 0, [(1, 1, "asked", 0), (2, 1, "asked", 0), (3, 1, "error", 290), (99, 1, "success", 300)])
    assert states(spark, str(tmp_path)) == {1: ("Retry", 1), 2: ("Retry", 1), 3: ("Retry", 1), 99: ("Success", 0)}
    feed(spark, tmp_path, 1, [(1, 1, "success", 295), (3, 1, "error", 290), (3, 2, "success", 301), (2, 2, "asked", 5)])
    # The last row is older than the watermark and dropped.
    assert states(spark, str(tmp_path)) == {1: ("Success", 0), 2: ("Retry", 1), 3: ("Success", 1), 99: ("Success", 0)}
    assert states(spark, str(tmp_path))[1] == ("Success", 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_and_repeats(spark, tmp_path, seed):
    dice = random.Random(seed)
    events = [(dice.randrange(60), dice.randrange(1, 4), dice.choice(["asked", "asked", "error", "success"]), dice.randrange(200)) for _ in range(200)]
    events.append((1_000, 1, "success", 200))
    given = events + dice.sample(events, 50)
    dice.shuffle(given)
    for number in range(3):
        feed(spark, tmp_path, number, given[number::3])
    assert states(spark, str(tmp_path), delay="200 minutes") == plain(events, 0)


def test_state_goes_after_the_time_it_is_kept(spark, tmp_path):
    feed(spark, tmp_path, 0, [(1, 1, "error", 0), (2, 1, "success", 5_000)])
    states(spark, str(tmp_path), keep_ms=1_200_000)
    feed(spark, tmp_path, 1, [(1, 2, "error", 5_001), (2, 2, "success", 10_000)])
    assert states(spark, str(tmp_path), keep_ms=1_200_000)[1] == ("Retry", 1)


class Calls:
    """A state store of one task that counts the messages to it."""

    def __init__(self):
        self.calls, self.kept, self.timers = 0, None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.kept

    def update(self, value):
        self.calls += 1
        self.kept = value

    def clear(self):
        self.calls += 1
        self.kept = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


def test_a_task_takes_few_messages():
    store, told = Calls(), A.Attempts(3, 100, 1_000)
    told.init(store)
    events = [Row(attempt=n, outcome=o, millis=10 * n) for n in range(1, 9) for o in ("asked", "error", "asked")]
    assert [r.status for r in told.handleInputRows((1,), iter(events), None)] == ["Failed"]
    assert store.calls <= 2 + 9 and max(store.timers) == 80 + 1_000  # one read, one write, a timer for each attempt and one for the task
    before = store.calls
    assert list(told.handleInputRows((1,), iter(events), None)) == [] and store.calls == before + 1  # nothing new is not written
    asked = Calls()
    told.init(asked)
    assert [r.status for r in told.handleInputRows((2,), iter(events[:1]), None)] == ["Waiting"] and asked.calls == 4
    expiry = type("Expiry", (), {"getExpiryTimeInMs": lambda self: 110})()
    assert [(r.status, r.failed) for r in told.handleExpiredTimer((2,), None, expiry)] == [("Retry", 1)]
