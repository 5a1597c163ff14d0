import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import toxicity as T


@given(st.lists(st.integers(-4, 5), max_size=18))
@settings(max_examples=300, deadline=None)
def test_segments_are_the_maximal_ones(scores):
    """Recursive definition: the best segment (shortest on ties), then those left and right of it."""
    x = np.array(scores, dtype=float)

    def best(low, high):
        found = [(x[a:b].sum(), -(b - a), -a, b) for a in range(low, high) for b in range(a + 1, high + 1)]
        top = max(found, default=(0,))
        if top[0] <= 0:
            return []
        a, b = -top[2], top[3]
        return [*best(low, a), (a, b, top[0]), *best(b, high)]

    got = T.segments(x)
    assert [(a, b) for a, b, _ in got] == sorted((a, b) for a, b, _ in got)
    assert sum(s for *_, s in got) == sum(s for *_, s in best(0, len(x)))
    assert max([0, *(s for *_, s in got)]) == max([0, *(s for *_, s in best(0, len(x)))])


def corpus():
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        w = [f"w{min(rng.randrange(300), rng.randrange(300))}" for _ in range(rng.randrange(20, 80))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vilemo", "vilesse", "scumly"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(docs_of, labels_of):
    rows, labels = corpus()
    got = T.score_documents(docs_of(rows), labels_of(labels)).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 600 and 80 < len(held) < 160
    assert np.mean([r.predicted == (r.doc_id % 8 == 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.passages for r in got if r.predicted)


def test_odd_rows(odd, none, labels_of):
    rows, labels = [], [(1, 1, 1), (1, 1, 0), (2, 0, 1), (None, 1, 1), (3, 1, None)]
    got = T.score_documents(odd, labels_of(labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert T.score_documents(none, labels_of(labels)).count() == 0
    assert all(r.predicted == 0 for r in T.score_documents(odd, labels_of(rows)).collect())


def test_rare_vocabulary_of_one_language_is_found(docs_of, labels_of):
    """Toxic words that stand in few labelled documents each, as those of a language with few labels."""
    rng = random.Random(3)
    rows, labels, rare = [], [], set()
    for i in range(1500):
        w = [f"w{min(rng.randrange(300), rng.randrange(300))}" for _ in range(rng.randrange(20, 60))]
        kind = i % 10
        if kind == 0:
            w[5:5] = ["vilemo", "vilesse", "scumly"]
        elif kind == 1:
            w[5:5] = rng.sample([f"achl{c}xen" for c in "abcdefghijklmnopqrst"], 3)
            rare.add(i)
        elif kind < 6:
            w[5:5] = [f"achl{rng.choice('abcdefghijklmnopqrst').upper()}y{rng.randrange(9)}"]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(kind < 2)))
    held = [r for r in T.score_documents(docs_of(rows), labels_of(labels)).collect() if r.held_out]
    assert np.mean([r.predicted for r in held if r.doc_id in rare]) > 0.8
    assert np.mean([r.predicted for r in held if r.doc_id % 10 > 1]) < 0.03


def test_decay_without_overflow():
    for best in (0.5, 3.0, 11.0):
        for seen in ([10, 0], [399, 1], [0, 399]):
            counted = np.zeros(T.SCORE_BINS, dtype=np.int64)
            counted[seen] = 1_000
            with np.errstate(all="raise"):
                assert 0 < T.decay(counted, best) <= T.MOST_DECAY


def test_more_evidence_never_scores_less(docs_of, labels_of):
    rows = [(i, ("vile " * (1 + i // 2) if i % 2 else "kind ") + "plain words of any text here " * 8) for i in range(400)]
    got = T.score_documents(docs_of(rows), labels_of([(i, 0, i % 2) for i in range(400)])).collect()
    by = sorted((r.evidence, r.score) for r in got)
    assert all(a[1] <= b[1] for a, b in zip(by, by[1:])) and all(r.predicted == r.doc_id % 2 for r in got if r.held_out)
