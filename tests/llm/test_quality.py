import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from llm import quality_classifier as C
from llm import quality_rules as R


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_plain_counts_equal_brute_force():
    rng = random.Random(4)
    texts = [None, "", " \n\n", "a a a a", "x y z x y z", "é é\né é\n\té é"] + [
        "".join(rng.choice(["a ", "b ", "é", "\n", "#", " ", "ab|", "\x0b", "\U0001f600 "]) for _ in range(rng.randrange(60))) for _ in range(200)]
    got = np.array(R.plain_counts(pa.array(texts, pa.string()))).T
    assert got.tolist() == [brute(t) for t in texts]


def corpus():
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        w = [(f"w{min(rng.randrange(400), rng.randrange(400))}" if good else f"w{rng.randrange(400)} |") for _ in range(rng.randrange(60, 90))]
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_rules_keep_trusted_text(docs_of, labels_of):
    rows, labels = corpus()
    got = {r.doc_id: r for r in R.judge(docs_of(rows), labels_of(labels[:200])).collect()}
    assert all(got[i].kept == (i % 4 != 0) for i in range(400))


def test_every_trusted_document_teaches(docs_of, labels_of):
    rows = [(i, f"w{i} common") for i in range(60)] + [(7, "again w7")]
    labels = labels_of([(i, 1, 0) for i in range(50)] + [(3, 1, 0), (55, 0, 0), (None, 1, 0)]).where("quality > 0")
    raw, target = np.zeros(R.BUCKETS), np.zeros(R.BUCKETS)
    for doc_id, text in rows:
        place, _ = R.features(pa.array([text]))
        np.add.at(raw, place, 1)
        np.add.at(target, place, doc_id < 50)
    want = np.log(target + R.PRIOR) - np.log(raw * (target.sum() / raw.sum()) + R.PRIOR)
    for block in (100, 7):
        assert np.allclose(R.multinomials(docs_of(rows), labels, block), want)


def test_classifier_held_out(docs_of, labels_of):
    rows, labels = corpus()
    got = C.score_documents(docs_of(rows), labels_of(labels)).collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.97


def test_odd_rows(odd, none, labels_of):
    labels = labels_of([(1, 1, 0), (1, 0, 0), (5, 0, 0), (None, 1, 0), (7, None, 0), (6, 1, 0)])
    for run in (R.judge, C.score_documents):
        assert run(odd, labels).count() == odd.count() and run(none, labels).count() == 0
        assert run(odd, labels.limit(0)).count() == odd.count()
    failed = {r.doc_id: r.base_failed for r in R.judge(odd, labels).collect()}
    assert failed[2] and failed[3] and failed[5] and failed[1]
