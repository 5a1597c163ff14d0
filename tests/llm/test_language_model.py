import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm import hashed
from llm import language_model as L

END, BEGIN, UNKNOWN = "</s>", "<s>", "<unk>"


def split(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", folded), END]


def teaches(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 != 1


class Brute:
    """The model by dictionaries of word tuples."""

    def __init__(self, texts, order):
        self.order, self.words = order, Counter(w for t in texts for w in split(t))
        self.total, self.types = sum(self.words.values()), len(self.words)
        counts = Counter()
        for t in texts:
            w = [BEGIN] * (order - 1) + split(t)
            counts.update(tuple(w[i:i + order]) for i in range(len(w) - order + 1))
        self.levels = {}
        for size in range(order, 0, -1):
            seen = Counter(counts.values())
            d = {0: 0, 1: 0.5, 2: 1.0, 3: 1.5}
            if all(seen[i] for i in (1, 2, 3, 4)):
                y = seen[1] / (seen[1] + 2 * seen[2])
                own = {0: 0, **{i: i - (i + 1) * y * seen[i + 1] / seen[i] for i in (1, 2, 3)}}
                d = own if all(0 < own[i] <= i for i in (1, 2, 3)) else d
            totals, taken = Counter(), defaultdict(float)
            for g, n in counts.items():
                totals[g[:-1]] += n
                taken[g[:-1]] += d[min(n, 3)]
            self.levels[size] = counts, totals, taken, d
            counts = Counter(g[1:] for g in counts)

    def p(self, gram):
        if not gram:
            return 1 / (self.types + 1)
        counts, totals, taken, d = self.levels[len(gram)]
        lower = self.p(gram[1:])
        if gram[:-1] not in totals:
            return lower
        n = counts[gram]
        return (max(n - d[min(n, 3)], 0) + taken[gram[:-1]] * lower) / totals[gram[:-1]]

    def row(self, doc_id, text):
        own = split(text)
        known = [w if w in self.words else UNKNOWN for w in own]
        w = [BEGIN] * (self.order - 1) + known
        score = sum(math.log10(self.p(tuple(w[i:i + self.order]))) for i in range(len(own)))
        base = sum(math.log10((self.words[x] + 0.5) / (self.total + 0.5 * (self.types + 1))) for x in own)
        return doc_id, not teaches(doc_id), len(own), sum(x in self.words for x in own), self.total, base, score


def corpus(n):
    rng = random.Random(n)
    base = ["a", "B", "é", "the", "Of", "x y", "l" * 300, *[f"w{i}" for i in range(40)]]
    rows = []
    for i in range(n):
        size = rng.randrange(0, 40)
        rows.append((i, " ".join(base[min(int(rng.expovariate(0.2)), len(base) - 1)] + ("z" * (rng.random() < 0.02)) for _ in range(size)).replace(" w1 ", "\t\r\nw1\x0b")))
    return rows + [(7, None), (8, ""), (9, rows[3][1]), (9, rows[3][1]), (None, "a the B unusual"), (11, " \n ")]


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


@pytest.mark.parametrize("order,shard_bytes", [(2, hashed.SHARD_BYTES), (2, 400), (3, 3000), (4, 3000)])
def test_against_brute_force(docs_of, order, shard_bytes):
    rows = corpus(120)
    got = [tuple(r) for r in L.scored(docs_of(rows).repartition(4), order, shard_bytes).select(*NAMES).collect()]
    model = Brute([t for i, t in rows if teaches(i)], order)
    want = [model.row(i, t) for i, t in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_probabilities_add_up(docs_of):
    """After every context the known words and one unknown share the whole mass."""
    rows = corpus(60)
    model = L.train(docs_of(rows), 3, 2000)
    try:
        every = np.concatenate([np.arange(model.types), [model.unknown]])
        for context in [(model.begin, model.begin), (model.begin, 0), (0, 1), (3, 2), (model.unknown, 4), (5, model.unknown)]:
            grams = np.column_stack([np.full(len(every), context[0]), np.full(len(every), context[1]), every])
            p = model.probabilities(grams)
            assert (p > 0).all() and p.sum() == pytest.approx(1, abs=1e-9)
    finally:
        model.remove()


def test_better_than_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = L.scored(docs).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert r["s"] > 0.9 * r["b"]


def test_odd_and_empty(odd, none):
    assert L.scored(none).count() == 0
    got = {(r["doc_id"], r["n_tokens"], r["held_out"]) for r in L.scored(odd).collect()}
    assert (2, 1, not teaches(2)) in got and (5, 30_001, not teaches(5)) in got and (None, 6, False) in got


def test_nothing_to_learn_from(docs_of):
    """Only a held-out text: every token has probability 1."""
    one = next(i for i in range(99) if not teaches(i))
    r = L.scored(docs_of([(one, "a b")])).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)


def test_needs_a_mounted_folder(spark, monkeypatch):
    monkeypatch.setattr(hashed, "shared_folder", lambda _: "hdfs://host/folder")
    with pytest.raises(ValueError, match="mounted"):
        hashed.mounted_folder(spark, "x")
    assert L.discounts([0, 1, 1, 1]).tolist() == [0, 0.5, 1.0, 1.5]
