import hashlib
import random
import re

from llm import decontaminate as D


def brute(text, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())  # noqa: E731  ASCII only here
    w, hit, found = word(text), set(), set()
    for item, t in items:
        v = word(t)
        size = min(13, len(v))
        for k in range(len(v) - size + 1 if v else 0):
            for i in range(len(w) - size + 1):
                if w[i:i + size] == v[k:k + size]:
                    hit |= set(range(i, i + size))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_equals_brute_force_in_one_block_and_many(spark, docs_of):
    rng = random.Random(7)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 30)))) for i in range(14)] + [(99, None), (3, "extra words of item three"), (50, "rare")]
    rows = []
    for i in range(60):
        w = [f"w{rng.randrange(99)}" for _ in range(rng.randrange(0, 60))]
        at = rng.randrange(len(w) + 1)
        w[at:at] = (rng.choice(items)[1] or "").upper().split()
        rows.append((i, ", ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(rows)
    want = {i: brute(t, items) for i, t in rows}
    for size in (D.BLOCK_BYTES, 60):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.decontaminate(docs, bench, block_bytes=size).collect()}
        assert got == want


def test_clean_text_has_no_hits(spark, docs_of):
    bench = spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(20)))], "item_id long, text string")
    docs = docs_of([(1, "Keep this é. Q0 " + ", ".join(f"q{k}" for k in range(1, 20)) + "! and that.")])
    r = D.decontaminate(docs, bench, clean=True).first()
    assert (r.n_hit, r.clean_text) == (20, "Keep this é. ! and that.")


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "short line"), (None, "x"), (2, "")], "item_id long, text string")
    got = D.decontaminate(odd, bench, keep=("doc_id", "score", "n_words")[:2]).collect()
    assert len(got) == odd.count() and {r.doc_id for r in got if r.contaminated} == {1, 6}
    assert D.decontaminate(none, bench).count() == 0 and D.decontaminate(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_a_task_has_one_python_worker_for_any_number_of_blocks(spark, docs_of):
    """Each Python step of a task is a worker of its own, which Spark keeps with all its memory for the passes to come."""
    bench = spark.createDataFrame([(i, f"item number {i}") for i in range(9)], "item_id long, text string")
    for size in (D.BLOCK_BYTES, 30):
        plan = D.decontaminate(docs_of([(1, "item number 1")]), bench, block_bytes=size)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1
