import random

from llm import line_dedup as L


def brute(rows, least):
    first, lines = {}, []
    for i, text in sorted(rows):
        for k, line in enumerate(text.split("\n")):
            w = tuple(line.encode().lower().split())
            if len(w) >= least:
                lines.append((i, k, w))
                first.setdefault(w, (i, k))
    classes = sorted(first, key=first.get)
    near = {w for n, w in enumerate(classes) if any(L.one_edit(list(v), list(w)) for v in classes[:n])}
    out = {}
    for i, k, w in lines:
        if w in near or first[w] != (i, k):
            out.setdefault(i, []).append(k)
    return out


def test_one_edit():
    a = b"a b c d".split()
    assert L.one_edit(a, b"a x c d".split()) and L.one_edit(a, b"a b c d e".split()) and L.one_edit(b"b c d".split(), a) and L.one_edit(a, a)
    assert not L.one_edit(a, b"a x c y".split()) and not L.one_edit(a, b"a b".split()) and not L.one_edit(a, b"b a c d".split())


def test_removed_lines_equal_brute_force(docs_of):
    rng = random.Random(5)
    pool = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(4, 12))] for _ in range(30)]

    def line():
        w = list(rng.choice(pool))
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            k, at = rng.randrange(3), rng.randrange(len(w))
            w[at:at + (k != 0)] = [f"w{rng.randrange(40)}"] * (k != 2)
        return " ".join(w)

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 6)))) for i in range(120)]
    got = {r.doc_id: (list(r.removed), r.text) for r in L.dedup_lines(docs_of(rows), 5).collect()}
    want, texts = brute(rows, 5), dict(rows)
    assert {i: r for i, (r, _) in got.items() if r} == want
    for i, (r, text) in got.items():
        assert text == "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in r)


def test_odd_rows(odd, none, docs_of):
    got = L.dedup_lines(odd, 5)
    assert got.columns == [*odd.columns, "removed"] and got.count() == odd.count()
    by = {(r.doc_id, r.text) for r in got.collect()}
    assert (6, "Short line") in by and (2, None) in by and (3, "") in by and (None, "Licensed under CC BY-NC 4.0.") in by
    assert L.dedup_lines(none).count() == 0
    same = docs_of([(1, "a b c d e f"), (1, "a b c d e f"), (2, "q\na b c d e x")])  # rows of one id don't remove each other's
    assert sorted((r.doc_id, r.text) for r in L.dedup_lines(same, 5).collect()) == [(1, "a b c d e f"), (1, "a b c d e f"), (2, "q")]


def test_short_lines_go_when_equal(docs_of):
    long = " ".join(f"w{k}" for k in range(24))
    rows = [(1, f"Read more\n\nx\n{long}"), (2, f"read  MORE\n\nown words\nx\n{long} z"), (3, "own word\nx\nx"), (4, "Read more\nRead less")]
    got = {r.doc_id: list(r.removed) for r in L.dedup_lines(docs_of(rows)).collect()}
    assert got == {1: [], 2: [0, 3, 4], 3: [1, 2], 4: [0]}
