import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from llm import collocations as C
from llm import hashed


def pieces(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", folded)]


def brute(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        total[lang] += 0
        for w in pieces(text):
            total[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {g: n for g, n in f.items() if len(g) >= 2 and n >= least}
        covered = Counter()
        for g, n in candidates.items():
            for size in range(2, len(g)):
                for i in range(len(g) - size + 1):
                    covered[g[i:i + size]] = max(covered[g[i:i + size]], n)
        found = []
        for g, a in candidates.items():
            if 100 * covered[g] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, g, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(seed, n):
    rng, rows = random.Random(seed), []
    vocabulary = ["Ab", "ab", "é", "É", "c d", "x-y", "\U0001f600", "zz", " "]
    for i in range(n):
        text = []
        for _ in range(rng.randrange(0, 30)):
            text.append(rng.choice(vocabulary) if rng.random() < 0.6 else rng.choice(["new york city hall", "in spite of it", "Ab ab Ab ab Ab"]))
            text.append(rng.choice([" ", "  ", "\t", ". ", ",", "\n", " \x0b", "\r\n", " ! "]) if rng.random() < 0.4 else " ")
        rows.append((i, "".join(text), rng.choice(["en", "de", None, "und", ""])))
    return rows


NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("least,top,shard_bytes", [(3, 2000, 500), (30, 7, hashed.SHARD_BYTES)])
def test_against_brute_force(docs_of, least, top, shard_bytes):
    rows = corpus(least, 250) + [(7, None, None), (8, "", "fr"), (9, "Ab é " * 3000, "en"), (9, "Ab é " * 3000, "en")]
    got = C.collocations(docs_of(rows).repartition(6), least, top, shard_bytes).select(*NAMES).collect()
    assert sorted(map(tuple, got)) == brute(rows, least, top)


def test_sql(docs_of):
    rows = corpus(5, 200)
    frame = docs_of(rows).toPandas()[["doc_id", "text", "lang"]]  # noqa: F841
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM frame")
    assert sorted(tuple(r) for r in con.execute(f"SELECT {', '.join(NAMES)} FROM ({C.oracle_sql(4, 50)})").fetchall()) == brute(rows, 4, 50)


def test_odd_and_empty(odd, none):
    assert C.collocations(none).count() == 0
    assert {r["lang"] for r in C.collocations(odd, 2).collect()} <= {"en", "de", "fr", "und"}
    assert C.frequent_runs(odd, 10_000).where("phrase = 'wort'").first()["n"] == 60_000


def test_summaries_keep_what_is_frequent():
    rng = np.random.default_rng(3)
    for least in (5, 40):
        stream = rng.zipf(1.3, 30_000).astype(np.uint64)
        true = Counter(stream.tolist())
        capacity = len(stream) // least + 1
        halves = [C.MisraGries(capacity) for _ in range(2)]
        for part, summary in zip(np.array_split(stream, 40), halves * 20):
            summary.merge(*np.unique(part, return_counts=True))
        halves[0].merge(halves[1].keys, halves[1].counts, halves[1].lost)
        merged = halves[0]
        assert len(merged.keys) <= capacity and merged.lost < least
        for key, n in zip(merged.keys.tolist(), merged.counts.tolist()):
            assert n <= true[key] <= n + merged.lost
        assert {k for k, n in true.items() if n >= least} <= set(merged.possible(least).tolist())


def test_summary_over_its_capacity_loses_and_still_keeps():
    """Many rare keys push counters out; the heavy ones stay."""
    stream = np.concatenate([np.arange(10, 50_000, dtype=np.uint64), np.repeat(np.arange(5, dtype=np.uint64), 500)])
    np.random.default_rng(1).shuffle(stream)
    summary = C.MisraGries(len(stream) // 500 + 1)
    for part in np.array_split(stream, 300):
        summary.merge(*np.unique(part, return_counts=True))
    assert 0 < summary.lost < 500
    assert set(range(5)) <= set(summary.possible(500).tolist())


def test_packing_of_counts():
    rng = np.random.default_rng(0)
    tally, want = hashed.Tally(), Counter()
    for _ in range(20):
        keys = rng.integers(0, 1 << 64, 500, dtype=np.uint64) >> rng.integers(0, 60, dtype=np.uint64)
        tally.add(keys)
        want.update(keys.tolist())
    got = Counter()
    for shard, data in tally.drain(7):
        keys, counts = hashed.unpacked(data)
        assert (hashed.shard_of(keys, 7) == shard).all() and (np.diff(keys.astype(object)) > 0).all()
        got.update(dict(zip(keys.tolist(), counts.tolist())))
    assert got == want


def test_arrays_find(tmp_path):
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 64, 3000, dtype=np.uint64))
    arrays = hashed.Arrays(str(tmp_path), "a", 5, n="<i4")
    for shard in range(5):
        part = hashed.shard_of(keys, 5) == shard
        if shard != 3:
            arrays.write(shard, keys=keys[part], n=np.flatnonzero(part).astype("<i4"))
    asked = np.concatenate([keys[::-2], keys[:9] + np.uint64(1)])
    there, n = arrays.look_up(asked, "n")
    known = hashed.shard_of(asked, 5) != 3
    known[-9:] = False
    assert (there == known).all() and (keys[n[there]] == asked[there]).all() and not n[~there].any()
