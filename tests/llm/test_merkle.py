import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lowered(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(digests, run):
    """The root, and of each leaf the (left, right) siblings of every level."""
    paths, places = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for leaf_at, at in enumerate(places):
            low = at // run * run
            paths[leaf_at].append(("".join(digests[low:at]), "".join(digests[at + 1:low + run])))
        digests = [h("".join(digests[i:i + run])) for i in range(0, len(digests), run)]
        places = [p // run for p in places]
    return digests[0], paths


def brute(rows, run):
    trees = defaultdict(list)
    for row in rows:
        trees[row[1]].append(row)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    roots, found = [], []
    for source in order:
        own = sorted(trees[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroot, paths = climb([leaf(r) for r in own], run)
        roots.append(subroot)
        found.append((own, paths))
    root, tops = climb(roots, run) if roots else (None, [])
    out = []
    for subroot, top, (own, paths) in zip(roots, tops, found):
        for row, path in zip(own, paths):
            fold = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                fold = leaf((*row[:4], lowered(row[4])))
            for left, right in path + top:
                fold = h(left + fold + right)
            out.append((row[0], leaf(row), subroot, root, h("".join(left + right for left, right in path + top)), fold, fold == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
KIND = "doc_id long, source string, lang string, n_chars long, text string, path string, size int, tree string"


def made(sizes):
    return [(i, source, "en" if i % 3 else None, i, f"Text {i} É" if i % 7 else None)
            for i, source in enumerate(s for s, n in sizes for _ in range(n))]


@pytest.mark.parametrize("run,sizes", [
    (16, [("a", 300), ("b", 17), ("c", 16), ("d", 1), (None, 5)]),
    (2, [("hot", 70), *[(f"s{i}", 1 + i % 4) for i in range(9)]]),
    (16, [("one", 1)]),
    (3, [("", 9), ("É", 10), ("z", 2), (None, 1)]),
])
def test_against_brute_force(spark, run, sizes):
    rows = made(sizes)
    docs = spark.createDataFrame([(*r, "p", 1, "t") for r in rows], KIND).repartition(5)
    got = merkle.verify(merkle.proofs(docs, run)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, run))
    assert any(not r["verified"] for r in got) or len(rows) == 1


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "s", "en", 0, ""), (None, "s", None, 1, "A"), (2, "s", "en", -5, "X" * 200_000),
            (1, "s", "en", 1, "b"), (1, "s", "en", 1, "B"), (0, "s", "", 1, "1:x")]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], KIND)
    got = merkle.verify(merkle.proofs(docs, 2)).select(*COLUMNS).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, 2)))


def test_empty(spark):
    none = spark.createDataFrame([], KIND)
    assert merkle.verify(merkle.proofs(none)).count() == 0
    assert merkle.manifest(none).count() == 0


def test_manifest_intervals_nest(spark):
    docs = spark.createDataFrame([(*r, "p", 1, "t") for r in made([("a", 40), ("b", 3)])], KIND)
    nodes = merkle.manifest(docs, 3).where("tree = '=a'").collect()
    assert sorted((r["level"], r["lo"], r["hi"]) for r in nodes if r["level"] >= 2) == [
        *[(2, 9 * i, min(9 * i + 9, 40)) for i in range(5)], (3, 0, 27), (3, 27, 40), (4, 0, 40)]
    assert sum(r["level"] == 0 for r in nodes) == 40


def test_sql_of_deep_trees(spark):
    docs = spark.createDataFrame([(*r, "p", 1, "t") for r in made([("a", 50), ("b", 7), (None, 4)])], KIND)
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, source, lang, n_chars::BIGINT AS n_chars, text FROM documents")
    want = con.execute(merkle.oracle_sql(levels=6, run=2)).df()
    got = merkle.verify(merkle.proofs(docs, 2)).toPandas()
    key = lambda f: sorted(map(tuple, f[COLUMNS].itertuples(index=False)))
    assert key(got) == key(want)


def test_ranks_run_through_each_tree(spark):
    docs = spark.createDataFrame([(*r, "p", 1, "t") for r in made([("a", 100), ("b", 3)])], KIND)
    leaves = merkle.ranked(merkle._leaves(docs), ["doc_id", "leaf"])
    got = leaves.groupBy("tree").agg(F.sort_array(F.collect_list("lo")).alias("lo"), F.max("size").alias("size")).orderBy("tree").collect()
    assert [(r["tree"], r["lo"], r["size"]) for r in got] == [("=a", list(range(100)), 100), ("=b", [0, 1, 2], 3)]
