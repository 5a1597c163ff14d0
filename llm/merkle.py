"""Merkle manifest of a dataset: a tree of digests for each source, one over the sources, and a proof for each row.

Method: nested-interval labels.  A node is labelled with the interval [lo, hi) of the leaf ranks it covers, so
an ancestor is a node whose interval contains another one.  Ancestors are attached level by level from the
root down by containment joins; the level's width cuts the ranks into buckets, which makes the join one of
equal buckets.  A node's siblings are its parent's interval without its own: what ends before it stands to
the left of it, what begins after it to the right.

A digest is the lower-case hex SHA-256 of its inputs, joined as text.  A leaf is the digest of doc_id, source,
lang, n_chars and text, each `-` if null, else its bytes in UTF-8, `:` and the value.  RUN consecutive nodes
have one parent; a tree of one leaf is its own root.

Ranks come from a range partition by (source, doc_id, leaf), so a source of any size is spread; the rows of a
part are counted by source, and the counts of earlier parts are added.  What a row carries up its tree is
joined to its parent, never to the row itself, so at most RUN digests of a level meet one key.

Nulls and ties: every column may be null; a null source is a tree of its own and the first one.  Rows of one
doc_id are ordered by their leaf; equal rows have equal leaves and stand side by side, each with its own place.
An empty table gives no rows, and a very long text is one digest.  Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codewarden.session import cut_lineage
from llm.tables import remainder

RUN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PART_BITS = 33  # monotonically_increasing_id holds the partition above these bits, the row below


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_digest(**values: Column) -> Column:
    """The digest of FIELDS; `values` replaces some of them."""
    def written(name: str) -> Column:
        value = values.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(F.concat(*[written(name) for name in FIELDS]))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `lo`, their rank from 0 in their tree by `order`, and `size`, the rows of that tree."""
    sorted_rows = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = cut_lineage(sorted_rows.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", PART_BITS)))
    every, earlier = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("part")
    counts = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    counts = counts.select("tree", "part", "first", (F.sum("n").over(earlier) - F.col("n")).alias("before"), F.sum("n").over(every).alias("size"))
    return (placed.join(counts, ["tree", "part"])
            .withColumn("lo", (F.col("place") - F.col("first") + F.col("before")).cast("long")).drop("place", "part", "first", "before"))


def levels_above(leaves: DataFrame, run: int) -> list[DataFrame]:
    """Level 0 (tree, size, lo, hi, digest, ...) and all levels above it, whose nodes also hold their children."""
    levels, width = [leaves], run
    largest = leaves.agg(F.max("size")).first()[0] or 0
    while width // run < largest:
        below = levels[-1].where(F.col("size") > width // run)  # trees that have more than one node there
        nodes = below.groupBy("tree", "size", F.floor(F.col("lo") / width).alias("bucket")).agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
        joined = digest(F.array_join(F.col("children.digest"), ""))
        levels.append(cut_lineage(nodes.withColumn("digest", joined).drop("bucket")))
        width *= run
    return levels


def roots_of(levels: list[DataFrame], run: int) -> DataFrame:
    """(tree, digest) of the one node that covers each tree."""
    tops = [nodes.where((F.col("size") <= run ** k) & (F.col("size") > (run ** (k - 1) if k else 0))) for k, nodes in enumerate(levels)]
    return reduce(DataFrame.unionByName, [t.select("tree", "digest") for t in tops])


def with_paths(levels: list[DataFrame], roots: DataFrame, run: int) -> DataFrame:
    """Level 0 with `path`: from the leaf up, the joined digests left and right of each node, and what `roots` (tree, path, ...) holds.

    The nodes of a level meet their parents by containment, bucket by bucket; roots meet `roots` by their tree.
    """
    extra = [c for c in roots.columns if c not in ("tree", "path")]
    above = None
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k]
        kept = [*nodes.columns, "path", *extra]
        found = nodes.where(F.col("size") <= run ** k).join(roots, "tree").select(*kept)
        if above is not None:
            bucket = F.floor(F.col("lo") / run ** (k + 1)).alias("bucket")
            up = above.select("tree", bucket, F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"), F.col("children").alias("run"),
                              F.col("path").alias("up_path"), *extra)
            met = nodes.where(F.col("size") > run ** k).select("*", bucket).join(up, ["tree", "bucket"]).where("up_lo <= lo AND hi <= up_hi")
            side = lambda test: F.array_join(F.transform(F.filter("run", test), lambda c: c["digest"]), "")
            own = F.struct(side(lambda c: c["hi"] <= F.col("lo")).alias("left"), side(lambda c: c["lo"] >= F.col("hi")).alias("right"))
            found = found.unionByName(met.withColumn("path", F.concat(F.array(own), F.col("up_path"))).select(*kept))
        above = found
    return above


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda below, level: digest(F.concat(level["left"], below, level["right"])))


def _leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, changed): changed is the leaf after the text lost its capitals, where the check asks for that."""
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    changed = F.when(remainder(F.col("doc_id"), 5) == 0, leaf_digest(text=F.translate("text", UPPER, LOWER)))
    return cut_lineage(docs.select(*FIELDS).select(tree.alias("tree"), "doc_id", leaf_digest().alias("leaf"), changed.alias("changed")))


def _trees(docs: DataFrame, run: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The levels of the sources' trees and of the tree over their roots."""
    leaves = ranked(_leaves(docs), ["doc_id", "leaf"])
    sources = levels_above(cut_lineage(leaves.withColumn("hi", F.col("lo") + 1).withColumn("digest", F.col("leaf"))), run)
    subroots = ranked(roots_of(sources, run).select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), "digest"), ["source_tree"])
    return sources, levels_above(cut_lineage(subroots.withColumn("hi", F.col("lo") + 1)), run)


def manifest(docs: DataFrame, run: int = RUN) -> DataFrame:
    """All nodes: (tree, level, lo, hi, digest).  `tree` is `=` and the source, empty for a null one, null for the tree over all."""
    sources, top = _trees(docs, run)
    named = [(F.col("tree"), sources), (F.lit(None).cast("string"), top)]
    return reduce(DataFrame.unionByName, [nodes.select(tree.alias("tree"), F.lit(k).alias("level"), "lo", "hi", "digest")
                                          for tree, levels in named for k, nodes in enumerate(levels)])


def proofs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """Each row with its leaf, the roots, the path of its siblings, and the leaf `changed` that stands for a tampered text."""
    sources, top = _trees(docs, run)
    root = roots_of(top, run).select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("digest").alias("root"))
    over = with_paths(top, root, run).select(F.col("source_tree").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    return with_paths(sources, cut_lineage(over), run).select("doc_id", "leaf", "changed", "subroot", "root", "path")


def verify(proven: DataFrame) -> DataFrame:
    """doc_id, leaf, roots, the digest of the siblings, the root folded from the (changed) leaf, and whether it is the root."""
    siblings = F.array_join(F.transform("path", lambda level: F.concat(level["left"], level["right"])), "")
    folded = proven.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"),
                           fold(F.col("path"), F.coalesce("changed", "leaf")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(levels: int = 5, run: int = RUN) -> str:
    """The same in SQL, for trees of at most run ** levels leaves."""
    lower = f"translate(text, '{UPPER}', '{LOWER}')"

    def written(value: str) -> str:
        return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(written(v) for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"

    def tree(name: str, base: str) -> list[str]:
        """Levels of one kind of tree over `base` (tree, lo, digest): each a table (tree, lo, digest, more), more: not yet the root."""
        out = [f"{name}0 AS MATERIALIZED (SELECT tree, lo, digest, count(*) OVER (PARTITION BY tree) > 1 AS more FROM {base})"]
        for k in range(1, levels + 1):
            out.append(f"{name}{k} AS MATERIALIZED (SELECT tree, lo, digest, count(*) OVER (PARTITION BY tree) > 1 AS more FROM (SELECT tree, lo // {run} AS lo, "
                       f"sha256(string_agg(digest, '' ORDER BY lo)) AS digest FROM {name}{k - 1} WHERE more GROUP BY tree, lo // {run}))")
        out.append(f"{name}_root AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT tree, digest FROM {name}{k} WHERE NOT more" for k in range(levels + 1)) + ")")
        return out

    def climb(name: str, base: str, start: str) -> list[str]:
        """From `base` (id, tree, place, proof, fold) to the root, level by level."""
        out, last = [], base
        for k in range(levels):
            sides = (f"SELECT x.id, coalesce(string_agg(n.digest, '' ORDER BY n.lo) FILTER (n.lo < x.place), '') AS l, "
                     f"coalesce(string_agg(n.digest, '' ORDER BY n.lo) FILTER (n.lo > x.place), '') AS r "
                     f"FROM {last} x JOIN {name}{k} n ON n.tree = x.tree AND n.lo // {run} = x.place // {run} WHERE n.more GROUP BY x.id")
            out.append(f"{start}{k} AS MATERIALIZED (SELECT x.id, x.tree, x.place // {run} AS place, x.proof || coalesce(s.l || s.r, '') AS proof, "
                       f"CASE WHEN s.id IS NULL THEN x.fold ELSE sha256(s.l || x.fold || s.r) END AS fold FROM {last} x LEFT JOIN ({sides}) s ON s.id = x.id)")
            last = f"{start}{k}"
        return out

    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    parts = [
        f"crc AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: {step}) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i))",
        "d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, source, coalesce('=' || source, '') AS tree, "
        f"{leaf('text')} AS leaf, {leaf(lower)} AS changed, "
        "xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 AS hit FROM documents, crc)",
        "b AS MATERIALIZED (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS lo FROM d)",
        *tree("n", "b"),
        "s AS MATERIALIZED (SELECT '' AS tree, tree AS src, digest, row_number() OVER (ORDER BY tree) - 1 AS lo FROM n_root)",
        *tree("m", "s"),
        "p AS (SELECT id, tree, lo AS place, '' AS proof, CASE WHEN hit THEN changed ELSE leaf END AS fold FROM b)",
        *climb("n", "p", "u"),
        f"q AS (SELECT x.id, '' AS tree, s.lo AS place, x.proof, x.fold FROM u{levels - 1} x JOIN s ON s.src = x.tree)",
        *climb("m", "q", "v"),
    ]
    return ("WITH " + ",\n".join(parts) + f"\nSELECT b.doc_id, b.leaf, s.digest AS subroot, m_root.digest AS root, sha256(v.proof) AS proof_sha256, v.fold AS folded_root, "
            f"v.fold = m_root.digest AS verified FROM b JOIN s ON s.src = b.tree JOIN v{levels - 1} v ON v.id = b.id, m_root")
