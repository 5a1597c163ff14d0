"""N-gram Jaccard self-join of documents: which are linked, and their components.  Exact and whole.

Method: universe partition and pigeonhole (`segments`), one-deletion neighbourhoods, allocation by the
cost that keys have in the corpus, exact verification on the sets.

1. Each text becomes a set of 64-bit shingle hashes and a 128-bit hash of the set.  Equal sets are one
   node from here on (each input split sends it once), so exact copies cost nothing further.
2. All keys meet in one shuffle; keys of a single node, nearly all, end there.
3. A node probes by its cheapest keys.  A key that nobody shares is free, so most nodes that have no
   similar partner are done here.
4. In each key's group every node is verified against one leader, not against all.  Components follow.
5. Groups that still hold several components are finished: small ones pair by pair, groups over PAIRED
   rows block against block within a task, where common tokens are counted by postings.  Only links leave.

Pairs of a group in different components are compared in full, so no link between components is lost;
pairs inside one component add nothing and are left out.

Nulls and ties: a null or empty text has no shingles and is linked with nothing; so is a null doc_id (its
component is null).  Rows are judged one by one, also repeated ones; columns named in `keep` come along,
others are not read.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codewarden.session import cut_lineage
from llm import segments, words
from llm.graph import components
from llm.segments import DEN, NUM

SHINGLE = 5
PAIRED = 8  # rows of a group that are still paired one by one
BLOCK_TOKENS = 1 << 19  # tokens of the sets in one block of a large cluster
EVENTS_SECONDS = 0.2
SIEVE_BITS = 1 << 24  # bits of the broadcast sieve of wanted documents, 2 MB at any corpus size

PRINT = "n_shingles long, h1 long, h2 long"


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, one set after another and sorted, and the size of each set."""
    block = words.split(texts, words.SPACED)
    hashes = block.hashes()
    shingles, first = block.windows(hashes, width)
    edges = np.searchsorted(first, block.bounds)
    out, sizes = [], np.zeros(len(block), dtype=np.int64)
    for d in range(len(block)):
        low, high = block.bounds[d], block.bounds[d + 1]
        if high - low >= width:
            one = np.unique(shingles[edges[d]:edges[d + 1]])
        elif high > low:
            one = np.zeros(1, dtype=np.uint64)
            for k in range(low, high):
                one = words.mix(one + hashes[k])
        else:
            continue
        out.append(one)
        sizes[d] = len(one)
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), sizes


def set_hashes(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    edge = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for salt in (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xAAAAAAAB5C1B7F2D)):
        running = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words.mix(tokens ^ salt), dtype=np.uint64)])
        out.append(words.mix(running[edge[1:]] - running[edge[:-1]] + sizes.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def prints(docs: DataFrame, width: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, h1, h2) of every document, and the columns to keep."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.blocks(batches):
            tokens, sizes = shingle_sets(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *map(pa.array, set_hashes(tokens, sizes)), *batch.columns[2:]],
                                             names=["doc_id", "n_shingles", "h1", "h2", *keep])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", *keep)}
    return docs.select("doc_id", "text", *keep).mapInArrow(run, ", ".join([f"doc_id {kinds['doc_id']}", PRINT, *[f"`{c}` {kinds[c]}" for c in keep]]))


def key_rows(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(key, node, part): part packs set size, segment, whether it only probes, whether a token is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of the documents of one input split
        for batch in words.blocks(batches):
            tokens, sizes = shingle_sets(batch.column(0), width)
            h1, _ = set_hashes(tokens, sizes)
            kept = np.zeros(len(sizes), dtype=bool)
            for i, h in enumerate(h1.tolist()):
                kept[i] = sizes[i] > 0 and h not in seen
                seen.add(h)
            tokens = tokens[np.repeat(kept, sizes)]
            node, size = h1[kept], sizes[kept]
            own = segments.band_of(size)
            least = segments.band_of(np.maximum(1, -(-size * NUM // DEN)))
            for role in (0, 1):
                if role:
                    lower = least < own
                    tokens, node, size, own = tokens[np.repeat(lower, size)], node[lower], size[lower], own[lower] - 1
                owner, segment, less, key = segments.keys(tokens, size, own)
                part = (size[owner] << 32) | (segment << 2) | (role << 1) | less
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[owner]), pa.array(part)],
                                                 names=["key", "node", "part"])

    return docs.select("text").mapInArrow(run, "key long, node long, part long")


def band_table(spark: SparkSession) -> DataFrame:
    """The bands as an Arrow table: rows from a Python list would start a second Python daemon with workers on every executor."""
    return spark.createDataFrame(pa.table({c: segments.BANDS[:, k] for k, c in enumerate(("low", "top", "m", "deep"))}))


def allocate(live: DataFrame) -> DataFrame:
    """(key, node, n, probe) of the shared keys: a node probes by the cheapest that its allocation needs.

    `live` has (key, node, part, others), all rows of keys that several nodes have.  Keys of one node
    alone are missing there and cost nothing; they are counted as used first.
    """
    n, seg = F.shiftright("part", 32), F.shiftright(F.col("part").bitwiseAND((1 << 32) - 1), 2)
    role, less = F.shiftright("part", 1).bitwiseAND(1), F.col("part").bitwiseAND(1)
    rows = live.select("key", "node", "others", n.alias("n"), seg.alias("seg"), role.alias("role"), less.alias("less"))
    rows = rows.repartition("node")  # serves all windows below; a node has no more keys than tokens
    rows = rows.join(F.broadcast(band_table(live.sparkSession)),
                     F.when(F.col("role") == 0, F.col("n") >= F.col("low")).otherwise(F.col("n") > F.col("top"))
                     & F.when(F.col("role") == 0, F.col("n") <= F.col("top")).otherwise(F.ceil(F.col("n") * F.lit(NUM) / F.lit(DEN)) <= F.col("top")))
    here = Window.partitionBy("node", "role", "seg")
    set_ = Window.partitionBy("node", "role")
    first = F.sum(F.when(F.col("less") == 0, F.col("others")).otherwise(0)).over(here)
    second = F.sum(F.when(F.col("less") == 1, F.col("others")).otherwise(0)).over(here)
    rows = rows.withColumn("c1", first).withColumn("c2", second)
    rows = rows.withColumn("cost", F.when(F.col("less") == 0, F.col("c1")).otherwise(F.greatest("c1", "c2")))
    one = F.collect_set(F.when(F.col("c1") > 0, F.col("seg"))).over(set_)
    two = F.collect_set(F.when(F.col("seg") < F.col("deep"), F.col("seg"))).over(set_)
    total = F.floor((F.col("n") + F.least("n", "top")) * F.lit(DEN - NUM) / F.lit(DEN + NUM)) + 1
    rows = (rows.withColumn("need", total - (F.col("m") - F.size(one)) - (F.col("deep") - F.size(two)))
            .withColumn("rank", F.dense_rank().over(set_.orderBy("cost", "less", "seg")))
            .withColumn("probe", F.col("rank") <= F.col("need")))
    return (rows.where((F.col("role") == 0) | F.col("probe")).select("key", "node", "probe", "role", "n")
            .repartition("key")  # for the groups to come, too
            .groupBy("key", "node").agg(F.max("probe").alias("probe"), F.max(F.col("role") == 0).alias("indexed"), F.max("n").alias("n")))


def similar_sizes(a: Column, b: Column) -> Column:
    return F.least(a, b) * DEN >= F.greatest(a, b) * NUM


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * DEN >= NUM * (len(a) + len(b) - common)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose sets are similar enough, as classes (a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = np.array([linked(np.frombuffer(left[i].as_buffer(), dtype=np.uint64), np.frombuffer(right[i].as_buffer(), dtype=np.uint64))
                             for i in range(batch.num_rows)], dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good)) for k in (0, 1)], names=["a", "b"])

    a = sets.select(F.col("node").alias("a"), F.col("class").alias("class_a"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("node").alias("b"), F.col("class").alias("class_b"), F.col("tokens").alias("tb"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b"), "ta", "tb")
    return both.mapInArrow(run, "a string, b string")


def sieve(wanted: DataFrame, key: str) -> np.ndarray:
    """Bits of SIEVE_BITS that hashes of the wanted keys set; a fixed size, whatever the number of keys."""
    place = wanted.select(F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS)).alias("place"))
    found = place.selectExpr("place >> 6 AS w", "1L << CAST(place & 63 AS INT) AS bit").groupBy("w").agg(F.bit_or("bit").alias("bits"))
    bits = np.zeros(SIEVE_BITS >> 6, dtype=np.int64)
    rows = found.toArrow()  # at most one row for each word of the sieve, 4 MB, by one job
    bits[rows.column("w").to_numpy()] = rows.column("bits").to_numpy()
    return bits


def class_sets(docs: DataFrame, classes: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(node, class, n, tokens) of the classes (class, h1, doc_id) asked for; the set is read from that document."""
    bits = docs.sparkSession.sparkContext.broadcast(sieve(classes, "doc_id"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(2).to_numpy(zero_copy_only=False)
            hit = (bits.value[place >> 6] >> (place & 63)) & 1
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(hit == 1)) for k in (0, 1)], names=["doc_id", "text"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.blocks(batches):
            tokens, sizes = shingle_sets(batch.column(0), width)
            h1, h2 = set_hashes(tokens, sizes)
            edge = np.concatenate([[0], np.cumsum(sizes)])
            raw = [tokens[edge[i]:edge[i + 1]].tobytes() for i in range(len(sizes))]
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(sizes), pa.array(raw, pa.binary()), batch.column(1)],
                                             names=["node", "h2", "n", "tokens", "class"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE_BITS))
    some = docs.select("doc_id", "text", place.alias("place")).where("doc_id IS NOT NULL").mapInArrow(near, f"doc_id {kind}, text string")
    named = some.join(classes.select("doc_id", "class").hint("shuffle_hash"), "doc_id").select("text", "class")
    found = named.mapInArrow(sets, "node long, h2 long, n long, tokens binary, class string")
    own = F.col("class") == class_of("node", "h2")  # rows that share a doc_id may hold other texts
    return found.where(own).dropDuplicates(["class"]).select("node", "class", "n", "tokens")


def class_of(h1: str, h2: str) -> Column:
    return F.concat(F.hex(h1), F.lit("-"), F.hex(h2))


def in_blocks(members: DataFrame) -> DataFrame:
    """Links (a, b) among the members (cluster, class, component, n, tokens) of each cluster.

    A cluster is cut into blocks of about BLOCK_TOKENS tokens, and each pair of blocks is one group: the
    work of a large cluster is spread over its blocks, and no group grows with it.
    """
    size = members.groupBy("cluster").agg((F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS))).cast("int").alias("blocks"))
    rows = members.join(size, "cluster").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "component", "n", "tokens")

    def meet(table: pa.Table) -> pa.Table:
        i, j, own = table.column("i")[0].as_py(), table.column("j")[0].as_py(), table.column("own").to_numpy()
        name, comp = np.array(table.column("class").to_pylist()), np.array(table.column("component").to_pylist())
        size = table.column("n").to_numpy()
        sets = [np.frombuffer(t.as_buffer(), dtype=np.uint64) for t in table.column("tokens").combine_chunks()]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        tokens = np.concatenate([sets[k] for k in right] or [np.zeros(0, dtype=np.uint64)])
        order = np.argsort(tokens, kind="stable")
        holder = np.repeat(np.arange(len(right)), size[right])[order]
        vocabulary, start, count = np.unique(tokens[order], return_index=True, return_counts=True)
        x, y = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for k in left if len(vocabulary) else ():
            at = np.minimum(np.searchsorted(vocabulary, sets[k]), len(vocabulary) - 1)
            at = at[vocabulary[at] == sets[k]]
            runs = count[at]
            spot = np.arange(runs.sum()) + np.repeat(start[at] - np.cumsum(runs) + runs, runs)
            common = np.bincount(holder[spot], minlength=len(right))
            good = np.flatnonzero((common * DEN >= NUM * (size[k] + size[right] - common)) & (comp[right] != comp[k]))
            x.append(np.full(len(good), k))
            y.append(right[good])
        x, y = np.concatenate(x), np.concatenate(y)
        return pa.table({"a": pa.array(name[x], pa.string()), "b": pa.array(name[y], pa.string())})

    return rows.groupBy("cluster", "i", "j").applyInArrow(meet, "a string, b string")


def key_groups(docs: DataFrame, width: int) -> DataFrame:
    """The nodes of each shared key that some node probes by, with the key's leader."""
    key = Window.partitionBy("key")
    shared = (key_rows(docs, width).withColumn("low", F.min("node").over(key)).withColumn("high", F.max("node").over(key))
              .withColumn("others", F.count("*").over(key) - 1).where("low <> high").select("key", "node", "part", "others"))
    probed = allocate(shared)
    leader = F.min(F.when(F.col("probe"), F.struct("node", "n"))).over(key)
    return (probed.withColumn("low", F.min("node").over(key)).withColumn("high", F.max("node").over(key))
            .withColumn("leader", leader).where("low <> high AND leader IS NOT NULL")
            .select("key", "node", "n", "probe", "indexed", F.col("leader.node").alias("leader"), F.col("leader.n").alias("leader_n")))


def release(docs: DataFrame) -> None:
    """Let Spark delete the files of shuffles that nothing refers to any more.

    The events of the query that has just ended hold its plan until they are dealt with, hence the second time.
    """
    for _ in range(2):
        time.sleep(EVENTS_SECONDS)
        gc.collect()
        docs.sparkSession.sparkContext._jvm.System.gc()


def class_links(docs: DataFrame, classes: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(node, component) of the classes that have a link to another one.  `classes`: (class, h1, h2, doc_id)."""
    key = Window.partitionBy("key")
    groups = cut_lineage(key_groups(docs, width))
    release(docs)  # the shuffles of all keys are the largest files of the job
    asked = classes.join(groups.select(F.col("node").alias("h1")).distinct(), "h1", "left_semi")
    sets = cut_lineage(class_sets(docs, asked, width))
    release(docs)  # texts and sets were shuffled; what follows reads the sets as they are stored

    star = (groups.where((F.col("node") != F.col("leader")) & similar_sizes(F.col("n"), F.col("leader_n")))
            .select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())
    star = cut_lineage(star)
    edges = cut_lineage(verify(star, sets))
    release(docs)  # each set went along with its pairs
    reached = components(edges)

    named = sets.select("node", "class").join(reached.withColumnRenamed("node", "class"), "class", "left")
    named = named.select("node", F.coalesce("component", "class").alias("component"))
    rest = (groups.join(named, "node").withColumn("low", F.min("component").over(key)).withColumn("high", F.max("component").over(key))
            .where("low <> high").withColumn("size", F.count("*").over(key))
            .select("key", "node", "n", "probe", "indexed", "component", "size"))
    rest = cut_lineage(rest)
    small, large = rest.where(F.col("size") <= PAIRED), rest.where(F.col("size") > PAIRED)
    r = small.where("probe").select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
    s = small.where("indexed").select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    near = (r.join(s, "key").where("a <> b AND ca <> cb AND na >= nb").where(similar_sizes(F.col("na"), F.col("nb")))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(star, ["a", "b"], "left_anti"))
    more = verify(near, sets)

    first = Window.partitionBy("key")
    tied = cut_lineage(large.withColumn("b", F.min("node").over(first)).select(F.col("node").alias("a"), "b").distinct())
    clusters = components(tied).withColumnRenamed("component", "cluster")
    members = (clusters.join(sets, "node").join(named, "node").select("cluster", "class", "component", "n", "tokens"))
    return components(edges.unionByName(more).unionByName(in_blocks(members)))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep` columns, n_shingles, and component_id: the smallest doc_id that links reach (its own included)."""
    rows = cut_lineage(prints(docs, width, keep))
    real = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = cut_lineage(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
                          .withColumn("class", class_of("h1", "h2")))
    reached = class_links(docs.where("doc_id IS NOT NULL"), classes, width)
    named = classes.join(reached.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    answer = named.join(least, "component").select("h1", "h2", "component_id")
    out = rows.join(answer, ["h1", "h2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    return out.select("doc_id", *keep, "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(own, "doc_id")).alias("component_id"))
