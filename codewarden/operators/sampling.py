"""Leakage-safe splits and stratified samples, all reproducible from a seed."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codewarden.functions.text import none_if_empty, stable_ratio
from codewarden.operators.ordering import lowest_hashes, seeded_hash
from codewarden.session import cut_lineage



def split_key(commit_id: Column, func: Column) -> Column:
    """The unit of the split: the commit, or the start of the text where there is none."""
    return F.coalesce(none_if_empty(commit_id), F.substring(func, 1, 128))


def split_by_commit(samples: DataFrame, train_ratio: float = 0.8, commit_id: str = "commit_id",
                    func: str = "func") -> DataFrame:
    """Add `split`.  Map-only: the side is a function of the commit alone."""
    ratio = stable_ratio(split_key(F.col(commit_id).cast("string"), F.col(func)))
    return samples.withColumn("split", F.when(ratio < train_ratio, F.lit("train")).otherwise(F.lit("test")))


def split_leaks(split: DataFrame, commit_id: str = "commit_id") -> DataFrame:
    """Commits on more than one side; empty when the split is sound."""
    return split.where(none_if_empty(F.col(commit_id).cast("string")).isNotNull()).groupBy(commit_id).agg(
        F.min("split").alias("first"), F.max("split").alias("last")).where("first <> last").select(commit_id)


def stratum_columns(cwe: str = "cwe", project: str = "project") -> list[Column]:
    return [F.coalesce(none_if_empty(F.col(cwe)), F.lit("None")).alias("cwe_key"),
            F.coalesce(none_if_empty(F.col(project)), F.lit("unknown")).alias("project_key")]


def stratum_sizes(samples: DataFrame, cwe: str = "cwe", project: str = "project",
                  groups: Sequence[str] = ()) -> DataFrame:
    return samples.select(*groups, *stratum_columns(cwe, project)).groupBy(
        *groups, "cwe_key", "project_key").agg(F.count("*").alias("n"))


def stratum_quotas(sizes: DataFrame, targets: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """How many rows to take per stratum (`quota`, `take`).

    `targets` holds `target_n`, one row per group (one row in all without groups).  Shares are
    rounded half to even.  The roundings miss the target by less than the number of strata, so the
    correction is one row each for the first strata in order: largest first when rows are missing,
    smallest first when there are too many, equal sizes by hash; never below zero.  If all rows fit,
    all are taken.  The order is found from the counts per stratum size, so the strata, too, may be
    many.
    """
    groups = list(groups)
    sizes = cut_lineage(sizes)  # counts of the whole data, read several times below

    def per_group(rows: DataFrame, small: DataFrame) -> DataFrame:
        return rows.join(small, groups) if groups else rows.join(F.broadcast(small), F.lit(True))  # one row without groups

    keyed = per_group(sizes, targets.select(*groups, F.col("target_n").cast("bigint"))).withColumn(
        "_stratum", F.md5(F.concat_ws("|", "cwe_key", "project_key")))
    base = per_group(keyed, sizes.groupBy(*groups).agg(F.sum("n").alias("total"))).withColumn(
        "q0", F.bround(F.col("n") / F.col("total") * F.col("target_n")).cast("bigint"))
    miss = base.groupBy(*groups).agg((F.max("target_n") - F.sum("q0")).alias("delta"))
    # One row per distinct stratum size.
    per_size = per_group(base.groupBy(*groups, "n").agg(F.count("*").alias("_k")), miss)
    before = Window.partitionBy(*groups).orderBy(
        F.when(F.col("delta") > 0, -F.col("n")).otherwise(F.col("n"))).rowsBetween(Window.unboundedPreceding, -1)
    per_size = per_size.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0)))
    room = F.greatest(F.lit(0), F.least(F.col("_k"), F.abs("delta") - F.col("_before")))
    cut = per_size.select(*groups, "n", room.alias("take")).where("take > 0")
    moved = lowest_hashes(base, [*groups, "n"], cut, "_stratum", "_stratum")
    step = per_group(moved, miss).select(*groups, "_stratum", F.signum("delta").cast("bigint").alias("_step"))
    quota = F.greatest(F.lit(0).cast("bigint"), F.col("q0") + F.coalesce("_step", F.lit(0)))
    take = F.when(F.col("total") <= F.col("target_n"), F.col("n")).otherwise(F.least("n", "quota"))
    return base.join(step, [*groups, "_stratum"], "left").withColumn("quota", quota).select(
        *groups, "cwe_key", "project_key", "n", "total", "target_n", "quota", take.cast("bigint").alias("take"))


def _content(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def exclude_by_content(rows: DataFrame, taken: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose values equal no taken row: copies of a taken row leave the pool as well.

    The taken side is reduced to distinct digests first, so a hot group of copies meets one row.
    """
    known = taken.select(_content(columns).alias("_content")).distinct()
    return rows.withColumn("_content", _content(columns)).join(known, "_content", "left_anti").drop("_content")


def stratified_sample_by(samples: DataFrame, groups: Sequence[str], targets: DataFrame, seed: int | str, row_id: str,
                         content: Sequence[str], cwe: str = "cwe", project: str = "project") -> DataFrame:
    """Stratified samples of many groups in one go, `target_n` rows for each group of `targets`.

    About proportional over the (cwe, project) strata of the group.  Rows missing after the quotas
    are filled from what is left, copies of chosen rows excepted; a surplus is cut by hash order.
    All ranking is done on (group, id, strata, hash); whole rows are touched by the final semi-join.
    """
    groups, strata = list(groups), ["cwe_key", "project_key"]
    key = [*groups, row_id]
    keyed = samples.select(*key, *stratum_columns(cwe, project), seeded_hash(seed, F.col(row_id)).alias("_hash"))
    quotas = cut_lineage(stratum_quotas(stratum_sizes(samples, cwe, project, groups), targets, groups))
    first = lowest_hashes(keyed, [*groups, *strata], quotas.select(*groups, *strata, "take"), row_id, "_hash")
    ids = cut_lineage(first.select(*key))
    balance = quotas.groupBy(*groups).agg(
        F.sum("take").alias("_taken"), F.max("target_n").alias("_target"), F.max("total").alias("_total"))
    balance = balance.select(*groups, "_target", F.greatest(F.lit(0), F.least("_target", "_total") - F.col("_taken"))
                             .alias("_short"), (F.col("_taken") - F.col("_target")).alias("_over"))
    # One row per group is looked at; most samples need neither step, and then no text is digested.
    gap = balance.agg(F.max("_short").alias("short"), F.max("_over").alias("over")).first()
    if gap["short"]:
        chosen = samples.join(ids, key, "left_semi").select(*groups, _content(content).alias("_content")).distinct()
        left = samples.join(ids, key, "left_anti").withColumn("_content", _content(content)).join(
            chosen, [*groups, "_content"], "left_anti").withColumn("_hash", seeded_hash(seed, F.col(row_id)))
        wanted = balance.where("_short > 0").select(*groups, F.col("_short").alias("take"))
        ids = cut_lineage(ids.unionByName(lowest_hashes(left, groups, wanted, row_id, "_hash").select(*key)))
    if gap["over"] and gap["over"] > 0:
        ranked = ids.withColumn("_hash", seeded_hash(seed, F.col(row_id)))
        limit = balance.select(*groups, F.col("_target").alias("take"))
        ids = cut_lineage(lowest_hashes(ranked, groups, limit, row_id, "_hash").select(*key))
    return samples.join(ids, key, "left_semi")


def _one_target(rows: DataFrame, n: int) -> DataFrame:
    return rows.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("target_n"))


def stratified_sample(samples: DataFrame, target: int, seed: int | str, row_id: str, content: Sequence[str],
                      cwe: str = "cwe", project: str = "project") -> DataFrame:
    """Stratified sample of `target` rows; see `stratified_sample_by`."""
    if target <= 0:
        return samples.limit(0)
    return stratified_sample_by(samples, [], _one_target(samples, target), seed, row_id, content, cwe, project)


def _targets(rows: DataFrame, column: str, sizes: dict[int, int]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(label).alias(column), F.lit(n).cast("bigint").alias("target_n"))
                                for label, n in sizes.items()]))
    return rows.sparkSession.range(1).select(pairs.alias("p")).select("p.*")


def calibration_sets(samples: DataFrame, sizes: dict[str, int], seed: int | str, row_id: str,
                     content: Sequence[str], target: str = "target") -> DataFrame:
    """Disjoint train and validation samples, stratified per label.

    `sizes` holds train_pos, train_neg, val_pos and val_neg.  Validation rows come from what is
    left of each label once the training rows and their copies are gone.  Adds `part`.
    """
    def draw(pool: DataFrame, part: str) -> DataFrame:
        wanted = {1: sizes[f"{part}_pos"], 0: sizes[f"{part}_neg"]}
        return stratified_sample_by(pool, [target], _targets(pool, target, wanted), f"{seed}-{part}", row_id, content)

    train = draw(samples, "train")
    rest = exclude_by_content(samples, train, content)
    return train.withColumn("part", F.lit("train")).unionByName(draw(rest, "val").withColumn("part", F.lit("val")))


def balanced_kb(sources: dict[str, DataFrame], pos: int, neg: int, seed: int | str, row_id: str,
                content: Sequence[str], target: str = "target") -> DataFrame:
    """Per source, `pos` and `neg` stratified samples; their union, `kb_source` added, is the knowledge base."""
    every = None
    for name, samples in sources.items():
        part = samples.withColumn("kb_source", F.lit(name))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    names = F.explode(F.array(*[F.lit(name) for name in sources]))
    targets = _targets(every, target, {1: pos, 0: neg}).select(names.alias("kb_source"), target, "target_n")
    return stratified_sample_by(every, ["kb_source", target], targets, seed, row_id, content)


def sample_report(samples: DataFrame, *by: str) -> DataFrame:
    return samples.groupBy(*by).agg(F.count("*").alias("n"))


def evaluation_set(samples: DataFrame, size: int, seed: int | str, row_id: str, content: Sequence[str],
                   target: str = "target", cwe: str = "cwe", project: str = "project") -> DataFrame:
    """All positives plus stratified negatives up to `size`; positives alone if they fill it.

    The room for negatives is a column, so nothing is counted on the driver.
    """
    positives = samples.where(F.col(target) == 1)
    room = positives.agg(F.greatest(F.lit(size) - F.count("*"), F.lit(0)).cast("bigint").alias("target_n"))
    negatives = stratified_sample_by(samples.where(F.col(target) == 0), [], room, seed, row_id, content, cwe, project)
    return positives.unionByName(negatives)


def stratified_holdout(rows: DataFrame, label: str, row_id: str, share: float, seed: int | str) -> DataFrame:
    """Add `is_val`: per class, round(share * n) rows of lowest hash.  Narrow rank, then one join."""
    keyed = rows.select(label, row_id, seeded_hash(seed, F.col(row_id)).alias("_hash"))
    quotas = keyed.groupBy(label).agg(F.bround(F.count("*") * F.lit(share)).cast("bigint").alias("take"))
    held = lowest_hashes(keyed, [label], quotas, row_id, "_hash").select(row_id, F.lit(True).alias("_held"))
    return rows.join(held, row_id, "left").withColumn("is_val", F.coalesce("_held", F.lit(False))).drop("_held")


def shuffled(rows: DataFrame, seed: int | str, row_id: str) -> DataFrame:
    """Rows in a reproducible random order, for writing training files."""
    return rows.orderBy(seeded_hash(seed, F.col(row_id)), F.col(row_id))
