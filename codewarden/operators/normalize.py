"""Bring raw dataset records to the sample schema.  Each input holds one VARIANT column, `record`."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.functions import loose, text


def _filled_text(name: str) -> Column:
    return F.when(loose.truthy(name), loose.text(name)).otherwise(F.lit(""))


def normalize_diversevul(records: DataFrame, record: str = "record") -> DataFrame:
    """func, target, cwe, project, commit_id, dataset, the extra fields and the raw record.

    Records whose label is null or unreadable keep a null target; see `split_rejects`.
    """
    first = loose.first_item("cwe")
    cwe = F.when(loose.is_list("cwe") & first.isNotNull(), first).otherwise(
        F.coalesce(loose.text("cwe"), F.lit("None")))
    rows = loose.unpack(records, record, "func", "target", "cwe", "project", "commit_id", "hash", "size", "message")
    return rows.select(
        *[c for c in records.columns if c != record],
        _filled_text("func").alias("func"),
        loose.flag_label("target").alias("target"),
        cwe.alias("cwe"),
        loose.text("project").alias("project"),
        loose.text("commit_id").alias("commit_id"),
        F.lit("diversevul").alias("dataset"),
        loose.text("hash").alias("hash"),
        loose.whole_number("size").alias("size"),
        loose.text("message").alias("message"),
        F.col(record).alias("_raw"),
    )


def normalize_vcl(records: DataFrame, record: str = "record") -> DataFrame:
    extra = ("name", "source", "sink", "reason")
    rows = loose.unpack(records, record, "func", "label", "cwe_id", *extra)
    return rows.select(
        *[c for c in records.columns if c != record],
        _filled_text("func").alias("func"),
        loose.flag_label("label").alias("target"),
        text.cwe_from_digits(loose.text("cwe_id")).alias("cwe"),
        F.lit("vcldata").alias("dataset"),
        *[loose.text(name).alias(name) for name in extra],
        F.col(record).alias("_raw"),
    )


def normalize_devign(records: DataFrame, record: str = "record") -> DataFrame:
    """Records without code or with an unreadable label are dropped."""
    def named(name: str) -> Column:
        return F.when(loose.missing(name), F.lit("unknown")).otherwise(loose.text(name)).alias(name)

    rows = loose.unpack(records, record, "func", "commit_id", "target", "project")
    out = rows.where(loose.truthy("func")).select(
        *[c for c in records.columns if c != record],
        named("commit_id"),
        loose.text("func").alias("code"),
        loose.whole_number_or_zero_if_missing("target").alias("target"),
        F.lit("N/A").alias("cwe"),
        named("project"),
    )
    return out.where(F.col("target").isNotNull())


def unpivot_fixes(records: DataFrame, record: str = "record") -> DataFrame:
    """One fix record gives up to two samples: the text before (1) and after (0) the fix."""
    raw_cwe = F.when(loose.missing("vul_type"), F.lit("N/A")).when(
        loose.truthy("vul_type"), loose.scalar_or_first("vul_type"))

    def side(origin: str, name: str, target: int) -> Column:
        return F.struct(
            F.when(loose.truthy(name), loose.text(name)).alias("func"),
            F.lit(target).cast("bigint").alias("target"),
            F.lit(origin).alias("origin_source"),
        )

    sides = F.filter(
        F.array(side("before", "func_src_before", 1), side("after", "func_src_after", 0)),
        lambda s: s["func"].isNotNull())
    kept = [c for c in records.columns if c != record]
    rows = loose.unpack(records, record, "vul_type", "func_src_before", "func_src_after", "commit_link", "func_name")
    return rows.select(
        *kept,
        text.commit_id_from_link(loose.text("commit_link")).alias("commit_id"),
        text.cwe_upper(raw_cwe).alias("cwe"),
        F.coalesce(loose.text("func_name"), F.lit("")).alias("func_name"),
        F.explode(sides).alias("_side"),
    ).select(*kept, "commit_id", F.col("_side.func").alias("func"), F.col("_side.target").alias("target"),
             "cwe", "func_name", F.col("_side.origin_source").alias("origin_source"))


def import_tasks(records: DataFrame, split: str, record: str = "record", index: str = "line_index") -> DataFrame:
    """Task rows; a null or unreadable label drops the record, a missing one counts as 0."""
    return import_with_rejects(records, split, record, index)[0]


def import_with_rejects(records: DataFrame, split: str, record: str = "record",
                        index: str = "line_index") -> tuple[DataFrame, DataFrame]:
    """Task rows, and those that `import_tasks` drops."""
    cwe = F.coalesce(*[F.when(loose.truthy(n), loose.scalar_or_first(n)) for n in ("cwe", "cwe_id")])
    commit = F.coalesce(loose.truthy_text("commit_id"), F.lit("unk"))
    code = F.coalesce(loose.truthy_text("func"), loose.text("code"), F.lit(""))
    rows = loose.unpack(records, record, "commit_id", "func", "code", "target", "cwe", "cwe_id")
    return split_rejects(rows.select(
        text.task_name(F.lit(split), commit, F.col(index)).alias("name"),
        commit.alias("commit_id"),
        code.alias("code"),
        loose.whole_number_or_zero_if_missing("target").alias("ground_truth_label"),
        F.coalesce(cwe, F.lit("N/A")).alias("cwe_id"),
        F.lit("Pending").alias("status"),
        F.lit(split).alias("split"),
    ), "ground_truth_label")


def new_tasks(imported: DataFrame, stored: DataFrame) -> DataFrame:
    """Imported tasks whose name is not stored yet, one per name."""
    return imported.dropDuplicates(["name"]).join(stored.select("name"), "name", "left_anti")


def kb_candidates(records: DataFrame, record: str = "record", file_name: str = "file_name",
                  index: str = "row_index") -> DataFrame:
    """Knowledge-base rows with a `skip` flag for records that cannot be imported."""
    rows = loose.unpack(records, record, "func", "code", "function", "target", "label", "vuln",
                        "cwe_id", "cwe", "commit_id", "id")
    labels = ("target", "label", "vuln")
    # The first label field that is present and not null decides, even when it cannot be read.
    label = F.lit(None).cast("bigint")
    for name in reversed(labels):
        label = F.when(loose.kind(name) != "VOID", loose.whole_number(name)).otherwise(label)

    def cwe_of(name: str) -> Column:
        value = loose.text(name)
        return F.when(loose.is_list(name), loose.first_item(name)).when(
            ~F.lower(value).isin("nan", "null", "none"), value)

    rows = rows.select(
        F.col(file_name).alias("source_dataset"), F.col(index).alias("_index"),
        loose.truthy_text("func", "code", "function").alias("code"), label.alias("_label"),
        loose.truthy_text("commit_id", "id").alias("_commit"),
        F.when(loose.truthy("cwe_id"), cwe_of("cwe_id")).when(loose.truthy("cwe"), cwe_of("cwe")).alias("_cwe"))
    return rows.select(
        text.kb_key(F.col("source_dataset"), F.col("_index"), F.col("_commit")).alias("original_id"),
        "code",
        F.when(F.col("_label") == 1, F.lit("VULNERABLE")).otherwise(F.lit("BENIGN")).alias("label"),
        F.coalesce("_cwe", F.lit("N/A")).alias("cwe_id"),
        "source_dataset",
        (F.col("code").isNull() | F.col("_label").isNull()).alias("skip"),
    )


def kb_new_rows(candidates: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Importable rows whose key is not stored yet, one per key."""
    fresh = candidates.where(~F.col("skip")).drop("skip").dropDuplicates(["original_id"])
    if stored is None:
        return fresh
    return fresh.join(stored.select("original_id"), "original_id", "left_anti")


def kb_import_report(candidates: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Added and skipped rows per file, with a TOTAL row."""
    seen = candidates.groupBy("source_dataset").agg(F.count("*").alias("seen"))
    added = new_rows.groupBy("source_dataset").agg(F.count("*").alias("added"))
    per_file = seen.join(added, "source_dataset", "left").select(
        "source_dataset", F.coalesce("added", F.lit(0)).alias("added"), "seen")
    return per_file.rollup("source_dataset").agg(
        F.sum("added").alias("added"), F.sum(F.col("seen") - F.col("added")).alias("skipped"),
    ).select(F.coalesce("source_dataset", F.lit("TOTAL")).alias("file"), "added", "skipped")


def drop_blank_code(samples: DataFrame, *code_columns: str) -> DataFrame:
    """Keep samples whose first filled code column is more than white space."""
    code = text.first_filled(*[F.col(c) for c in code_columns])
    return samples.where(~text.is_blank(code))


def blank_code_report(samples: DataFrame, *code_columns: str) -> DataFrame:
    code = text.first_filled(*[F.col(c) for c in code_columns])
    return samples.agg(
        F.count_if(~text.is_blank(code)).alias("kept"), F.count_if(text.is_blank(code)).alias("dropped"))


def split_rejects(rows: DataFrame, required: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected rows, by a required column."""
    return rows.where(F.col(required).isNotNull()), rows.where(F.col(required).isNull())
