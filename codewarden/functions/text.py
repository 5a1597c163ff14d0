"""Text keys and clean-up."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from codewarden.functions.constants import WHITESPACE
from codewarden.functions.once import let

def strip(text: Column) -> Column:
    """Trim Unicode white space on both sides; linear in the text, unlike an anchored regex."""
    return F.trim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """Split on runs of white space, without empty pieces.

    All white space becomes a blank first: splitting on one plain character needs no regex.
    """
    blanks = F.translate(text, WHITESPACE, " " * len(WHITESPACE))
    return F.array_remove(F.split(blanks, " "), "")


def query_words(text: Column) -> Column:
    """`words`, with one placeholder for a blank query."""
    return let(words(text), lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(F.lit("void"))))


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[none_if_empty(c) for c in columns])


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def stable_ratio(key: Column) -> Column:
    """The first 32 bits of the key's md5 as a number in [0, 1)."""
    bits = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double")
    return bits / F.lit(float(16 ** 8))


def content_md5(text: Column) -> Column:
    """md5 of the stripped text: equal for copies that differ in outer white space only."""
    return F.md5(strip(text))


def drop_control_chars(text: Column) -> Column:
    """Remove control characters but keep tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def commit_id_from_link(link: Column) -> Column:
    """The path segment after the last `commit/`, else the last segment."""
    after_commit = F.split_part(F.element_at(F.split(link, "commit/"), -1), F.lit("/"), F.lit(1))
    last_segment = F.element_at(F.split(link, "/"), -1)
    return (
        F.when(none_if_empty(link).isNull(), F.lit("unknown"))
        .when(F.contains(link, F.lit("commit/")), after_commit)
        .otherwise(last_segment)
    )


def cwe_from_digits(cwe: Column) -> Column:
    """`398` becomes `CWE-398`; nothing becomes `None`."""
    clean = strip(cwe)
    return (
        F.when(cwe.isNull() | F.lower(clean).isin("none", "null", ""), F.lit("None"))
        .when(clean.rlike("^[0-9]+$"), F.concat(F.lit("CWE-"), clean))
        .otherwise(clean)
    )


def cwe_upper(cwe: Column) -> Column:
    """Upper-case, drop list brackets kept as text, map every spelling of nothing to `N/A`."""
    clean = F.upper(strip(cwe))
    for piece in ("['", "']", '["', '"]'):
        clean = F.replace(clean, F.lit(piece), F.lit(""))
    return F.when(
        cwe.isNull() | clean.isin("", "NON", "NONE", "NULL", "N/A"), F.lit("N/A")
    ).otherwise(clean)


def canonical_cwe(cwe: Column) -> Column:
    """One spelling for every source: `CWE-n` in upper case, or `N/A`."""
    upper = cwe_upper(cwe)
    return F.when(upper.rlike("^[0-9]+$"), F.concat(F.lit("CWE-"), upper)).otherwise(upper)


def task_name(split: Column, commit_id: Column, line_index: Column) -> Column:
    """Unique task key `split_commit_line`."""
    return F.concat_ws("_", split, F.coalesce(none_if_empty(commit_id), F.lit("unk")),
                       line_index.cast("string"))


def kb_key(file_name: Column, row_index: Column, commit_id: Column) -> Column:
    """Unique knowledge-base key `file_index_commit`, the commit cut to 32 characters."""
    short = F.substring(F.coalesce(none_if_empty(commit_id), F.lit("unk")), 1, 32)
    return F.concat_ws("_", file_name, row_index.cast("string"), short)


def clip_for_embedding(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def unit_vector(vector: Column, tiny: float = 1e-10) -> Column:
    """Scale to length one; vectors of (nearly) no length stay as they are."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return let(norm, lambda n: F.when(n > tiny, F.transform(wide, lambda x: x / n)).otherwise(wide))
