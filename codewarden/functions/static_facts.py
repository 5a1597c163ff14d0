"""Lexical features of source text, as built-in expressions."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from codewarden.functions import constants as K
from codewarden.functions.once import let

NO_NAMES = "array<string>"


def empty_names() -> Column:
    return F.array().cast(NO_NAMES)


def lexical_complexity(code: Column, tokens: Sequence[str] = K.COMPLEXITY_TOKENS,
                       cap: int = K.COMPLEXITY_CAP) -> Column:
    """1 plus the number of non-overlapping occurrences of each token, at most `cap`."""
    filled = F.coalesce(code, F.lit(""))
    total = F.lit(1)
    for token in tokens:
        missing = F.length(filled) - F.length(F.replace(filled, F.lit(token), F.lit("")))
        total = total + (missing / len(token)).cast("int")
    return F.least(F.lit(cap), total)


def names_used(code: Column, names: Sequence[str] = K.LEXICAL_API_NAMES, calls_only: bool = False) -> Column:
    """Sorted names that occur as whole words (or, with `calls_only`, directly before a bracket).

    All words are cut out in one pass and intersected by hash, so the cost does not grow with the
    number of names.
    """
    pattern = r"(?U)\b(\w+)\s*\(" if calls_only else r"(?U)(\w+)"
    found = F.regexp_extract_all(code, F.lit(pattern), F.lit(1))
    hits = F.array_intersect(found, F.array(*[F.lit(n) for n in names]))
    return F.array_sort(F.coalesce(hits, empty_names()))


def scan_names(code: Column, names: Sequence[str] = K.LEXICAL_API_NAMES) -> Column:
    """Names that are called; where there is no such call, names that occur at all."""
    return let(names_used(code, names, calls_only=True),
               lambda called: F.when(F.size(called) > 0, called).otherwise(names_used(code, names)))


def sinks_called(calls: Column, sinks: Sequence[str] = K.TOOL_SINK_NAMES) -> Column:
    """Distinct called names that contain any sink name as a substring."""
    known = F.array(*[F.lit(s) for s in sinks])
    return F.array_distinct(
        F.filter(calls, lambda call: F.exists(known, lambda s: F.contains(call, s))))


def merge_names(left: Column, right: Column) -> Column:
    return F.array_sort(F.array_union(F.coalesce(left, empty_names()), F.coalesce(right, empty_names())))


def risk_density(api_count: Column, code: Column) -> Column:
    return api_count / (F.length(code).cast("double") + F.lit(1e-9))


def length_feature(code: Column) -> Column:
    return F.log1p(F.length(code).cast("double"))


def is_long(code: Column, limit: int = K.LONG_CODE_CHARS) -> Column:
    return F.length(code) > limit


def nesting(code: Column) -> Column:
    """Bracket nesting: struct(depth, tokens, density), density being depth over token count.

    A proxy with its own definition: tokens are words, brackets and other marks.
    """
    tokens = F.regexp_count(code, F.lit(r"(?U)\w+|[^\s\w]"))
    brackets = F.regexp_extract_all(code, F.lit(r"([{}()\[\]])"), F.lit(1))
    opening = F.array(F.lit("{"), F.lit("("), F.lit("["))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(acc, mark):
        now = F.when(F.array_contains(opening, mark), acc["now"] + 1).otherwise(
            F.greatest(F.lit(0), acc["now"] - 1))
        return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))

    depth = F.aggregate(brackets, start, step)["top"]
    density = F.when(tokens > 0, depth / tokens).otherwise(F.lit(0.0))
    return F.struct(depth.alias("depth"), tokens.alias("tokens"), density.alias("density"))


# Each match starts where the last one ended (\G): a kept run of plain text and literals, then one
# comment.  The run is possessive, so the scan never goes back and stays linear in the text.
_KEPT = r"\G((?:[^\"'/]++|\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+'|[\"']|/(?![*/]))*+)"
_COMMENT = r"(?:/\*[\s\S]*?\*/|//[^\n]*+)"


def strip_comments(code: Column) -> Column:
    """Each comment becomes one blank; string and character literals are left alone."""
    return F.regexp_replace(code, _KEPT + _COMMENT, "$1 ")


def compress(code: Column, limit: int = K.LONG_CODE_CHARS) -> Column:
    """Shorten text over `limit`: comments go first, then the middle is cut out."""
    half = limit // 2

    def cut(bare: Column, mark: str) -> Column:
        return F.concat(F.substring(bare, 1, half), F.lit(mark), F.right(bare, F.lit(half)))

    def shorten(bare: Column) -> Column:
        return (
            F.when(F.length(bare) <= limit, bare)
            .when(F.length(bare) > limit + K.CUT_ALLOWANCE, cut(bare, K.HARD_CUT_MARK))
            .otherwise(cut(bare, K.SOFT_CUT_MARK))
        )

    return F.when(is_long(code, limit), let(strip_comments(code), shorten)).otherwise(code)
