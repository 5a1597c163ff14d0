"""URL filter: rules for hosts and paths, and a weighted vocabulary of strict and soft terms.

An Aho-Corasick automaton finds every term of the vocabulary in a lower-cased url in one pass.  A hit
counts only between boundaries: the characters beside it are no letters or digits (of any script).  One
strict term rejects; so do soft terms once the weights of the distinct ones reach a bound.  Rules go
first: of those that fit a url the longest decides.

Rules and vocabulary are parameters of bounded size, checked; they are sent with the task.

Nulls and ties: a null url, or one without ://, has an empty host and path, fits no rule, and is judged
by its terms (null: none, allowed).  Rows are judged one by one, repeated ones alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRICT = ("porn", "xxx", "adult-x", "spam-farm", "casino-win", "sex-cam", "viagra", "malware", "phishing", "torrent-crack")
SOFT = {"casino": 1.0, "bets": 1.0, "bet": 1.0, "poker": 1.0, "adult": 1.0, "pills": 1.0, "cheap": 0.5, "free": 0.5, "win": 0.5,
        "ads": 0.5, "track": 0.5, "spam": 1.0, "farm": 0.5, "loan": 0.5, "bonus": 0.5, "crack": 1.0, "warez": 1.0}
SOFT_BOUND = 1.0
LEAST_SOFT = 2  # distinct soft terms, at least
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MOST_TERMS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)


class Vocabulary:
    def __init__(self, strict: tuple[str, ...], soft: dict[str, float]) -> None:
        self.automaton = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            self.automaton.add_word(term, (len(term), term, term in strict, soft.get(term, 0.0)))
        self.automaton.make_automaton()

    def hits(self, url: str) -> tuple[list[str], dict[str, float]]:
        """Distinct strict terms, and distinct soft terms with their weights, that stand between boundaries."""
        strict, soft = set(), {}
        text = url.translate(_FOLD)
        for last, (size, term, is_strict, weight) in self.automaton.iter(text):
            first = last - size + 1
            if (first and text[first - 1].isalnum()) or (last + 1 < len(text) and text[last + 1].isalnum()):
                continue
            if is_strict:
                strict.add(term)
            if weight:
                soft[term] = weight
        return sorted(strict), dict(sorted(soft.items()))


class Rules:
    """Rules by host; a url's host and its parents are looked up, longest rule first."""

    def __init__(self, rules: tuple[tuple[str, str], ...]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, action in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, action))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, at = (None, None), 0
        while at >= 0:
            for start, rule, action in self.by_host.get(host[at:], ()):
                if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                    best = rule, action
            at = host.find(".", at) + 1 or -1
        return best


def filter_urls(pages: DataFrame, key: str = "page_id", strict: tuple[str, ...] = STRICT, soft: dict[str, float] | None = None,
                bound: float = SOFT_BOUND, least: int = LEAST_SOFT, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """`key` with host, path, the rule that decided (or null), the verdict, and the terms that were met."""
    soft = SOFT if soft is None else soft
    if len(strict) + len(soft) + len(rules) > MOST_TERMS:
        raise ValueError(f"a vocabulary and rules of more than {MOST_TERMS} entries are too large to send to tasks")
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    rows = pages.select(key, "url", host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, known = Vocabulary(strict, soft), Rules(rules)
        for batch in batches:
            found, verdict, hard, weak, weight = [], [], [], [], []
            for url, host, path in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                rule, action = known.find(host, path)
                strict_hits, soft_hits = terms.hits(url or "")
                total = sum(soft_hits.values())
                bad = bool(strict_hits) or (len(soft_hits) >= least and total >= bound)
                found.append(rule)
                verdict.append(action or ("block" if bad else "allow"))
                hard.append(",".join(strict_hits))
                weak.append(",".join(soft_hits))
                weight.append(float(total))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(found, pa.string()), pa.array(verdict, pa.string()),
                                              pa.array(hard, pa.string()), pa.array(weak, pa.string()), pa.array(weight, pa.float64())],
                                             names=[key, "host", "path", "rule", "verdict", "strict_terms", "soft_terms", "soft_weight"])

    kind = pages.schema[key].dataType.simpleString()
    rows = rows.select(key, "url", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    return rows.mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string, strict_terms string, soft_terms string, soft_weight double")


def oracle_sql(strict: tuple[str, ...] = STRICT, soft: dict[str, float] | None = None, bound: float = SOFT_BOUND,
               least: int = LEAST_SOFT, rules: tuple[tuple[str, str], ...] = RULES) -> str:
    """The same in SQL with one regular expression for each term; letters beyond ASCII as \\p classes."""
    soft = SOFT if soft is None else soft

    def hit(term: str) -> str:
        return rf"CASE WHEN regexp_matches(low, '(^|[^\p{{L}}\p{{N}}]){term}([^\p{{L}}\p{{N}}]|$)') THEN 1 ELSE 0 END"

    def fits(rule: str) -> str:
        name, slash, path = rule.partition("/")
        return f"((host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + path}'))"

    ordered = sorted(rules, key=lambda r: -len(r[0]))
    best = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in ordered) + " END"
    action = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{a}'" for r, a in ordered) + " END"
    hard = f"coalesce(array_to_string([{', '.join(f"CASE WHEN {hit(t)} = 1 THEN '{t}' END" for t in sorted(strict))}], ','), '')"
    weak = f"coalesce(array_to_string([{', '.join(f"CASE WHEN {hit(t)} = 1 THEN '{t}' END" for t in sorted(soft))}], ','), '')"
    weight = " + ".join(f"{w} * {hit(t)}" for t, w in sorted(soft.items()))
    number = " + ".join(hit(t) for t in sorted(soft))
    return f"""
WITH a AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
                  translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low FROM pages),
b AS (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, {best} AS rule, {hard} AS strict_terms, {weak} AS soft_terms, CAST({weight} AS DOUBLE) AS soft_weight, {number} AS n_soft FROM b)
SELECT page_id, host, path, rule, coalesce({action}, CASE WHEN strict_terms <> '' OR (n_soft >= {least} AND soft_weight >= {bound}) THEN 'block' ELSE 'allow' END) AS verdict,
       strict_terms, soft_terms, soft_weight FROM c"""
