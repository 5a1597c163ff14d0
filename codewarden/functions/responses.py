"""Model responses: validation, clean-up and certainty measures."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.functions import constants as K
from codewarden.functions import loose
from codewarden.functions.once import pin


def unquote_booleans(content: Column) -> Column:
    plain = F.replace(content, F.lit('"true"'), F.lit("true"))
    return F.replace(plain, F.lit('"false"'), F.lit("false"))


def evidence_map(record: Column, name: str = "evidence") -> Column:
    """Map of evidence flags: booleans stay, text is compared with `true`, integers with zero;
    nulls, fractions, lists and objects are dropped."""
    raw = F.try_variant_get(record, f"$.{name}", "map<string,variant>")

    def flag(_, value):
        shape = F.schema_of_variant(value)
        as_text = F.try_variant_get(value, "$", "string")
        return (
            F.when(shape == "BOOLEAN", as_text == "true")
            .when(shape == "STRING", F.lower(as_text) == "true")
            .when(shape == "BIGINT", as_text.try_cast("decimal(38,0)") != 0)
        )

    flags = F.map_filter(F.transform_values(raw, flag), lambda _, v: v.isNotNull())
    return F.coalesce(flags, F.create_map().cast("map<string,boolean>"))


def clamp_confidence(value: Column) -> Column:
    """Percentages become fractions, then the value is held in [0, 1]."""
    scaled = F.when(value > 1.0, value / 100.0).otherwise(value)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))


RESPONSE_FIELDS = ("thought_process", "static_analysis_review", "final_decision", "confidence", "cwe_id")


def _numeric(name: str) -> Column:
    shape, value = loose.kind(name), loose.text(name)
    return (
        F.when(shape == "BOOLEAN", (value == "true").cast("double"))
        .when(shape.isin("BIGINT", "DOUBLE", "FLOAT", "STRING") | F.startswith(shape, F.lit("DECIMAL")),
              value.try_cast("double"))
    )


def parse_responses(answers: DataFrame, content: str = "content", out: str = "response") -> DataFrame:
    """Replace the content by a struct of the checked response.

    Reasoning, decision and confidence are required; decision and review must be known values.
    Anything else falls back to BENIGN with confidence 0 and a short note.
    """
    rows = pin(answers, {"_record": F.try_parse_json(unquote_booleans(F.col(content)))})
    rows = loose.unpack(rows, "_record", *RESPONSE_FIELDS)
    known = lambda name, values: F.coalesce(loose.text(name).isin(*values), F.lit(False))
    problem = (
        F.when(F.col("_record").isNull(), F.lit("not valid JSON"))
        .when(F.coalesce(loose.kind("thought_process") != "STRING", F.lit(True)),
              F.lit("thought_process missing or no text"))
        .when(~known("final_decision", K.DECISIONS), F.lit("final_decision missing or unknown"))
        .when(_numeric("confidence").isNull(), F.lit("confidence missing or no number"))
        .when(~loose.missing("static_analysis_review") & ~known("static_analysis_review", K.REVIEWS),
              F.lit("static_analysis_review unknown"))
        .when(loose.kind("cwe_id").isNotNull() & ~loose.kind("cwe_id").isin("STRING", "VOID"),
              F.lit("cwe_id is no text"))
    )
    rows = pin(rows, {"_problem": problem, "_evidence": evidence_map(F.col("_record"))})
    bad = F.col("_problem").isNotNull()
    note = F.concat(F.lit("[SYSTEM FALLBACK] JSON Parse Failure: "), F.substring("_problem", 1, 50), F.lit("..."))
    evidence = F.when(bad, F.create_map().cast("map<string,boolean>")).otherwise(F.col("_evidence"))
    response = F.struct(
        (~bad).alias("valid"),
        F.when(bad, note).otherwise(loose.text("thought_process")).alias("thought_process"),
        F.when(bad, F.lit("UNCERTAIN")).otherwise(
            F.coalesce(loose.text("static_analysis_review"), F.lit("AGREE"))).alias("static_analysis_review"),
        evidence.alias("evidence"),
        F.when(bad, F.lit("BENIGN")).otherwise(loose.text("final_decision")).alias("final_decision"),
        F.when(bad, F.lit(0.0)).otherwise(clamp_confidence(_numeric("confidence"))).alias("confidence"),
        F.when(bad, F.lit("Unknown")).otherwise(loose.text("cwe_id")).alias("cwe_id"),
        (~bad & (F.size("_evidence") > K.MANY_EVIDENCE_KEYS)).alias("many_evidence"),
    )
    return rows.select(*[c for c in answers.columns if c != content], response.alias(out))


def _probabilities(logprobs: Column) -> Column:
    kept = F.filter(logprobs, lambda p: p["logprob"].isNotNull())
    return F.transform(kept, lambda p: F.exp(p["logprob"]))


def native_confidence(logprobs: Column, default: float = 0.5) -> Column:
    """Mean token probability."""
    probs = _probabilities(logprobs)
    total = F.aggregate(probs, F.lit(0.0), lambda acc, p: acc + p)
    return F.when(F.size(probs) > 0, total / F.size(probs)).otherwise(F.lit(default))


def entropy(logprobs: Column) -> Column:
    """Sum of -p ln p over the tokens; it grows with the length of the response."""
    probs = _probabilities(logprobs)
    total = F.aggregate(probs, F.lit(0.0), lambda acc, p: acc - p * F.log(p + F.lit(1e-10)))
    return F.coalesce(F.when(F.size(probs) > 0, total), F.lit(0.0))
