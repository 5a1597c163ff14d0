"""Prompt text as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from codewarden.functions import constants as K
from codewarden.functions.text import drop_control_chars

# --- Fixed values: section layout of the audit prompt and of the second-round text. ---
_SECTIONS = (
    "\n    **SEC 1: SYSTEM METRICS**\n    - Complexity: ",
    "\n    - API Density: ",
    "\n    - **Static Data Flow**: **",
    "**\n    \n\n    **SEC 2: CONTEXTUAL RAG SAMPLES**\n    ",
    "\n\n    **SEC 3: METHODOLOGY & CONSTRAINTS**\n    ",
    "\n    ",
    "\n\n    **SEC 4: TARGET CODE FOR AUDIT**\n    ",
    "\n\n    Apply the protocol step-by-step. Output JSON with traced evidence.\n    ",
)
_REBUTTAL = (
    "\n\n**[SYSTEM AUDIT INTERVENTION]**\n"
    "Your analysis predicted VULNERABLE, but detected conflicting evidence:\n"
    "- Static Analysis: ",
    "\n- Calibrated Probability: ",
    " (Low Confidence)\n\n"
    "**REFLECTION REQUIRED**:\n"
    "1. If you cannot identify a decisive LOGIC/RACE/INTEGER flaw -> **CORRECT to BENIGN**.\n"
    "2. If flaw is strictly independent of data flow -> **MAINTAIN VULNERABLE**.\n\n"
    "Wait: If you are uncertain (< 30% confidence), strictly Default to Safe.",
)


def evidence_text(source_type: Column, has_flow: Column) -> Column:
    return (
        F.when((source_type == K.SOURCE_DATAFLOW) & has_flow, F.lit(K.EVIDENCE_CONFIRMED))
        .when(source_type == K.SOURCE_DATAFLOW, F.lit(K.EVIDENCE_CLEARED))
        .when(source_type == K.SOURCE_LEXICAL, F.lit(K.EVIDENCE_HINT))
        .otherwise(F.lit(K.EVIDENCE_UNKNOWN))
    )


def constraint_text(source_type: Column, has_flow: Column, density: Column, low_density: float = 0.3) -> Column:
    """Up to three rule lines, or the default line."""
    traced = source_type == K.SOURCE_DATAFLOW
    rules = F.array_compact(F.array(
        F.when(traced & ~has_flow, F.lit(K.RULE_NO_FLOW)),
        F.when(density < low_density, F.lit(K.RULE_LOW_DENSITY)),
        F.when(~traced, F.lit(K.RULE_NO_GRAPH)),
    ))
    return F.when(F.size(rules) > 0, F.array_join(rules, K.RULE_SEPARATOR)).otherwise(F.lit(K.RULE_DEFAULT))


def hits_text(hits: Column, limit: int = K.RETRIEVED_TEXT_CHARS) -> Column:
    """One line per hit, in rank order; `hits` is an array of (rank, original_id, label, similarity)."""
    lines = F.transform(F.array_sort(hits), lambda h: F.concat(
        F.lit("[Ref:"), h["original_id"], F.lit(" | Sim:"),
        (h["similarity"] * 100).cast("int").cast("string"), F.lit("%] "), h["label"], F.lit("\n")))
    text = F.substring(F.array_join(lines, ""), 1, limit)
    return F.when(F.coalesce(F.size(hits), F.lit(0)) > 0, text).otherwise(F.lit(K.NO_HITS_TEXT))


def audit_prompt(code: Column, complexity: Column, density: Column, evidence: Column, hits: Column,
                 rules: Column, few_shot: str = "") -> Column:
    target = F.when(
        F.length(code) > K.PROMPT_CODE_CHARS,
        F.concat(F.substring(code, 1, K.PROMPT_CODE_CHARS), F.lit(K.TRUNCATION_MARK)),
    ).otherwise(code)
    values = [complexity.cast("string"), F.format_string("%.4f", density), evidence, hits,
              F.lit(few_shot), rules, target]
    pieces = []
    for label, value in zip(_SECTIONS, values):
        pieces += [F.lit(label), value]
    return F.concat(*pieces, F.lit(_SECTIONS[-1]))


def as_sent(prompt: Column, system: str = "") -> Column:
    """What goes to the model: both parts named if there is a system text, no control characters."""
    text = F.concat(F.lit(f"System: {system}\nUser: "), prompt) if system else prompt
    return drop_control_chars(text)


def rebuttal_prompt(first_prompt: Column, evidence: Column, score: Column) -> Column:
    return F.concat(first_prompt, F.lit(_REBUTTAL[0]), evidence, F.lit(_REBUTTAL[1]),
                    F.format_string("%.2f", score), F.lit(_REBUTTAL[2]))
