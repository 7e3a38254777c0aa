"""Labels, codes, schemas: the fixed vocabulary every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

# Labels, response codes, merge ranks, size bound, stage names.
VALID = "Valid"
MALIGN = "Malign"
CRISIS = "Crisis"
ERROR = "Server Error"
LABELS = (VALID, MALIGN, CRISIS, ERROR)
LABEL_CODES = {VALID: 100, MALIGN: 400, CRISIS: 406, ERROR: 500}
LABEL_RANKS = {VALID: 0, ERROR: 1, MALIGN: 2, CRISIS: 3}
MAX_CHARS = 8192
INTEGRITY_REASON = "System integrity error"
RULE_STAGE = "deterministic"
SEMANTIC_STAGE = "semantic_bert"
ATTACK_STAGE = "attack_detection"

# Raw model label -> label, keys upper case.
CLINICAL_LABELS = {
    "LABEL_0": VALID,
    "LABEL_1": CRISIS,
    "SAFE": VALID,
    "UNSAFE": MALIGN,
    "TOXIC": MALIGN,
    "NORMAL": VALID,
    "SUICIDE": CRISIS,
    "CRISIS": CRISIS,
}
INJECTION_LABELS = {"SAFE": VALID, "INJECTION": MALIGN}
INJECTION_MODEL = "ProtectAI/deberta-v3-base-prompt-injection-v2"
INJECTION_THRESHOLD = 0.85


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()

PROMPT = _struct(prompt_id=_S, text=_S, session_id=_S)
KEYWORD_ROW = _struct(bank=_S, category=_S, level=_I, keyword=_S, folded=_S, words=_I)
PATTERN_ROW = _struct(ord=_I, id=_S, description=_S, pattern=_S)
STAGE_RESULT = _struct(
    stage_name=_S, label=_S, confidence=_D, triggered_by=_S, short_circuit=_B, duration_ms=_D
)
STAGE_ERROR = _struct(stage=_S, type=_S, message=_S)
TRACE_ENTRY = _struct(
    stage=_S, label=_S, score=_D, triggered_by=_S, short_circuit=_B, duration_ms=_D
)
VERDICT_DATA = T.StructType(
    [
        T.StructField("processed_text", _S),
        T.StructField("confidence_score", _D),
        T.StructField("metadata", T.MapType(_S, _S)),
    ]
)
# What a scorer hands back to the JVM for one prompt.
SCORED = _struct(label=_S, score=_D, error_type=_S, error_message=_S, duration_ms=_D)
# What a row-at-a-time custom stage hands back for one prompt.
CUSTOM_OUTCOME = _struct(
    label=_S,
    confidence=_D,
    triggered_by=_S,
    short_circuit=_B,
    error_type=_S,
    error_message=_S,
    duration_ms=_D,
)
