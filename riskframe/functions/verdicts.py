"""Reading model verdicts that arrive as text columns (GRD13, GRD14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.functions.columns import col

INTENT_SCHEMA = "intent string, severity string, rationale string"


def _json_object(text: Column, schema: str) -> Column:
    """The parsed object, or null when the text is not one JSON object."""
    parsed = F.from_json(text, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return F.when(text.isNotNull() & text.rlike(r"(?s)^\s*\{.*\}\s*$") & parsed["_bad"].isNull(), parsed)


def parse_verdict_json(c: Column | str, schema: str = INTENT_SCHEMA) -> Column:
    """Strict JSON, else the part from the first ``{`` to the last ``}``, else defaults.

    A parsed object that lacks a field takes that field's default as well
    (general / LOW / empty rationale); unreadable text is marked parse-failed.
    """
    text = col(c)
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    parsed = F.coalesce(_json_object(text, schema), _json_object(inner, schema))
    return F.struct(
        F.coalesce(parsed["intent"], F.lit("general")).alias("intent"),
        F.coalesce(F.upper(parsed["severity"]), F.lit("LOW")).alias("severity"),
        F.when(parsed.isNull(), "parse-failed")
        .otherwise(F.coalesce(parsed["rationale"], F.lit("")))
        .alias("rationale"),
    )


def lenient_faithful(c: Column | str) -> Column:
    """Faithful flag of a verdict that is not JSON.

    Looks for "true" within ten characters after the first "faithful" (and
    before any second one); text without the word counts as faithful.
    """
    raw = F.lower(col(c))
    after = F.split(raw, "faithful", 3)[1]
    return F.when(~raw.contains("faithful"), F.lit(True)).otherwise(F.substring(after, 1, 10).contains("true"))


def faithful_flag(c: Column | str) -> Column:
    """Faithful flag of a verdict: JSON field when readable, else the lenient rule; null is faithful."""
    text = col(c)
    parsed = _json_object(text, "faithful boolean")
    strict = F.when(parsed.isNotNull(), F.coalesce(parsed["faithful"], F.lit(True)))
    return F.coalesce(strict, lenient_faithful(text), F.lit(True))
