"""Structured output of models: strict parsing, and repair of what nearly is JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFICIENCY = "sufficient boolean, probability double, missing_information array<string>, rationale string"


def parsed(text: Column, schema: str) -> Column:
    """The record of a JSON text; null where it is none or lacks every field."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def unfenced(text: Column) -> Column:
    """The text between code fences, or from the first brace to the last."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.when(inner != "", inner).otherwise(text)
    braces = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.when(braces != "", braces).otherwise(body)


def repaired(text: Column) -> Column:
    """The text without commas before closing brackets, and with single quotes as double ones where it has no double ones."""
    plain = F.regexp_replace(unfenced(text), r",\s*([}\]])", "$1")
    named = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\bTrue\b", "true"), r"\bFalse\b", "false"), r"\bNone\b", "null")
    return F.when(F.contains(named, F.lit('"')), named).otherwise(F.translate(named, "'", '"'))


def sufficiency(text: Column) -> Column:
    """The sufficiency record of a model's output.

    Tried in turn: the text as it is, what stands between fences or braces, the repaired text, and the fields one by one; what
    gives nothing is insufficient with probability 0. Probabilities are held between 0 and 1.
    """
    tries = [parsed(f, SUFFICIENCY) for f in (text, unfenced(text), repaired(text))]
    good = [F.when(t["sufficient"].isNotNull(), t) for t in tries]
    flag = F.lower(F.regexp_extract(text, r"(?i)[\"']?sufficient[\"']?\s*[:=]\s*[\"']?(true|false|yes|no)", 1))
    number = F.try_to_number(F.nullif(F.regexp_extract(text, r"(?i)[\"']?probability[\"']?\s*[:=]\s*[\"']?([01](?:\.\d{1,6})?)", 1), F.lit("")), F.lit("9.999999")).cast("double")
    single = F.struct(flag.isin("true", "yes").alias("sufficient"), F.coalesce(number, F.lit(0.0)).alias("probability"), F.array().cast("array<string>").alias("missing_information"), F.lit("").alias("rationale"))
    best = F.coalesce(*good, single)
    return F.struct(
        F.coalesce(best["sufficient"], F.lit(False)).alias("sufficient"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(best["probability"], F.lit(0.0)))).alias("probability"),
        F.coalesce(best["missing_information"], F.array().cast("array<string>")).alias("missing_information"), F.coalesce(best["rationale"], F.lit("")).alias("rationale"),
    )


def _value(text: Column) -> Column:
    """The one JSON value that a text is; null where it is none, or several."""
    # within brackets and within braces, since what follows a value is passed over, be it a bracket or a brace
    listed, held = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v": '), text, F.lit("}")))
    return F.when((F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1) & held.isNotNull(), F.try_variant_get(listed, "$[0]", "variant"))


def _sort(value: Column) -> Column:
    name = F.schema_of_variant(value)
    return F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("number")


def kind(text: Column) -> Column:
    """What a JSON text is: object, array, string, number, boolean or null (also where the text is null); ``not JSON`` else."""
    return F.when(text.isNull() | (F.trim(text) == "null"), "null").when(_value(text).isNull(), "not JSON").otherwise(_sort(_value(text)))


def strict(text: Column, fields: dict[str, str]) -> Column:
    """The first thing that a JSON text fails, empty where it fails nothing: it must be an object with all ``fields`` (name to kind)."""
    parts = {f: F.try_variant_get(_value(text), f"$.{f}", "variant") for f in fields}
    missing = F.array_join(F.array_compact(F.array(*[F.when(part.isNull(), F.lit(f)) for f, part in parts.items()])), ", ")
    error = F.when(text.isNull() | (kind(text) == "not JSON"), "not JSON").when(kind(text) != "object", "not an object").when(missing != "", F.concat(F.lit("missing required field(s): "), missing))
    for f, wanted in fields.items():
        error = error.when(_sort(parts[f]) != wanted, f"{f} must be {'an' if wanted[0] in 'aeiou' else 'a'} {wanted}")
    return error.otherwise("")


STATUSES = ("sufficient", "insufficient", "irrelevant", "unanswerable")


def assessment(text: Column) -> Column:
    """status, score, missing_facts and error of an assessment in an older form, which may name the score ``confidence``.

    The status counts in lower case; one that is unknown, a missing or wrongly typed score and what is no object are errors, and all else is null then.
    """
    raw = F.from_json(text, "status string, sufficiency_score double, confidence double, missing_facts array<string>")
    part = lambda f: F.try_variant_get(_value(text), f"$.{f}", "variant")
    has = lambda f: part(f).isNotNull()
    number = lambda f: _sort(part(f)) == "number"
    status = F.lower(raw["status"])
    error = (
        F.when(F.coalesce(kind(text), F.lit("")) != "object", "not an object").when(~has("sufficiency_score") & ~has("confidence"), "neither sufficiency_score nor confidence")
        .when(has("sufficiency_score") & ~number("sufficiency_score"), "sufficiency_score must be a number").when(~has("sufficiency_score") & ~number("confidence"), "confidence must be a number")
        .when(~F.coalesce(status.isin(*STATUSES), F.lit(False)), "invalid status").otherwise("")
    )
    good = lambda c: F.when(error == "", c)
    score = F.when(has("sufficiency_score"), raw["sufficiency_score"]).otherwise(raw["confidence"])
    return F.struct(good(status).alias("status"), good(score).alias("score"), good(F.coalesce(raw["missing_facts"], F.array().cast("array<string>"))).alias("missing_facts"), error.alias("error"))
