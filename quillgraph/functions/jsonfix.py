"""JSON that a model wrote, as rows; text that is almost JSON is repaired.

Rows that parse as they are never reach Python.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fences, and what stands for what in text that is almost JSON; in this order.
FENCES = ((re.compile(r"^```(?:json|python|javascript|text)?\s*\n?", re.I), ""), (re.compile(r"\n?```\s*$"), ""))
REPAIRS = (
    (re.compile(r",(\s*[}\]])"), r"\1"), (re.compile(r"\bTrue\b"), "true"), (re.compile(r"\bFalse\b"), "false"),
    (re.compile(r"\bNone\b"), "null"), (re.compile(r"//[^\n]*"), ""),
)
CLOSERS = ("]", "}", "}]")


def _apply(text: str, rules) -> str:
    for pattern, to in rules:
        text = pattern.sub(to, text)
    return text.strip()


def balanced(text: str, opens: str, closes: str) -> str:
    """The first part from ``opens`` to its ``closes``, brackets in strings aside; empty if there is none."""
    start, depth = text.find(opens), 0
    if start < 0:
        return ""
    for token in re.finditer(rf'"(?:\\.|[^"\\])*(?:"|$)|{re.escape(opens)}|{re.escape(closes)}', text[start:], re.S):
        depth += (token[0] == opens) - (token[0] == closes)
        if not depth and token[0] == closes:
            return text[start : start + token.end()]
    return ""


def _readings(text: str) -> Iterator[str]:
    """Texts that may be the JSON that was meant, the likeliest first."""
    text = text.strip()
    yield text
    text = _apply(text, FENCES)
    yield text
    repaired = _apply(text, REPAIRS)
    yield repaired
    for pair in ("[]", "{}"):
        if part := balanced(text, *pair):
            yield part
            yield _apply(part, REPAIRS)
    for closer in CLOSERS:
        yield repaired + closer


def repair(text: str | None) -> str | None:
    """The first reading that parses, as JSON text; null if none does."""
    for reading in _readings(text) if text else ():
        try:
            return json.dumps(json.loads(reading), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def _repair(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: repair(t) if isinstance(t, str) else None)


def repair_column(rows: DataFrame, column: str = "response") -> DataFrame:
    """Rows with ``json`` and ``repaired``; only texts that aren't JSON are repaired."""
    fine = F.try_parse_json(column).isNotNull()
    good = rows.where(fine).withColumn("json", F.col(column)).withColumn("repaired", F.lit(False))
    bad = rows.where(~fine | F.col(column).isNull()).withColumn("json", _repair(F.col(column))).withColumn("repaired", F.lit(True))
    return good.unionByName(bad)


def clamp(value: Column, missing: float = 0.7) -> Column:
    """A number within 0 and 1: ``missing`` for null, the middle for text that is no number."""
    number = value.cast("string").try_cast("double")
    return F.when(value.isNull(), F.lit(missing)).when(number.isNull() | F.isnan(number), F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))


def allowed(value: Column, values: tuple[str, ...], default: str) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin(*values), low).otherwise(default)


CONCEPT = "struct<concept_name:string,description:string,specificity_level:string,confidence:string>"
CLAIM = "struct<claim_text:string,related_concept:string,claim_type:string,confidence:string>"


def _objects(rows: DataFrame, json: str, schema: str) -> DataFrame:
    """Rows with ``position`` and ``_c`` for each element of an array that is an object; other elements are passed over."""
    each = rows.select("*", F.posexplode(F.from_json(json, "array<string>")).alias("position", "_e")).where(F.startswith(F.ltrim("_e"), F.lit("{")))
    return each.withColumn("_c", F.from_json("_e", schema)).drop("_e")


def concept_rows(rows: DataFrame, json: str = "json") -> DataFrame:
    """Concepts of a model's answers, typed: blank names are dropped, unknown levels are ``medium``."""
    each = _objects(rows, json, CONCEPT)
    out = each.withColumn("name", F.trim("_c.concept_name")).where("name <> ''")
    return out.select(*rows.columns, "position", "name", F.trim(F.coalesce("_c.description", F.lit(""))).alias("description"), allowed(F.col("_c.specificity_level"), ("broad", "medium", "specific"), "medium").alias("specificity_level"), clamp(F.col("_c.confidence")).alias("confidence"))


def claim_rows(rows: DataFrame, json: str = "json") -> DataFrame:
    """Claims of a model's answers, typed: blank texts are dropped, unknown types are ``supports``."""
    each = _objects(rows, json, CLAIM)
    out = each.withColumn("claim_text", F.trim("_c.claim_text")).where("claim_text <> ''")
    return out.select(*rows.columns, "position", "claim_text", F.trim(F.coalesce("_c.related_concept", F.lit(""))).alias("related_concept"), allowed(F.col("_c.claim_type"), ("supports", "contradicts", "extends", "complements"), "supports").alias("claim_type"), clamp(F.col("_c.confidence")).alias("confidence"))
