"""Validation of model responses: any JSON text in, typed topics and sentiment out.

All of it is built-in variant and array expressions, so a response column never leaves the JVM.
A response is usable when it is an object, an array holding an object (the first one counts), or
an array of topics.  Everything else, and an empty topic list, is a failed extraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from themescope.fixed_values import (
    DEFAULT_SENTIMENT, MAX_QUOTE_CHARS, MAX_TOPICS_PER_ROW, OUTER_WHITESPACE, SENTIMENTS,
)
from themescope.functions.nulls import or_empty
from themescope.functions.text import strip

_GUARD = 0


def boxed_json(raw: Column) -> Column:
    """The response between brackets, with a guard behind it.

    The parser stops after the first value; if anything trails it, the guard goes missing.
    """
    return F.try_parse_json(F.concat(F.lit("["), raw, F.lit(f",{_GUARD}]")))


def unbox_json(boxed: Column) -> Column:
    """The response as a variant; NULL unless its whole text was exactly one JSON value."""
    guarded = F.try_variant_get(boxed, "$[1]", "int") == _GUARD
    single = F.try_variant_get(boxed, "$[2]", "variant").isNull()
    return F.when(guarded & single, F.try_variant_get(boxed, "$[0]", "variant"))


def _kind(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def first_object(value: Column) -> Column:
    """First object inside an array; an empty one counts as none."""
    members = F.try_variant_get(value, "$", "array<variant>")
    first = F.get(F.filter(members, lambda m: _kind(m, "OBJECT")), F.lit(0))
    return F.when(F.to_json(first) != "{}", first)


def response_object(value: Column) -> Column:
    """The object that carries the answer: the value itself or the first object in it."""
    return F.when(_kind(value, "OBJECT"), value).when(_kind(value, "ARRAY"), first_object(value))


def strip_topics(topics: Column) -> Column:
    """Strip each topic, drop blank ones, keep the first of equal ones in order."""
    stripped = F.transform(topics, lambda t: F.regexp_replace(t, OUTER_WHITESPACE, ""))
    return F.array_distinct(F.filter(stripped, lambda t: t.isNotNull() & (t != "")))


def cap_topics(topics: Column) -> Column:
    """The first few topics; NULL when there is none."""
    return F.when(F.size(topics) > 0, F.slice(topics, 1, MAX_TOPICS_PER_ROW))


def coerce_sentiment(sentiment: Column) -> Column:
    """The three known values pass, all others become the default."""
    return F.when(sentiment.isin(SENTIMENTS), sentiment).otherwise(F.lit(DEFAULT_SENTIMENT))


def cut_quote(quote: Column) -> Column:
    return F.substring(or_empty(quote), 1, MAX_QUOTE_CHARS)


def read_responses(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``ok``, ``topics``, ``supporting_quote``, ``reason`` and ``sentiment`` to a response table.

    The steps are separate projections on purpose: each parsed value is used several times, and
    Spark keeps such projections apart, so every response is parsed once.
    """
    parsed = _with_answer(df, raw)
    listed = F.when(
        F.col("_answer").isNotNull(), F.try_variant_get("_answer", "$.topics", "array<string>")
    ).otherwise(F.try_variant_get("_value", "$", "array<string>"))

    def field(name: str) -> Column:
        return F.try_variant_get("_answer", f"$.{name}", "string")

    return (
        parsed.withColumn("_kept", strip_topics(listed))
        .withColumn("topics", cap_topics(F.col("_kept")))
        .withColumns({
            "ok": F.col("topics").isNotNull(),
            "supporting_quote": cut_quote(field("supporting_quote")),
            "reason": or_empty(field("reason")),
            "sentiment": coerce_sentiment(field("sentiment")),
        })
        .drop("_boxed", "_value", "_answer", "_kept")
    )


def read_labels(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``label``, the theme name of a naming response; NULL when there is none.

    Unlike topics, an array without an object holds no label.
    """
    label = strip(F.try_variant_get("_answer", "$.label", "string"))
    return (
        _with_answer(df, raw)
        .withColumn("_label", label)
        .withColumn("label", F.when(F.col("_label") != "", F.col("_label")))
        .drop("_boxed", "_value", "_answer", "_label")
    )


def _with_answer(df: DataFrame, raw: str) -> DataFrame:
    return (
        df.withColumn("_boxed", boxed_json(F.col(raw)))
        .withColumn("_value", unbox_json(F.col("_boxed")))
        .withColumn("_answer", response_object(F.col("_value")))
    )
