"""Text normalisation and measures, all inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from themescope.fixed_values import (
    CHARS_PER_TOKEN, CLEAN_RULES, CLEAN_TRIGGERS, KEEP_WORDS, OUTER_WHITESPACE, WHITESPACE_RUN, WORD,
)


def strip(text: Column) -> Column:
    """Drop leading and trailing whitespace of any script (``trim`` knows blanks only)."""
    return F.regexp_replace(text, OUTER_WHITESPACE, "")


def squeeze(text: Column) -> Column:
    """Words joined by single blanks."""
    return F.trim(F.regexp_replace(text, WHITESPACE_RUN, " "))


def clean_text(text: Column) -> Column:
    """Collapse redactions to markers and whitespace to single blanks.

    Texts without a redaction skip the five marker rules: a substring test is far cheaper
    than five regex passes over every narrative.
    """
    ruled = F.trim(reduce(lambda c, rule: F.regexp_replace(c, *rule), CLEAN_RULES, text))
    marked = reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in CLEAN_TRIGGERS])
    return F.when(marked, ruled).otherwise(squeeze(text))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; 0 for empty text."""
    return F.regexp_count(text, F.lit(WORD))


def squeezed_word_count(text: Column) -> Column:
    """Word count of text that already went through ``squeeze`` or ``clean_text``."""
    blanks = F.length(text) - F.length(F.translate(text, " ", ""))
    return F.when(text == "", F.lit(0)).otherwise(blanks + 1).cast("int")


def truncate_words(text: Column, words: int = KEEP_WORDS) -> Column:
    """First ``words`` words of squeezed text."""
    if words < 1:
        raise ValueError("words must be at least 1")
    return F.substring_index(text, " ", words)


def token_estimate(text: Column) -> Column:
    """Rough model tokens of a text: characters over four, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN)).cast("int")


def first_words(text: Column, words: int) -> Column:
    """The first words of a text as a list."""
    return F.slice(F.split(squeeze(text), " "), 1, words)
