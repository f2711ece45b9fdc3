"""From raw export rows to clean, canonical complaints."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from themescope import fixed_values as fv
from themescope.functions.dates import day_text, parse_utc
from themescope.functions.nulls import has_prefix, not_listed, whole_id
from themescope.functions.text import clean_text, squeezed_word_count, truncate_words, word_count
from themescope.operators.small import small_side


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail before any work starts if a column is missing, naming all that are."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def select_renamed(raw: DataFrame) -> DataFrame:
    """The ten columns that are used, under their working names."""
    require_columns(raw, [*fv.COLUMN_MAP, *fv.TRUTH_COLUMNS])
    return raw.select(
        *[F.col(f"`{old}`").alias(new) for old, new in fv.COLUMN_MAP.items()],
        *[F.col(f"`{name}`") for name in fv.TRUTH_COLUMNS],
    )


def typed_key(df: DataFrame, key: str = "complaint_id") -> DataFrame:
    """Integer key; rows without one are dropped."""
    return df.withColumn(key, whole_id(F.col(key).cast("string"))).filter(F.col(key).isNotNull())


def canonical_label(label: Column, mapping: Mapping[str, str] = fv.CANONICAL_PRODUCT) -> Column:
    """Look a label up in a fixed list of variants; unknown labels pass through.

    The list is part of the plan, so no join is needed.
    """
    table = F.create_map(*[F.lit(text) for pair in mapping.items() for text in pair])
    return F.coalesce(F.try_element_at(table, label), label)


def canonicalise(df: DataFrame, label: str, dimension: DataFrame) -> DataFrame:
    """Same lookup with the variants in a table ``(variant, canonical)``."""
    names = small_side(dimension.select(F.col("variant").alias(label), "canonical"))
    return (
        df.join(names, label, "left")
        .withColumn(label, F.coalesce("canonical", label))
        .drop("canonical")
        .select(df.columns)
    )


def drop_labels(df: DataFrame, label: str, listed: Iterable[str] = fv.DROP_PRODUCTS) -> DataFrame:
    return df.filter(not_listed(F.col(label), listed))


def since(df: DataFrame, date: str = "date", minimum: str = fv.MIN_DATE) -> DataFrame:
    """Rows on or after a day; text that is no date counts as missing and is dropped."""
    kind = dict(df.dtypes)[date]
    when = parse_utc(F.col(date)) if kind == "string" else F.col(date)
    return df.filter(when >= F.lit(minimum).cast("date" if kind == "date" else "timestamp"))


def is_stratum(label: Column, prefix: str = fv.STRATUM_PREFIX) -> Column:
    return has_prefix(label, prefix)


def with_clean_text(df: DataFrame, text: str = "narrative") -> DataFrame:
    """Replace the text by its clean form and add ``word_count``."""
    return computed_once(df, text, clean_text(F.col(text))).withColumn(
        "word_count", squeezed_word_count(F.col(text))
    )


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Set or add a column whose expression is costly and whose value is used several times.

    A filter on a plain projected column is pushed below the projection, with the expression
    repeated at each use.  A generator is a barrier to that: a one-element array is exploded.
    """
    cell = F.explode(F.array(value)).alias(name)
    columns = df.columns if name in df.columns else [*df.columns, name]
    return df.select(*[cell if c == name else F.col(f"`{c}`") for c in columns])


def with_word_count(df: DataFrame, text: str = "narrative") -> DataFrame:
    """Add ``word_count`` of text in any form."""
    return computed_once(df, "word_count", word_count(F.col(text)))


def length_band(df: DataFrame, low: int = fv.MIN_WORDS, high: int = fv.MAX_WORDS) -> DataFrame:
    return df.filter(F.col("word_count").between(low, high))


def truncate_text(df: DataFrame, text: str = "narrative", words: int = fv.KEEP_WORDS) -> DataFrame:
    """Keep the first words of clean text and count again."""
    return df.withColumn(text, truncate_words(F.col(text), words)).withColumn(
        "word_count", squeezed_word_count(F.col(text))
    )


def load_and_clean(raw: DataFrame) -> DataFrame:
    """Raw rows to usable complaints: one narrow pass, no shuffle.

    Cheap tests come first, so the regex work is spent only on rows that can still be kept.
    """
    named = select_renamed(raw).filter(F.col("narrative").isNotNull())
    keyed = typed_key(named).withColumn("product", canonical_label(F.col("product")))
    dated = (
        drop_labels(keyed, "product")
        .withColumn("date", parse_utc(F.col("date")).cast("date"))
        .dropna(subset=["date", "Issue"])
    )
    return length_band(with_clean_text(dated))


def split_truth(clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model's input table and the held-out labels, as two tables that share only the key."""
    seen = clean.select(
        "complaint_id", "date", "product", "sub_product", "company", "state", "channel",
        "narrative", "word_count",
    )
    truth = clean.select("complaint_id", *[F.col(f"`{name}`") for name in fv.TRUTH_COLUMNS])
    leaked = set(seen.columns) & set(fv.TRUTH_COLUMNS)
    if leaked:
        raise AssertionError(f"label columns in the input table: {sorted(leaked)}")
    return seen, truth


def with_day_text(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumn(date, day_text(F.col(date)))
