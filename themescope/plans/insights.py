"""The report bundle: four tables over labelled complaints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from themescope import fixed_values as fv
from themescope.operators import aggregates as agg
from themescope.operators.preparation import require_columns


def generate_insights(
    output: DataFrame, top_n: int = fv.TOP_THEMES, products: list[str] | None = None
) -> dict[str, DataFrame]:
    """Top themes, themes by product, sentiment shares and monthly trend, as lazy tables.

    ``products`` also asks for the matrix form; without it the counts stay in long form, which
    needs no list of columns.
    """
    require_columns(output, fv.REPORT_COLUMNS)
    theme = "general_topic_l1"
    top = agg.top_values(output, theme, top_n)
    tables = {
        "counts": output.agg(
            F.count(F.lit(1)).alias("input_rows"), F.countDistinct(theme).alias("distinct_themes"),
            F.lit(top_n).alias("top_n"),
        ),
        "top_themes": top,
        "theme_by_product": agg.theme_product_counts(output),
        "sentiment_shares": agg.sentiment_shares(output, top),
        "monthly_trend": agg.monthly_trend(output, top),
    }
    if products:
        tables["theme_product_matrix"] = agg.theme_product_matrix(output, products)
    return tables
