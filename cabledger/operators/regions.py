"""Totals by city, where spellings that differ in case, accents or trailing blanks are one city."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cabledger.functions.text import folded


def merge_cities(df: DataFrame, partial: dict[str, Column], final: dict[str, Column]) -> DataFrame:
    """Two-step totals: by exact spelling first (hashed, combined in the map tasks), then across spellings.

    Only the few spellings reach the collated grouping, which has to sort.
    """
    exact = df.groupBy("city").agg(*[c.alias(n) for n, c in partial.items()])
    merged = exact.groupBy(folded(F.col("city")).alias("_city")).agg(
        F.min("city").alias("city"), *[c.alias(n) for n, c in final.items()])
    return merged.drop("_city")
