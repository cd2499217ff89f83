"""Column helpers shared by the operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def packed(rows: DataFrame, **keys: Column) -> DataFrame:
    """Each row as one struct ``_in`` beside computed keys, so that no column of
    the table can clash with them."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_in"), *[k.alias(name) for name, k in keys.items()])


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"_in.`{c}`").alias(c) for c in columns])
