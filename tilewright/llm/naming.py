"""Names of internal columns that no column of a caller has, and the identity of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name = "_" + name
    return name


def text_key(text: Column | str) -> Column:
    """128 bits by which texts are told apart; null is the same as the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))
