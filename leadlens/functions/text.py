"""Tokenisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_text(text: Column) -> Column:
    """Lower-case ASCII word tokens (runs of [a-z0-9]; everything else separates), one space apart."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """The tokens as an array."""
    return F.filter(F.split(token_text(text), " "), lambda t: t != F.lit(""))
