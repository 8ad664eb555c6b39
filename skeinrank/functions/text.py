"""Functions of text and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(text: Column) -> Column:
    """Runs of anything but Unicode white space, as written: no lower-casing, no stripping; null and empty give no tokens."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"[^\p{IsWhite_Space}]+"), F.lit(0)), F.array().cast("array<string>"))


def token_count(text: Column) -> Column:
    """How many tokens tokenize() gives, without making them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\p{IsWhite_Space}]+")), F.lit(0))


def url_slashes(url: Column) -> Column:
    return F.regexp_count(F.coalesce(url, F.lit("")), F.lit("/"))


def url_length(url: Column) -> Column:
    """In bytes."""
    return F.octet_length(F.coalesce(url, F.lit("")))
