"""Scalar functions on text and numbers that more than one operator needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u16len(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def half_up(x: Column, digits: int) -> Column:
    """Rounded to digits places, halves toward plus infinity."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole, rounded; null where whole is 0."""
    return half_up(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def tokens(text: Column) -> Column:
    """Maximal runs of letters, digits and underscores of ASCII, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0)


def grams(words: Column, n: int) -> Column:
    """Runs of n words, joined by a space. words is read n times whole, never per run."""
    runs = F.arrays_zip(*[F.slice(words, k + 1, F.greatest(F.size(words) - (n - 1), F.lit(0))).alias(f"w{k}") for k in range(n)])
    return F.transform(runs, lambda r: F.concat_ws(" ", *[r[f"w{k}"] for k in range(n)]))
