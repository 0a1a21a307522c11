"""Small text helpers shared by listings, reports and the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, decimals: int = 3) -> Column:
    """A number with fixed decimals, rounded on its exact binary value, ties to even.

    The product with the power of ten is taken as a rounded part and its exact
    error (the factor is short enough for both halves of the split number), so a
    value next to a tie falls on its true side.
    """
    scale = float(10 ** decimals)
    v = F.abs(value)
    spread = v * 134217729.0
    high = spread - (spread - v)
    product = v * scale
    error = (high * scale - product) + (v - high) * scale
    whole = F.floor(product)
    over = ((product - whole) - 0.5) + error
    up = (over > 0) | ((over == 0) & (whole % 2 == 1))
    n = whole + F.when(up, 1).otherwise(0)
    unit = int(scale)
    return F.concat(
        F.when(value < 0, "-").otherwise(""), F.floor(n / unit).cast("long").cast("string"),
        F.lit("."), F.lpad((n % unit).cast("string"), decimals, "0"))


def or_mark(value: Column, mark: str = "?") -> Column:
    """The value as text, `mark` when it is null or empty."""
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(mark))


def or_none(value: Column) -> Column:
    """The value as text, 'None' when it is null."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def plain_number(value: Column) -> Column:
    """A double as text with its shortest digits and a point, never with an exponent."""
    digits = F.regexp_replace(value.cast("decimal(38,12)").cast("string"), "0+$", "")
    size = F.abs(value)
    plain = ((size >= 1e-3) & (size < 1e7)) | (size == 0)
    return F.when(plain, value.cast("string")).otherwise(
        F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits))


def text_of(*parts: Column | str) -> Column:
    """Parts put together; null when a part is null."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def normalize_space(text: Column) -> Column:
    """Collapse white space but keep tabs; lines are joined by a blank."""
    lines = F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]")
    squeezed = F.transform(lines, lambda s: F.regexp_replace(s, r"(?U)[^\S\t]+", " "))
    last = F.element_at(squeezed, -1)
    kept = F.when(last == "", F.slice(squeezed, 1, F.size(squeezed) - 1)).otherwise(squeezed)
    return F.regexp_replace(F.array_join(kept, " "), r"(?U)^\s+|\s+$", "")


def name_key(text: Column) -> Column:
    """Upper-case letters and digits only, the key names are compared by (X11)."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]+", "")
