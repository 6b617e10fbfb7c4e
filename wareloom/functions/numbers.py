"""Number columns read out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.functions.text import clean_text, let, strip


def int_price(c: Column) -> Column:
    """Whole-won price; null for "a / b" forms, unreadable numbers and values beyond 32 bits (:func:`is_price_too_large` tells those)."""
    def parsed(text):
        value = F.floor(F.regexp_replace(text, "[^0-9.]", "").try_cast("double"))
        several = text.rlike("[0-9][^/]*/[^/]*[0-9]")
        return F.when(~several, let(value, lambda v: F.when(v <= K.INT_MAX, v.try_cast("int"))))

    return let(strip(c.cast("string")), parsed)


def is_price_too_large(c: Column) -> Column:
    """Whether a cell reads as one price, but one that a stored price cannot hold."""
    text = strip(c.cast("string"))
    value = F.regexp_replace(text, "[^0-9.]", "").try_cast("double")
    return F.coalesce(~text.rlike("[0-9][^/]*/[^/]*[0-9]") & (F.floor(value) > K.INT_MAX), F.lit(False))


def signed_int(c: Column) -> Column:
    """First number with an optional sign; blanks and commas inside it are ignored."""
    found = F.regexp_extract(clean_text(c), r"[+-]?\s*[0-9,]+", 0)
    return F.translate(found, " ,", "").try_cast("bigint")


def first_number(c: Column) -> Column:
    """First number in the text, a minus only when directly in front."""
    return F.translate(F.regexp_extract(c, "-?[0-9][0-9,]*", 0), ",", "").try_cast("bigint")


def first_signed_number(c: Column) -> Column:
    """First number in the text with the sign before it, blanks between allowed."""
    pattern = r"([+-]?)\s*([0-9,]+)"
    amount = F.translate(F.regexp_extract(c, pattern, 2), ",", "").try_cast("bigint")
    return F.when(F.regexp_extract(c, pattern, 1) == "-", -amount).otherwise(amount)


def price_number(c: Column) -> Column:
    """Price for comparison: first digits-and-dots run once commas are gone."""
    return F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"[0-9][0-9.]*", 0).try_cast("double")


def transformed(value: Column, transform: str) -> Column:
    """The declared transform of an extracted field, as text."""
    if transform == "extract_number":
        return first_number(value).cast("string")
    if transform == "extract_signed_number":
        return first_signed_number(value).cast("string")
    return strip(value) if transform == "strip" else value
