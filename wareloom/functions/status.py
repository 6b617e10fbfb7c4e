"""Sale-status columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.functions.text import clean_text, lookup, strip


def ledger_status(c: Column) -> Column:
    """Canonical supplier status; null for unknown spellings."""
    return lookup(clean_text(c), K.STATUS_SPELLINGS)


def is_available(status: Column) -> Column:
    return ~F.coalesce(status, F.lit("")).isin(*K.UNAVAILABLE_STATUSES)


def map_status(value: Column, mapping: dict[str, str], default: str) -> Column:
    """Canonical value, else exact mapping, else first mapping key contained in the text, else the default."""
    text = strip(value)
    low = F.lower(text)
    inside = [F.when(low.contains(k.strip().lower()), F.lit(v)) for k, v in mapping.items() if len(k.strip()) >= 2]
    exact = [F.when(text == k, F.lit(v)) for k, v in mapping.items()]
    mapped = F.coalesce(F.when(text.isin(*K.CRAWL_STATUSES), text), *exact, *inside, F.lit(default))
    absent = "available" if default == "available" else "unknown"
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(absent)).otherwise(mapped)


def limit_status(c: Column) -> Column:
    """Order-limit rule: "0" means sold out, any other value means available."""
    text = clean_text(c)
    return F.when(text == "0", F.lit("sold_out")).when(text.isNotNull(), F.lit("available"))


def is_sold_out_text(c: Column) -> Column:
    return F.coalesce(c.rlike(K.SOLD_OUT_PATTERN), F.lit(False))


def classify_page(limit: Column, explicit: Column, buy: Column) -> Column:
    """Sale status from page signals; contradicting signals stay unknown."""
    return (
        F.when((F.coalesce(strip(limit), F.lit("")) == "0") | (explicit & ~buy), F.lit("sold_out"))
        .when(buy & ~explicit, F.lit("available"))
        .otherwise(F.lit("unknown"))
    )
