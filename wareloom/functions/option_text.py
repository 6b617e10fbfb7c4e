"""Option texts: placeholders, values and price marks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from wareloom import constants as K
from wareloom.functions.text import let, null_if_empty, squash, strip

def is_placeholder(c: Column) -> Column:
    """A prompt such as "please choose" instead of a real option."""
    bare = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\-\[\]()<>]+", ""))
    return (bare == "") | (bare == "선택") | (bare.contains("선택") & bare.rlike("필수|옵션|하세요|주세요|바랍니다"))


def _amount(text: Column, sign: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "").try_cast("bigint")
    minus = strip(text).startswith("-") | (strip(sign) == "-")
    return F.when(minus, -digits).otherwise(digits)


def _parsed(value: Column, delta: Column, supply: Column) -> Column:
    return F.struct(value.alias("value"), delta.cast("bigint").alias("delta"), supply.cast("bigint").alias("supply"))


def _trailing_price(text: Column, base: Column, parser_on: bool) -> Column:
    """Value and price difference from a trailing (+n), [+n] or +n mark."""
    def parts(pattern):
        name = strip(F.regexp_replace(text, pattern, ""))
        delta = _amount(F.regexp_extract(text, pattern, 2), F.regexp_extract(text, pattern, 1))
        return F.struct(F.when(name == "", text).otherwise(name).alias("value"),
                        F.when(name != "", delta).alias("delta"))
    none = F.struct(text.alias("value"), F.lit(None).cast("bigint").alias("delta"))
    got = F.when(text.rlike(K.OPTION_PRICE_BRACKETED), parts(K.OPTION_PRICE_BRACKETED)).when(text.rlike(K.OPTION_PRICE_TRAILING), parts(K.OPTION_PRICE_TRAILING)).otherwise(none)

    def priced(g):
        delta = F.coalesce(g["delta"], F.lit(0).cast("bigint")) if parser_on else g["delta"]
        return _parsed(g["value"], delta, base + delta)

    return let(got, priced)


def parse_option(c: Column, base: Column | None = None, parser: dict | None = None) -> Column:
    """Option text to ``struct<value, delta, supply>``; a declared pattern is tried before the trailing price mark.

    ``parser``: ``enabled``, ``confidence``, ``pattern`` (named groups value, sign, price), ``price_kind``.
    """
    base = F.lit(None).cast("bigint") if base is None else base.cast("bigint")
    parser = parser or {}
    on = bool(parser.get("enabled") and parser.get("confidence", "low") != "low" and parser.get("pattern"))

    def declared(text: Column) -> Column:
        groups = re.compile(parser["pattern"]).groupindex
        pattern = parser["pattern"].replace("(?P<", "(?<")

        def group(name):
            return F.regexp_extract(text, pattern, groups[name]) if name in groups else F.lit("")

        found = F.struct(null_if_empty(squash(group("value"))).alias("value"),
                         _amount(group("price"), group("sign")).alias("price"))
        supply_given = parser.get("price_kind") == "supply"

        def priced(f):
            delta = f["price"] - base if supply_given else f["price"]
            supply = f["price"] if supply_given else base + f["price"]
            filled = F.when(f["price"].isNull(), _parsed(f["value"], F.lit(0), base)).otherwise(_parsed(f["value"], delta, supply))
            return F.when(f["value"].isNotNull(), filled)

        return F.when(text.rlike(pattern), let(found, priced))

    def parsed(text: Column) -> Column:
        plain = _trailing_price(text, base, on)
        real = F.coalesce(declared(text), plain) if on else plain
        nothing = F.lit(None).cast("bigint")
        return F.when(is_placeholder(text), _parsed(F.lit(None).cast("string"), nothing, nothing)).otherwise(real)

    return let(squash(F.coalesce(c, F.lit(""))), parsed)


def group_summary(parsed: Column) -> Column:
    """``n개 · values / signed prices`` for a list of parsed options; null when none has a value."""
    def price(p):
        amount = F.coalesce(p["delta"], p["supply"])
        sign = F.when(amount < 0, F.lit("")).otherwise(F.lit("+"))
        return F.when(amount.isNull(), F.lit("-")).otherwise(F.concat(sign, F.format_number(amount, 0), F.lit("원")))

    def summary(kept):
        values = F.array_join(F.transform(kept, lambda p: p["value"]), ", ")
        prices = F.array_join(F.transform(kept, price), ", ")
        return F.when(F.size(kept) > 0, F.concat(F.size(kept).cast("string"), F.lit("개 · "), values, F.lit(" / "), prices))

    return let(F.filter(parsed, lambda p: p["value"].isNotNull()), summary)
