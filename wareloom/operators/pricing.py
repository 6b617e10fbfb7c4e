"""Sale prices from account policies, in exact scaled-integer arithmetic.

Policies are parsed once per account (``parse_policies``) and joined to products; a price is then a chain of column
expressions (``price_listings``). Rates are percentages with at most nine decimals, held as whole numbers of 10^-9.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom import constants as K

SCALE = 10**11  # 100 percent, in units of 10^-9 percent
FIRST_STEPS = 255

FIXED = "fixed"
PERCENT = "percent_of_sale_price"


def _entry(name: str, key: str) -> Column:
    return F.try_element_at(f"_{name}", F.lit(key))


def _present(name: str, label: str) -> Column:
    """Error when a component is missing or no object."""
    return (F.when(~F.coalesce(F.map_contains_key("_policy", label), F.lit(False)), F.lit(f"{label} is required"))
            .when(F.col(f"_{name}").isNull(), F.lit(f"{label} must be an object")))


def _amount(text: Column) -> Column:
    return text.try_cast("decimal(38,18)")


def _fixed_error(name: str, label: str) -> Column:
    amount = _amount(_entry(name, "amount"))
    return (F.when(~_entry(name, "type").eqNullSafe(F.lit(FIXED)), F.lit(f"{label} must be a fixed amount"))
            .when(~F.map_contains_key(f"_{name}", "amount"), F.lit(f"{label} amount is required"))
            .when(amount.isNull(), F.lit(f"{label} must be numeric"))
            .when((amount < 0) | (amount != F.floor(amount)), F.lit(f"{label} must be a non-negative whole-won amount")))


def _rate_error(name: str, label: str) -> Column:
    rate = _amount(_entry(name, "rate"))
    return (F.when(~_entry(name, "type").eqNullSafe(F.lit(PERCENT)), F.lit(f"{label} must be {PERCENT}"))
            .when(~F.map_contains_key(f"_{name}", "rate"), F.lit(f"{label} rate is required"))
            .when(rate.isNull(), F.lit(f"{label} must be numeric"))
            .when(rate < 0, F.lit(f"{label} rate must be non-negative"))
            .when(rate != rate.cast("decimal(29,9)"), F.lit(f"{label} rate must have at most nine decimals")))


COMPONENTS = {"shipping": "shippingCost", "market": "marketplaceFee", "ads": "advertisingCost", "other": "otherCost",
              "target": "targetMargin", "rounding": "rounding"}
POLICY = ("struct<version:string,shipping:bigint,other_fixed:bigint,unit:bigint,market_rate:decimal(13,0),ads_rate:decimal(13,0),"
          "other_rate:decimal(13,0),target_rate:decimal(13,0)>")


def parse_policies(accounts: DataFrame, policy: str = "policy_json") -> DataFrame:
    """Add ``policy`` (numbers), ``policy_missing`` (no usable document) and ``policy_defect`` (first defect, in checking order)."""
    text = F.col(policy)
    is_object = F.coalesce(F.trim(text).startswith("{"), F.lit(False))
    df = accounts.withColumn("_policy", F.when(is_object, F.from_json(text, "map<string,string>")))
    df = df.withColumns({f"_{n}": F.when(F.try_element_at("_policy", F.lit(label)).startswith("{"),
                                         F.from_json(F.try_element_at("_policy", F.lit(label)), "map<string,string>"))
                         for n, label in COMPONENTS.items()})
    scaled = lambda name: (F.least(_amount(_entry(name, "rate")), F.lit(100)) * 10**9).cast("decimal(13,0)")
    whole = lambda name, key: F.least(_amount(_entry(name, key)), F.lit(K.INT_MAX + 1)).cast("bigint")
    other_is_rate = _entry("other", "type") == PERCENT
    none = F.lit(0).cast("decimal(13,0)")
    df = df.withColumns({
        "_market_rate": scaled("market"), "_ads_rate": scaled("ads"), "_target_rate": scaled("target"),
        "_other_rate": F.when(other_is_rate, scaled("other")).otherwise(none),
        "_other_fixed": F.when(other_is_rate, F.lit(0).cast("bigint")).otherwise(whole("other", "amount"))})
    other_error = (F.when(_entry("other", "type") == FIXED, _fixed_error("other", "otherCost")).when(other_is_rate, _rate_error("other", "otherCost"))
                   .otherwise(F.lit("otherCost must be fixed or percent_of_sale_price")))
    total = F.col("_market_rate") + F.col("_ads_rate") + F.col("_other_rate") + F.col("_target_rate")
    unit = _amount(_entry("rounding", "unit"))
    defects = [
        _present("shipping", "shippingCost"), _fixed_error("shipping", "shippingCost"),
        _present("market", "marketplaceFee"), _rate_error("market", "marketplaceFee"),
        _present("ads", "advertisingCost"), _rate_error("ads", "advertisingCost"),
        _present("other", "otherCost"), other_error,
        _present("target", "targetMargin"), _rate_error("target", "targetMargin"),
        F.when(total >= SCALE, F.lit("percentage rates must total less than 100")),
        _present("rounding", "rounding"),
        F.when(~F.map_contains_key("_rounding", "mode"), F.lit("rounding mode is required")),
        F.when(~_entry("rounding", "mode").eqNullSafe(F.lit("ceil")), F.lit("rounding mode must be ceil")),
        F.when(~F.map_contains_key("_rounding", "unit"), F.lit("rounding unit is required")),
        F.when(unit.isNull(), F.lit("rounding unit must be numeric")),
        F.when((unit <= 0) | (unit != F.floor(unit)), F.lit("rounding unit must be a positive whole-won amount")),
    ]
    numbers = F.struct(
        F.coalesce(F.try_element_at("_policy", F.lit("version")), F.lit("pricing:v1")).alias("version"), whole("shipping", "amount").alias("shipping"),
        F.col("_other_fixed").alias("other_fixed"), whole("rounding", "unit").alias("unit"), F.col("_market_rate").alias("market_rate"),
        F.col("_ads_rate").alias("ads_rate"), F.col("_other_rate").alias("other_rate"), F.col("_target_rate").alias("target_rate")).cast(POLICY)
    missing = (F.when(text.isNull() | (F.trim(text) == "null"), F.lit("pricing policy is required"))
               .when(~is_object, F.lit("pricing policy must be an object")))
    df = df.withColumns({"policy_missing": missing, "policy_defect": F.when(is_object, F.coalesce(*defects))})
    df = df.withColumn("policy", F.when(F.col("policy_missing").isNull() & F.col("policy_defect").isNull(), numbers))
    return df.drop("_policy", *[f"_{n}" for n in COMPONENTS], "_market_rate", "_ads_rate", "_target_rate", "_other_rate", "_other_fixed")


def _fee(price: str, rate: str) -> str:
    """Half-up rounded share of a price."""
    return f"((CAST({price} AS DECIMAL(11,0)) * {rate} * 2 + {SCALE}) div {2 * SCALE})"


def _profit(price: str) -> str:
    return (f"({price} - cost - policy.shipping - policy.other_fixed - {_fee(price, 'policy.market_rate')} - {_fee(price, 'policy.ads_rate')}"
            f" - {_fee(price, 'policy.other_rate')})")


def _margin_met(price: str) -> str:
    return f"CAST({_profit(price)} AS DECIMAL(20,0)) * {SCALE} >= policy.target_rate * CAST({price} AS DECIMAL(11,0))"


def price_listings(df: DataFrame, cost: str = "cost_price") -> DataFrame:
    """Add ``price_error`` and the priced amounts to rows that carry a parsed ``policy``.

    The price is the cost basis over the share left by all rates, rounded up to the unit, then raised by whole units
    until the margin survives the rounding of the fees. Rounding can cost at most 1.5 won, which bounds the number of
    steps; nearly all rows stop within the first ones, the rest go on over ever larger ranges.
    """
    top = K.INT_MAX
    df = df.withColumn("cost", F.col(cost).cast("bigint")).withColumn("_cost_error", F.expr(
        "CASE WHEN cost IS NULL THEN 'cost price is required' WHEN cost <= 0 THEN 'cost price must be positive whole won' END"))
    early = F.coalesce(F.col("policy_missing"), F.col("_cost_error"), F.col("policy_defect"))
    df = df.withColumn("_early", early).withColumn("_fits", F.expr(
        f"_early IS NULL AND cost <= {top} AND policy.shipping <= {top} AND policy.other_fixed <= {top} AND policy.unit <= {top}"))
    df = df.withColumns({
        "_basis": F.expr(f"CASE WHEN _fits THEN CAST(cost + policy.shipping + policy.other_fixed AS DECIMAL(12,0)) * {SCALE} END"),
        "_left": F.expr(f"CASE WHEN _fits THEN CAST({SCALE} - policy.market_rate - policy.ads_rate - policy.other_rate - policy.target_rate AS DECIMAL(13,0)) END")})
    df = df.withColumn("_base", F.expr(
        f"CASE WHEN _basis <= _left * {top} THEN ((_basis + _left * policy.unit - 1) div (_left * policy.unit)) * policy.unit END"))
    df = df.withColumn("_steps", F.expr(
        f"CASE WHEN _base <= {top} THEN least(CAST((15 * {SCALE}) div (10 * _left * policy.unit) AS BIGINT) + 2, ({top} - _base) div policy.unit) END"))
    block = lambda first, last: (f"get(filter(transform(sequence({first}, {last}), i -> _base + i * policy.unit), p -> {_margin_met('p')}), 0)")
    size = FIRST_STEPS + 1

    def steps(first: int, last: int) -> str:
        return f"CASE WHEN _steps >= {first} THEN {block(f'{first}L', f'least(_steps, {last}L)')} END"

    def blocks(first: int, last: int | None) -> str:
        """Lowest price met in a range of blocks; null when the steps end before it or none is met."""
        end = f"_steps div {size}" if last is None else f"least({last}L, _steps div {size})"
        one = block(f"b * {size}", f"least(b * {size} + {FIRST_STEPS}, _steps)")
        return f"CASE WHEN _steps >= {first * size} THEN array_min(transform(sequence({first}L, {end}), b -> {one})) END"

    tiers = [steps(*r) for r in ((1, 8), (9, 63), (64, FIRST_STEPS))] + [blocks(*r) for r in ((1, 3), (4, 31), (32, 511), (512, None))]
    df = df.withColumn("sale_price", F.expr(
        f"CASE WHEN _base > {top} THEN NULL WHEN {_margin_met('_base')} THEN _base ELSE coalesce({', '.join(tiers)}) END"))
    df = df.withColumn("price_error", F.coalesce("_early", F.expr(
        "CASE WHEN sale_price IS NULL THEN 'calculated amount exceeds persistable range' END")))
    amount = lambda sql: F.expr(f"CAST(CASE WHEN sale_price IS NOT NULL THEN {sql} END AS INT)")
    df = df.withColumns({
        "marketplace_fee": amount(_fee("sale_price", "policy.market_rate")), "advertising_cost": amount(_fee("sale_price", "policy.ads_rate")),
        "other_cost": amount(f"policy.other_fixed + {_fee('sale_price', 'policy.other_rate')}"), "expected_profit": amount(_profit("sale_price"))})
    margin = "((2 * CAST(expected_profit AS BIGINT) * 10000 + sale_price) div (2 * sale_price)) / 100D"
    return df.withColumns({"expected_margin_rate": F.expr(f"CASE WHEN sale_price IS NOT NULL THEN {margin} END"),
                           "sale_price": F.col("sale_price").cast("int")}).drop(
        "cost", "_cost_error", "_early", "_fits", "_basis", "_left", "_base", "_steps")


def resolve_policy(rules: Column) -> Column:
    """``struct<policy_json, invalid>`` from an account's generation rules (JSON).

    A policy object with at least one pricing key is used; an absent one, an empty one, or one that only holds objects
    of other scopes counts as missing; anything else is invalid.
    """
    found = F.try_element_at(F.from_json(rules, "map<string,string>"), F.lit("pricingPolicy"))
    is_object = found.startswith("{")
    entries = F.from_json(found, "map<string,string>")
    keys = F.map_keys(entries)
    direct = F.arrays_overlap(keys, F.array(*[F.lit(k) for k in K.POLICY_MARKER_KEYS]))
    scoped = (F.size(keys) > 0) & F.forall(F.map_values(entries), lambda v: F.coalesce(v.startswith("{"), F.lit(False)))
    invalid = F.when(found.isNull(), F.lit(False)).when(~is_object, F.lit(True)).otherwise(~direct & ~scoped & (F.size(keys) > 0))
    return F.struct(F.when(is_object & direct, found).alias("policy_json"), invalid.alias("invalid"))
