"""Pricing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wareloom.operators import pricing as pr
from wareloom.plans.registry import query


def policy(ship=("fixed", 3000), market=5.0, ads=3.0, other=("fixed", 500), target=25.0, unit=100, version='"version":"v1",'):
    part = lambda name, kind, v: f'"{name}":{{"type":"{kind}","{"amount" if kind == "fixed" else "rate"}":{v}}}'
    pct = "percent_of_sale_price"
    return ("{" + version + ",".join([part("shippingCost", *ship), part("marketplaceFee", pct, market), part("advertisingCost", pct, ads),
                                      part("otherCost", *other), part("targetMargin", pct, target), f'"rounding":{{"unit":{unit},"mode":"ceil"}}']) + "}")


# (json, shipping, fixed other cost, rates in 10^-9 percent: market, ads, other, target; unit)
POLICIES = [
    (policy(), 3000, 500, 5, 3, 0, 25, 100),
    (policy(ship=("fixed", 0), market=5.005, ads=3.005, other=("fixed", 0), unit=10), 0, 0, 5.005, 3.005, 0, 25, 10),
    (policy(ship=("fixed", 0), ads=0, other=("percent_of_sale_price", 5), target=20, unit=1), 0, 0, 5, 0, 5, 20, 1),
    (policy(market=49.999999, ads=0, target=50), 3000, 500, 49.999999, 0, 0, 50, 100),
    (policy(market=33.3333, ads=12.25, target=54.3, unit=1), 3000, 500, 33.3333, 12.25, 0, 54.3, 1),
]


def choose(values, column="p_size"):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int"))


def _case(i, kind="HUGEINT"):
    scale = lambda v: round(v * 10**9) if i in (3, 4, 5, 6) else v
    return "CAST(CASE p_size % 5 " + " ".join(f"WHEN {n} THEN {scale(p[i])}" for n, p in enumerate(POLICIES)) + f" END AS {kind})"


S = 10**11
FEE = "((2 * p * {0} + " + str(S) + ") // " + str(2 * S) + ")"
PRICES_SQL = f"""a AS (SELECT p_partkey, CAST(floor(p_retailprice) * 5 AS HUGEINT) AS cost, {_case(1)} AS ship, {_case(2)} AS fixed, {_case(3)} AS rm, {_case(4)} AS ra, {_case(5)} AS ro,
   {_case(6)} AS rt, {_case(7)} AS unit FROM part),
b AS (SELECT *, (cost + ship + fixed) * {S} AS num, CAST({S} AS HUGEINT) - rm - ra - ro - rt AS den FROM a),
c AS (SELECT *, ((num + den * unit - 1) // (den * unit)) * unit AS base FROM b),
d AS (SELECT *, unnest(range(CASE WHEN base > 2147483647 THEN 1 ELSE CAST((15 * {S}) // (10 * den * unit) AS BIGINT) + 3 END)) AS i FROM c),
e AS (SELECT *, base + i * unit AS p FROM d),
f AS (SELECT *, {FEE.format('rm')} AS fm, {FEE.format('ra')} AS fa, {FEE.format('ro')} AS fo FROM e),
g AS (SELECT *, p - cost - ship - fixed - fm - fa - fo AS profit FROM f),
h AS (SELECT p_partkey, arg_min(struct_pack(p, fm, fa, fo, fixed, profit), i) AS w FROM g WHERE profit * {S} >= rt * p AND p <= 2147483647 GROUP BY p_partkey),
priced AS (SELECT p_partkey, CAST(w.p AS INT) AS sale_price, CAST(w.fm AS INT) AS marketplace_fee, CAST(w.fa AS INT) AS advertising_cost, CAST(w.fo + w.fixed AS INT) AS other_cost,
  CAST(w.profit AS INT) AS expected_profit, CAST((2 * w.profit * 10000 + w.p) // (2 * w.p) AS DOUBLE) / 100 AS expected_margin_rate FROM part LEFT JOIN h USING (p_partkey))"""


def policy_table(t):
    """The five policies by number, parsed once each."""
    numbers = t.part.select((F.col("p_size") % len(POLICIES)).alias("policy_id")).distinct()
    return pr.parse_policies(numbers.withColumn("policy_json", choose([p[0] for p in POLICIES], "policy_id")))


def priced(t):
    """Products priced under five policies."""
    rows = t.part.withColumns({"policy_id": F.col("p_size") % len(POLICIES), "cost_price": F.floor("p_retailprice") * 5})
    return pr.price_listings(rows.join(policy_table(t), "policy_id"))


@query("D1", f"""
WITH {PRICES_SQL}
SELECT *, CASE WHEN sale_price IS NULL THEN 'calculated amount exceeds persistable range' END AS price_error FROM priced""")
def d1(t):
    return priced(t).select("p_partkey", "sale_price", "marketplace_fee", "advertising_cost", "other_cost", "expected_profit", "expected_margin_rate", "price_error")


GOOD = policy()
DEFECTS = [
    (None, "pricing policy is required"), ("[1]", "pricing policy must be an object"), (GOOD.replace('"shippingCost"', '"x"'), "shippingCost is required"),
    (GOOD.replace('{"type":"percent_of_sale_price","rate":5.0}', "[]"), "marketplaceFee must be an object"),
    (policy(ship=("percent_of_sale_price", 3)), "shippingCost must be a fixed amount"), (GOOD.replace('"amount":3000', '"sum":1'), "shippingCost amount is required"),
    (policy(ship=("fixed", '"abc"')), "shippingCost must be numeric"), (policy(ship=("fixed", -1)), "shippingCost must be a non-negative whole-won amount"),
    (policy(ship=("fixed", 1.5)), "shippingCost must be a non-negative whole-won amount"), (GOOD.replace('"rate":3.0', '"x":3'), "advertisingCost rate is required"),
    (policy(ads=-3), "advertisingCost rate must be non-negative"), (GOOD.replace('{"type":"fixed","amount":500}', '{"type":"odd"}'), "otherCost must be fixed or percent_of_sale_price"),
    (policy(market=60, ads=20, target=30), "percentage rates must total less than 100"), (GOOD.replace('"mode":"ceil"', '"mode":"floor"'), "rounding mode must be ceil"),
    (GOOD.replace(',"mode":"ceil"', ""), "rounding mode is required"), (GOOD.replace('"unit":100,', ""), "rounding unit is required"),
    (policy(unit=0), "rounding unit must be a positive whole-won amount"), (GOOD, None), (GOOD.replace('"rounding"', '"r"'), "rounding is required"),
]


@query("D2", f"""
WITH i AS (SELECT p_partkey, CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 23 = 1 THEN 0 ELSE 8000 END AS cost,
  CASE p_size % {len(DEFECTS)} {' '.join(f"WHEN {i} THEN {'NULL' if m is None else chr(39) + m + chr(39)}" for i, (_, m) in enumerate(DEFECTS))} END AS defect FROM part)
SELECT p_partkey, CASE WHEN defect LIKE 'pricing policy%' THEN defect WHEN cost IS NULL THEN 'cost price is required' WHEN cost = 0 THEN 'cost price must be positive whole won' ELSE defect END AS price_error FROM i""")
def d2(t):
    key = F.col("p_partkey") % 23
    rows = t.part.withColumns({"policy_json": choose([p for p, _ in DEFECTS]), "cost_price": F.when(key == 1, 0).when(key != 0, 8000)})
    return pr.price_listings(pr.parse_policies(rows)).select("p_partkey", "price_error")


RULES = ['{"pricingPolicy":{"shippingCost":1,"x":2}}', '{"pricingPolicy":null}', "{}", '{"pricingPolicy":"text"}', '{"pricingPolicy":{"a":{},"b":{"shippingCost":1}}}',
         '{"pricingPolicy":{"a":1}}', '{"pricingPolicy":{}}', '{"pricingPolicy":[{"rounding":1}]}', None, '{"pricingPolicy":{"rounding":{"unit":1}}}']
RESOLVED = [('{"shippingCost":1,"x":2}', False), (None, False), (None, False), (None, True), (None, False), (None, True), (None, False), (None, True), (None, False), ('{"rounding":{"unit":1}}', False)]


@query("D3", f"""
SELECT c_custkey AS account_id, CASE c_custkey % 10 {' '.join(f"WHEN {i} THEN '{p}'" for i, (p, _) in enumerate(RESOLVED) if p)} END AS policy_json,
  c_custkey % 10 IN (3, 5, 7) AS invalid FROM customer""")
def d3(t):
    got = t.customer.select(F.col("c_custkey").alias("account_id"), pr.resolve_policy(choose(RULES, "c_custkey")).alias("p"))
    return got.select("account_id", "p.policy_json", F.coalesce("p.invalid", F.lit(False)).alias("invalid"))
