import json
import random
from decimal import ROUND_CEILING, ROUND_HALF_UP, Decimal

import pytest

from wareloom.operators import pricing as pr
from wareloom.plans.pricing import policy


def run(spark, rows):
    df = spark.createDataFrame([(i, c, p) for i, (c, p) in enumerate(rows)], "id int, cost_price bigint, policy_json string")
    return sorted(pr.price_listings(pr.parse_policies(df)).collect(), key=lambda r: r.id)


def exact(cost, ship, other, market, ads, target, unit):
    """The same price by stepwise decimal arithmetic."""
    share = lambda rate, p: int((Decimal(p) * Decimal(str(rate)) / 100).quantize(Decimal(1), rounding=ROUND_HALF_UP))
    rates = sum(Decimal(str(r)) for r in (market, ads, target)) / 100
    price = int((Decimal(cost + ship + other) / (1 - rates) / unit).to_integral_value(rounding=ROUND_CEILING) * unit)
    while True:
        profit = price - cost - ship - other - share(market, price) - share(ads, price)
        if price > 2147483647:
            return None
        if Decimal(profit) * 100 >= Decimal(str(target)) * price:
            return price, profit
        price += unit


def test_published_cases(spark):
    first, second, third, fourth = run(spark, [
        (8000, policy()), (8000, policy(ship=("fixed", 0), ads=0, other=("percent_of_sale_price", 5), target=20)),
        (6699, policy(ship=("fixed", 0), market=5.005, ads=3.005, other=("fixed", 0))),
        (8000, policy(ship=("fixed", 0), market=49.999999, ads=0, other=("fixed", 0), target=50))])
    assert (first.sale_price, first.marketplace_fee, first.advertising_cost, first.other_cost, first.expected_profit, first.expected_margin_rate) == (17200, 860, 516, 500, 4324, 25.14)
    assert (second.sale_price, second.marketplace_fee, second.other_cost, second.expected_profit, second.expected_margin_rate) == (11500, 575, 575, 2350, 20.43)
    assert third.sale_price == 10100 and third.expected_margin_rate >= 25
    assert fourth.sale_price is None and "persistable range" in fourth.price_error


def test_prices_equal_stepwise_decimals(spark):
    rnd = random.Random(3)
    cases = []
    for _ in range(150):
        market, ads = round(rnd.uniform(0, 30), rnd.randint(0, 6)), round(rnd.uniform(0, 20), rnd.randint(0, 4))
        cases.append((rnd.randint(1, 50000), rnd.choice([0, 3000]), rnd.choice([0, 500]), market, ads, round(rnd.uniform(0, 40), 2), rnd.choice([1, 10, 100])))
    # Rates that leave almost nothing: hundreds of steps until the margin survives the rounding.
    cases += [(3, 0, 0, 49.99, 0, 50, 1), (7, 0, 0, 33.333, 33.333, 33.33, 1), (1, 0, 0, 60.5, 20.45, 19.049, 1)]
    got = run(spark, [(c[0], policy(ship=("fixed", c[1]), market=c[3], ads=c[4], other=("fixed", c[2]), target=c[5], unit=c[6])) for c in cases])
    for case, row in zip(cases, got):
        want = exact(*case)
        assert ((row.sale_price, row.expected_profit) if row.sale_price else None) == want, case


@pytest.mark.parametrize("cost, doc, message", [
    (8000, None, "policy is required"), (None, policy(), "cost price is required"), (0, policy(), "must be positive"), (8000, policy(market=60, ads=20, target=30), "total less than 100"),
    (8000, policy().replace("ceil", "floor"), "rounding mode"), (8000, policy(ship=("fixed", -1)), "shippingCost"), (8000, policy(market=1.00000000001), "nine decimals")])
def test_defects(spark, cost, doc, message):
    row = run(spark, [(cost, doc)])[0]
    assert message in row.price_error and row.sale_price is None


def test_version_defaults(spark):
    doc = json.loads(policy())
    doc.pop("version")
    rows = run(spark, [(8000, policy()), (8000, json.dumps(doc))])
    assert [r.policy.version for r in rows] == ["v1", "pricing:v1"]
