import datetime as dt

import pytest

from shopgrain.operators.customers import churn_retention_profile, customer_features, missing_days, portfolio_kpis, temporal_profile


def by_id(df):
    return {r["customer_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def basic(make_tx):
    rows = [
        dict(customer_id="C001", day=0, total_amount=100.0, discount=0.1, category="Electronics"),
        dict(customer_id="C001", day=30, total_amount=150.0, category="Clothing"),
        dict(customer_id="C001", day=60, total_amount=200.0, discount=0.2, category="Electronics", region="South"),
        dict(customer_id="C002", day=0, total_amount=300.0, category="Books", region="East"),
        dict(customer_id="C002", day=10, total_amount=250.0, discount=0.15, category="Books", region="East"),
        dict(customer_id="C003", day=0, total_amount=50.0, region="West"),
    ]
    return by_id(customer_features(make_tx(rows)))


def test_frequency_monetary_aov_tenure(basic):
    assert [basic[c]["frequency"] for c in ("C001", "C002", "C003")] == [3, 2, 1]
    assert [basic[c]["monetary"] for c in ("C001", "C002", "C003")] == [450, 550, 50]
    assert [basic[c]["avg_order_value"] for c in ("C001", "C002", "C003")] == [150, 275, 50]
    assert [basic[c]["tenure_days"] for c in ("C001", "C002", "C003")] == [60, 10, 0]


def test_rates_diversity_and_modes(basic):
    assert [round(basic[c]["discount_usage_rate"], 4) for c in ("C001", "C002", "C003")] == [0.6667, 0.5, 0]
    assert [basic[c]["category_diversity"] for c in ("C001", "C002", "C003")] == [2, 1, 1]
    assert [basic[c]["preferred_region"] for c in ("C001", "C002", "C003")] == ["North", "East", "West"]


def test_return_in_the_middle_is_left_out(make_tx):
    r = by_id(customer_features(make_tx([
        dict(day=0, total_amount=100.0), dict(day=5, total_amount=150.0, returned=1), dict(day=9, total_amount=200.0)])))["C001"]
    assert (r["frequency"], r["monetary"], round(r["return_rate"], 4)) == (2, 300, 0.3333)
    assert r["net_monetary"] == 150


def test_return_only_customer(make_tx):
    r = by_id(customer_features(make_tx([
        dict(day=0, returned=1), dict(day=3, returned=1), dict(customer_id="C002", day=1)])))["C001"]
    assert r["recency_days"] is None and r["frequency"] is None and r["monetary"] is None
    assert (r["churn"], r["return_rate"], r["net_monetary"], r["last_order_was_return"]) == (1, 1, -200, 1)


def test_same_day_orders(make_tx):
    r = by_id(customer_features(make_tx([dict(total_amount=150.0)] * 3)))["C001"]
    assert (r["frequency"], r["monetary"], r["tenure_days"]) == (3, 450, 0)


def test_negative_returned_amount_is_subtracted(make_tx):
    r = by_id(customer_features(make_tx([
        dict(day=0, total_amount=100.0), dict(day=1, total_amount=-50.0, returned=1), dict(day=2, total_amount=200.0)])))["C001"]
    assert r["net_monetary"] == 350


def test_missing_days(make_tx):
    tx = make_tx([dict(day=d) for d in [*range(10), *range(19, 31)]])
    assert missing_days(tx).count() == 9
    assert temporal_profile(tx).first()["missing_dates"] == 9


def test_at_risk_and_loyalty_bands(spark):
    cust = spark.createDataFrame([(1, 500.0, 0, 100), (1, 300.0, 0, 50), (1, 200.0, 0, 30), (1, 800.0, 0, 110)],
                                 "frequency bigint, monetary double, churn int, recency_days int")
    p = churn_retention_profile(cust).first()
    assert (p["at_risk_count"], p["revenue_at_risk"]) == (2, 1300)
    bands = spark.createDataFrame([(1,)] * 10 + [(5,)] * 5 + [(10,)] * 5, "frequency bigint").selectExpr(
        "frequency", "100.0D as monetary", "0 as churn", "10 as recency_days")
    p = churn_retention_profile(bands).first()
    assert (p["one_time_buyers"], p["loyal_customers"], p["super_loyal"]) == (10, 10, 5)


def test_portfolio(make_tx):
    tx = make_tx([dict(customer_id=f"C{i % 50:03d}", day=i, returned=int(i < 5)) for i in range(100)])
    k = portfolio_kpis(tx, customer_features(tx)).first()
    assert (k["avg_orders_per_customer"], k["return_rate"], k["total_revenue"]) == (2.0, 5.0, 10_000)
    assert k["date_range_start"] == dt.date(2024, 1, 1)
