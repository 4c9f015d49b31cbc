import datetime as dt
from dataclasses import replace

import pytest

from shopgrain.config import DEFAULT
from shopgrain.operators import cohorts

CFG = replace(DEFAULT, cohort=replace(DEFAULT.cohort, incomplete_cutoff="2024-04-01"))


@pytest.fixture(scope="module")
def tx(make_tx):
    return make_tx([
        dict(customer_id="A", day=0, total_amount=100.0), dict(customer_id="A", day=35, total_amount=50.0),
        dict(customer_id="B", day=5, total_amount=60.0), dict(customer_id="B", day=70, returned=1),
        dict(customer_id="C", day=33, total_amount=80.0), dict(customer_id="C", day=95, total_amount=20.0),
        dict(customer_id="D", day=10, returned=1), dict(customer_id="E", day=2, returned=1), dict(customer_id="E", day=40, total_amount=10.0),
    ])


@pytest.fixture(scope="module")
def cells(tx):
    return {(str(r["cohort_month"]), r["period_offset"]): r for r in cohorts.cohort_cells(tx, CFG).collect()}


def test_grid_zero_before_cutoff_and_null_after(cells):
    jan, feb = "2024-01-01", "2024-02-01"
    assert set(cells) == {(jan, 0), (jan, 1), (feb, 0), (feb, 1)}
    assert (cells[jan, 0]["cohort_size"], cells[jan, 1]["active"], cells[jan, 1]["retention"]) == (2, 1, 0.5)
    assert cells[feb, 1]["retention"] == 0 and cells[feb, 1]["revenue"] == 0
    assert cells[feb, 0]["cohort_size"] == 2, "a returned first order does not start a cohort; only-returning customers drop out"
    assert cells[jan, 1]["ltv"] == 105.0


def test_cells_past_the_cutoff_are_null(make_tx):
    tx = make_tx([dict(customer_id="A", day=0), dict(customer_id="A", day=62), dict(customer_id="B", day=62)])
    got = {(r["cohort_month"].month, r["period_offset"]): r for r in cohorts.cohort_cells(tx, CFG).collect()}
    assert got[3, 2]["retention"] is None and got[3, 2]["revenue"] is None and got[3, 2]["ltv"] is None
    assert got[1, 2]["retention"] == 1.0


def test_negative_offsets_are_clipped_and_do_not_reach_the_grid(tx):
    rows = cohorts.assign_cohorts(tx).where("customer_id = 'E'").orderBy("order_date").collect()
    assert [r["period_offset"] for r in rows] == [0, 0] and rows[0]["cohort_month"] == dt.date(2024, 2, 1)
    assert cohorts.assign_cohorts(tx).where("customer_id = 'D'").count() == 0


def test_rates_are_bounded(spark, sf):
    from shopgrain.sources.tables import transactions
    c = cohorts.cohort_cells(transactions(spark, sf), CFG)
    assert c.where("retention < 0 or retention > 1 or (period_offset = 0 and retention <> 1)").count() == 0


def test_projection_is_a_line_floored_at_zero(spark):
    rows = [(dt.date(2024, 1, 1), i, float(10 * i)) for i in range(4)] + [(dt.date(2024, 2, 1), i, float(30 - 15 * i)) for i in range(3)]
    got = {r["cohort_month"].month: r["projected_ltv"] for r in cohorts.ltv_projection(spark.createDataFrame(rows, "cohort_month date, period_offset int, ltv double"), 12).collect()}
    assert got == {1: 120.0, 2: 0.0}


def test_wide_matrix_names_offsets_as_text(tx):
    w = cohorts.wide_matrix(cohorts.cohort_cells(tx, CFG), "retention")
    assert w.columns == ["cohort_month", "0", "1"] and w.first()["cohort_month"] == "2024-01"


def test_scenarios(tx):
    rows = cohorts.uplift_scenarios(cohorts.cohort_cells(tx, CFG), CFG).collect()
    assert len(rows) == 6
    for r in rows:
        assert r["annual_uplift"] == pytest.approx(r["avg_cohort_size"] * r["increment"] * r["ltv"] * 12)
