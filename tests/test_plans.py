"""Plan shape: pruned scans, pushed filters, no nested-loop joins, one shuffle where one is enough."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shopgrain.operators import churn, clean, customers, sales
from shopgrain.registry import fraud as registry
from shopgrain.sources.tables import transactions

LAZY = ["monthly_revenue_yoy", "region_perf", "category_pareto", "cohort_cells", "segment_ltv", "cohort_pairs", "velocity", "hhi", "temporal_profile",
        "missing_days", "discount_tiers", "key_overlap", "sanity_checks", "portfolio_kpis", "uplift_scenarios", "cohort_outliers", "cutoff_features", "dunn", "exposure"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loop_joins(spark, sf, name):
    p = plan(entry.queries()[name](spark, sf))
    assert "NestedLoop" not in p and "CartesianProduct" not in p


def test_scan_reads_only_what_is_needed(spark, sf):
    p = plan(sales.weekly_sales(transactions(spark, sf, ["order_date", "customer_id", "total_amount", "returned"])))
    assert "p_retailprice" not in p and "n_nationkey" not in p and "l_tax" not in p


def test_date_filter_reaches_the_scan(spark, sf, tmp_path):
    transactions(spark, sf, ["customer_id", "order_date"]).write.parquet(f"{tmp_path}/tx")
    p = plan(churn.pre_cutoff(spark.read.parquet(f"{tmp_path}/tx"), dt.date(1999, 1, 1), 365))
    assert "PushedFilters: [IsNotNull(order_date), LessThanOrEqual(order_date,1999-01-01), GreaterThanOrEqual" in p


def test_customer_measures_take_one_shuffle(spark, sf, tmp_path):
    transactions(spark, sf).write.parquet(f"{tmp_path}/tx")
    p = plan(customers.customer_measures(spark.read.parquet(f"{tmp_path}/tx")))
    assert p.count("Exchange hashpartitioning") == 1 and "Expand" not in p


def test_dedup_of_order_lines_needs_no_shuffle_of_its_own(spark, sf, monkeypatch):
    """The join of lines and orders has dealt the lines out by order; copies of an order id are looked for there."""
    plans, real = [], clean.materialized
    monkeypatch.setattr(clean, "materialized", lambda df: plans.append(plan(df)) or real(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entry.queries()["clean_transactions"](spark, sf)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(l_orderkey" in plans[0] and "hashpartitioning(order_id" not in plans[0]
    assert not [x for x in plans[0].splitlines() if "Exchange" in x and "order_id" in x]


def test_lines_meet_their_parts_before_they_carry_an_order(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(transactions(spark, sf)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = {k: next(x for x in lines if f"Join [{k}#" in x) for k in ("l_partkey", "l_orderkey")}
    assert lines.index(join["l_orderkey"]) < lines.index(join["l_partkey"])  # what stands deeper runs first


def test_a_customer_lies_in_one_file_of_the_written_transactions(spark, sf):
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        tx = registry._tx(spark, sf).select("customer_id", F.input_file_name().alias("f"))
        assert tx.distinct().count() == tx.select("customer_id").distinct().count() and tx.select("f").distinct().count() > 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        for k in list(conf)[1:]:
            spark.conf.unset(k)


def test_merged_risk_measures_customers_once(spark, sf, monkeypatch):
    calls, real = [], customers.customer_measures
    monkeypatch.setattr(customers, "customer_measures", lambda tx: calls.append(1) or real(tx))
    assert entry.queries()["segment_fraud"](spark, sf).count() > 0 and len(calls) == 1
