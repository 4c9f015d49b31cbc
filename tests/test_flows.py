"""The flows end to end on the smallest tables."""

from dataclasses import replace

import pytest

from shopgrain.operators.customers import customer_features
from shopgrain.plans import flows
from shopgrain.registry.base import CFG
from shopgrain.session import materialized
from shopgrain.sources.tables import transactions

SMALL = replace(CFG, fraud=replace(CFG.fraud, trees=30), segment=replace(CFG.segment, k_values=(2, 3, 4, 5)))


@pytest.fixture(scope="module")
def tables(spark, sf):
    tx = materialized(transactions(spark, sf))
    return tx, materialized(customer_features(tx, SMALL))


def test_prepare(spark, tables, tmp_path):
    tables[0].selectExpr("* except (returned)", "if(returned = 1, 'Yes', 'No') as returned").write.option("header", True).csv(f"{tmp_path}/csv")
    out = flows.prepare(spark, f"{tmp_path}/csv", f"{tmp_path}/out", SMALL)
    assert out["transactions"].count() == 5999 and out["customers"].count() == tables[1].count()
    assert out["quality"].first()["quality_score"] > 90


def test_sales(tables):
    out = flows.sales_tables(*tables, SMALL)
    assert out["monthly"].count() == 79 and out["kpis"].count() > 20 and out["forecast"].where("rank = 1").count() == 12


def test_segmentation(tables, tmp_path):
    out = flows.segmentation(*tables, str(tmp_path), SMALL, restarts=1, stability_runs=2)
    assert out["labels"].count() == tables[1].count()
    names = [r["segment_name"] for r in out["profiles"].collect()]
    assert len(set(names)) == len(names)
    v = flows.validate_segments(out["labels"], ["monetary", "recency_days"])
    assert v.count() == 2 and {r["test"] for r in v.collect()} <= {"ANOVA", "Kruskal-Wallis"}


def test_churn(tables, tmp_path):
    out = flows.churn_flow(tables[0], str(tmp_path), SMALL, trees=5, boosts=3)
    assert {r["risk_level"] for r in out["risk_summary"].collect()} <= {"Low", "Medium", "High"}
    assert out["metrics"].count() == 3 and out["checks"].count() == 5


def test_fraud(tables, tmp_path, spark):
    out = flows.fraud_flow(*tables, folder=str(tmp_path), cfg=SMALL)
    assert out["profile"].count() == tables[1].count()
    assert out["profile"].where("composite_fraud_score < 0 or composite_fraud_score > 1 or risk_tier is null").count() == 0
    assert spark.read.parquet(f"{tmp_path}/fraud_risk_profile.parquet").columns[0] == "customer_id"


def test_cohorts(tables, tmp_path, spark):
    out = flows.cohort_flow(*tables, str(tmp_path), SMALL)
    assert {r["status"] for r in out["output_checks"].collect()} == {"PASS"}
    assert spark.read.parquet(f"{tmp_path}/retention_matrix.parquet").count() == out["summary"].count()
